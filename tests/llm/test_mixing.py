import os
import random

import numpy as np
import pytest

from pinloom.llm.mixing import Sums, fill, mix_sources, posteriors, rates_after, solve_rates
from pinloom.llm.tokens import FOLDER, VOCABULARY, encoder

pytestmark = pytest.mark.skipif(not os.path.exists(f"{FOLDER}/{VOCABULARY}"), reason="no vocabulary")
WORDS = {"a": "river stone water field grass hill", "b": "engine wheel bolt piston gear", "c": "poem verse rhyme song"}


def documents(spark, sizes, seed=1):
    rng = random.Random(seed)
    rows = [(f"{s}{i}", " ".join(rng.choice(WORDS[s].split()) for _ in range(rng.randint(1, 30))), s, 1) for s, n in sizes.items() for i in range(n)]
    rows += [("n1", "river water", None, 1), ("n2", None, "a", 1), ("n3", "", "b", 1), ("n4", "gear", "other", 1), (None, "stone", "a", 1)]
    return spark.createDataFrame(rows, "doc_id string, text string, source string, copies int").repartition(3)


def targets(spark, *rows):
    return spark.createDataFrame([*rows, ("z", None, 1), (None, 0.2, 1)], "source string, target_share double, max_repeats int")


def test_shares_are_reached_within_a_document(spark):
    docs = documents(spark, {"a": 300, "b": 120, "c": 40})
    mixture, shares = mix_sources(docs, targets(spark, ("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)))
    rows = {r.source: r for r in shares.collect()}
    sizes = {r.doc_id: len(encoder().encode(r.text)) for r in docs.collect()}
    got = mixture.collect()
    assert len({r.doc_id for r in got}) == len(got) and all(r.n_tokens == sizes[r.doc_id] for r in got)
    assert all(1 <= r.copies <= rows[r.source].max_repeats for r in got)
    longest = max(sizes.values())
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        reached = sum(r.n_tokens * r.copies for r in got if r.source == s)
        assert reached == rows[s].reached_tokens and abs(reached - rows[s].wanted_tokens) <= longest
        assert abs(rows[s].reached_share - share) < 0.02
    assert max(r.copies for r in got if r.source == "a") == 1  # enough tokens: nothing twice


def test_a_given_total_is_capped_by_the_repeats(spark):
    docs = documents(spark, {"a": 100, "b": 10})
    mixture, shares = mix_sources(docs, targets(spark, ("a", 0.5, 1), ("b", 0.5, 2)), total_tokens=1000)
    rows = {r.source: r for r in shares.collect()}
    assert rows["b"].reached_tokens == 2 * rows["b"].available_tokens < 500
    assert abs(rows["a"].reached_tokens - 500) <= 45
    again, _ = mix_sources(docs, targets(spark, ("a", 0.5, 1), ("b", 0.5, 2)), total_tokens=1000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixture.collect()))


def test_empty_sources(spark):
    docs = documents(spark, {"a": 20})
    _, shares = mix_sources(docs, targets(spark, ("a", 0.4, 1), ("c", 0.6, 3)))
    rows = {r.source: r for r in shares.collect()}
    assert rows["c"].reached_share == 0 and rows["a"].reached_share == 1 and rows["a"].reached_tokens == rows["a"].available_tokens
    mixture, shares = mix_sources(docs.limit(0), targets(spark, ("a", 1.0, 1)))
    assert mixture.count() == 0 and shares.first().reached_tokens == 0
    mixture, shares = mix_sources(docs, targets(spark).limit(0))
    assert mixture.count() == shares.count() == 0


def solved(tokens, source, domain, cap, targets):
    """The rates from sums over arrays in place of a table."""
    have = np.bincount(source, tokens, len(targets))
    start = np.minimum(cap, targets / have)

    def sums(steps):
        x = rates_after(steps, start, cap, source, domain)
        free = (x > 0) & (x < cap[source])
        return Sums(np.bincount(source, tokens * x, len(targets)), np.bincount(source, tokens * free, len(targets)), (tokens * x) @ domain)

    return rates_after(solve_rates(sums, tokens @ domain, targets), start, cap, source, domain)


def test_rates_meet_sources_and_lean_to_domains():
    tokens, source = np.array([100.0, 100, 100, 100]), np.array([0, 0, 1, 1])
    domain = np.array([[1, 0], [0, 1], [0, 1], [0.5, 0.5]])
    rates = solved(tokens, source, domain, np.full(2, 2.0), np.array([120.0, 80.0]))
    assert np.allclose([(rates * tokens)[source == s].sum() for s in (0, 1)], [120, 80], atol=0.1)
    assert rates.min() >= 0 and rates.max() <= 2 and rates[0] > rates[1]


def test_the_gradient_brings_domains_nearer_to_their_targets():
    rng = np.random.default_rng(3)
    n, k = 3000, 4
    source, tokens = rng.choice(k, n, p=[0.7, 0.2, 0.07, 0.03]), rng.integers(1, 60, n).astype(float)
    domain = rng.dirichlet(np.full(k, 0.3), n) * 0.5 + 0.5 * np.eye(k)[(source + (rng.random(n) < 0.3)) % k]
    targets, cap = np.array([9000.0, 7000, 3000, 1500]), np.array([1.0, 1, 2, 3])
    rates = solved(tokens, source, domain, cap, targets)
    even = np.minimum(cap, targets / np.bincount(source, tokens, k))[source]
    error = lambda x: np.square((tokens * x) @ domain - targets).sum()
    assert np.allclose(np.bincount(source, tokens * rates, k), targets, rtol=1e-3) and error(rates) < 0.5 * error(even)
    assert (rates >= 0).all() and (rates <= cap[source]).all()


def test_filling_is_a_prefix_of_the_order(spark):
    rng = random.Random(8)
    room = {0: 500, 1: 0, 2: 10**9, 3: 77}
    rows = [(s, rng.choice([rng.random(), 0.5, 0.5000001]), i, rng.randint(0, 9), room[s]) for i in range(800) for s in (rng.randrange(4),)]
    got = {r.doc_id for r in fill(spark.createDataFrame(rows, "s int, key double, doc_id int, grow bigint, room bigint")).where("more").collect()}
    want, filled = set(), dict.fromkeys(room, 0)
    for s, _, i, grow, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        filled[s] += grow
        if grow and filled[s] - grow / 2 < room[s]:
            want.add(i)
    assert got == want


def test_posteriors():
    model = np.log(np.array([[0.9, 0.1], [0.1, 0.9]]))
    model = np.repeat(model, 2048, axis=1)
    assert np.isclose(posteriors([1, 2, 3], model).sum(), 1) and posteriors([1, 2, 3], model)[0] > 0.99
    assert list(posteriors([], model)) == [0.5, 0.5]
