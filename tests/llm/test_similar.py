import random
from fractions import Fraction
from itertools import combinations

import pytest

from pinloom.llm.similar import least_agreement, record_links, similar_classes, similar_pairs, trees_for


def sets_of(n=260, seed=5):
    """Records around common cores, with hot values that most hold, exact copies and one very large pair."""
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        core = rng.randrange(60)
        values = {core * 100 + j for j in range(rng.randint(3, 9)) if rng.random() < 0.93}
        values |= {v for v in (1_000_001, 1_000_002, 1_000_003, 1_000_004, 1_000_005) if rng.random() < 0.5}
        if rng.random() < 0.1:
            values = {1_000_001, 1_000_002, 1_000_003, 1_000_004, 1_000_005} - {1_000_001 + rng.randrange(5)}
        out[i * 3] = values
    out[9000], out[9001] = set(range(5000, 5600)), set(range(5040, 5600))
    return out


def brute(sets, threshold, least):
    t = Fraction(threshold).limit_denominator(1000)
    return {(a, b) for a, b in combinations(sorted(k for k, s in sets.items() if len(s) >= least), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def frame(spark, sets, extra=()):
    rows = [(i, v, "x") for i, s in sets.items() for v in s] * 2 + [(None, 1, "y"), (2, None, "z"), *extra]
    return spark.createDataFrame(rows, "id bigint, value bigint, label string").repartition(3)


@pytest.mark.parametrize("threshold,least", [(0.7, 4), (0.5, 1)])
def test_all_pairs_are_found(spark, threshold, least):
    sets = sets_of()
    got = [tuple(r) for r in similar_pairs(frame(spark, sets), threshold, least, frequent=40, large=300, miss=1e-6).collect()]
    want = brute(sets, threshold, least)
    assert len(got) == len(set(got)) and set(got) == want and (9000, 9001) in want


def test_links_count_the_pairs(spark):
    sets = sets_of(seed=8)
    want = brute(sets, 0.7, 4)
    got = {r.id: (r.class_id, r.links) for r in record_links(frame(spark, sets), 0.7, 4, frequent=40, miss=1e-6).collect()}
    assert set(got) == {k for k, s in sets.items() if len(s) >= 4}
    for k, (c, links) in got.items():
        assert sets[c] == sets[k] and c <= k and links == sum(k in p for p in want)


def test_empty_and_blank(spark):
    none = spark.createDataFrame([], "id bigint, value bigint")
    classes, similar = similar_classes(none, 0.7)
    assert classes.count() == similar.count() == 0
    nulls = spark.createDataFrame([(None, 1), (1, None)], "id bigint, value bigint")
    assert similar_pairs(nulls, 0.7).count() == 0


def test_agreement_is_a_bound():
    """The bound against the exact probability over all partners of small records, and against sampled orders."""
    t = Fraction(7, 10)
    for n in range(4, 12):
        for p in range(0, n):
            bound = least_agreement(n, p, t, 4)
            for shared in range(1, n + 1):
                for other in range(0, 12):
                    union = n + other
                    if shared + other < 4 or shared < t * union or (shared, union) == (n, n):
                        continue
                    rare = max(0, shared - p)
                    assert bound <= (rare / (rare + union - shared) if rare else 0) + 1e-12
    assert trees_for(5, 0, t, 4, 1e-4, 64) < trees_for(5, 3, t, 4, 1e-4, 64) <= 64 < trees_for(5, 5, t, 4, 1e-4, 64)
