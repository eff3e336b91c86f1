import random
from collections import Counter, defaultdict

import pytest

from pinloom.operators.skew import frequent_keys, heavy_keys, net_profile, per_key, skew_join, vertex_profile
from pyspark.sql import functions as F


def skewed(n=6000, seed=2):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        net = 7 if rng.random() < 0.34 else None if rng.random() < 0.02 else rng.randrange(900)
        vertex = 3 if rng.random() < 0.1 else None if rng.random() < 0.02 else rng.randrange(2500)
        out += [(net, vertex)] * (3 if rng.random() < 0.1 else 1)
    return out


@pytest.fixture(scope="module")
def pins(spark):
    return spark.createDataFrame(skewed(), "net_id bigint, vertex_id bigint").repartition(4)


def truth():
    return {(a, b) for a, b in skewed() if a is not None and b is not None}


def test_frequent_keys_are_exact(pins):
    distinct = truth()
    want = set()
    for side, i in (("net", 0), ("vertex", 1)):
        want |= {(side, k, c) for k, c in Counter(p[i] for p in distinct).items() if c * 100 >= len(distinct)}
    assert {tuple(r) for r in frequent_keys(pins).collect()} == want and want


def test_heavy_keys_miss_none(pins):
    counts = Counter(a for a, _ in skewed() if a is not None)
    total = sum(counts.values())
    found = {r[0] for r in heavy_keys(pins, "net_id", 0.01).collect()}
    assert {k for k, c in counts.items() if c >= 0.01 * total} <= found
    assert heavy_keys(pins.limit(0), "net_id").count() == 0
    with pytest.raises(ValueError):
        heavy_keys(pins, "net_id", 1e-6)


def test_skew_join_is_a_join(spark, pins):
    dim = spark.createDataFrame([(k, k * 10) for k in range(0, 900, 2)] + [(7, 70)], "net_id bigint, x bigint")
    for how in ("inner", "left"):
        mine, plain = skew_join(pins, dim, "net_id", how), pins.join(dim, "net_id", how)
        assert Counter(map(tuple, mine.select("net_id", "vertex_id", "x").collect())) == Counter(map(tuple, plain.select("net_id", "vertex_id", "x").collect()))


def test_per_key_is_a_group_by(pins):
    mine = per_key(pins, "net_id", [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n")], "vertex_id")
    assert {tuple(r) for r in mine.collect()} == {(k, c) for k, c in Counter(a for a, _ in skewed() if a is not None).items()}


def test_profiles(spark, pins):
    vertices = spark.createDataFrame([(v, v % 9 + 1 if v % 7 else None, v % 4 if v % 5 else None) for v in range(2400)] + [(3, 1, 1)], "vertex_id bigint, weight bigint, part bigint")
    nets = spark.createDataFrame([(n, n % 6 + 1 if n % 10 else None, 0) for n in range(880)], "net_id bigint, cost bigint, size bigint")
    members = defaultdict(set)
    held = defaultdict(set)
    for a, b in truth():
        members[a].add(b)
        held[b].add(a)
    weight = {v: (v % 9 + 1 if v % 7 else 0) for v in range(2400)} | {3: 1}
    part = {v: v % 4 if v % 5 else None for v in range(2400)} | {3: 1}
    cost = {n: n % 6 + 1 if n % 10 else None for n in range(880)}
    got = {r.net_id: (r.size, r.weight, r.parts, r.cost) for r in net_profile(pins, vertices, nets).collect()}
    assert got == {n: (len(vs), sum(weight.get(v, 0) for v in vs), len({part.get(v) for v in vs} - {None}), cost.get(n)) for n, vs in members.items()}
    got = {r.vertex_id: (r.degree, r.cost, r.max_cost) for r in vertex_profile(pins, vertices, nets).collect()}
    assert got == {v: (len(ns), sum(cost.get(n) or 1 for n in ns), max(cost.get(n) or 1 for n in ns)) for v, ns in held.items()}


def test_empty_tables(spark, pins):
    none = pins.limit(0)
    v = spark.createDataFrame([], "vertex_id bigint, weight bigint, part bigint")
    n = spark.createDataFrame([], "net_id bigint, cost bigint, size bigint")
    assert net_profile(none, v, n).count() == vertex_profile(none, v, n).count() == frequent_keys(none).count() == 0
