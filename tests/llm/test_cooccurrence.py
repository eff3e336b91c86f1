import math
import random
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest

from pinloom.llm.cooccurrence import HALF, _codes, _sum_runs, cooccurrence
from pinloom.llm.queries import QUERIES


def baskets(seed=4):
    rng = random.Random(seed)
    out = {b: {rng.choice([1, 2, 3, rng.randrange(40), rng.randrange(40)]) for _ in range(rng.randint(1, 9))} for b in range(300)}
    out[1000] = set(range(200))
    return out


def frame(spark):
    rows = [(b, i, "x") for b, s in baskets().items() for i in s] * 2 + [(None, 1, "y"), (5, None, "z")]
    return spark.createDataFrame(rows, "basket bigint, item bigint, n string").repartition(3)


def brute(most):
    small = [s for s in baskets().values() if len(s) <= most]
    single, both = Counter(i for s in small for i in s), Counter(p for s in small for p in combinations(sorted(s), 2))
    return {p: (c, single[p[0]], single[p[1]], len(small)) for p, c in both.items()}


def test_counts_and_ratios(spark):
    got = {(r.item_a, r.item_b): r for r in cooccurrence(frame(spark), 64).collect()}
    want = brute(64)
    assert {k: (r.n_ab, r.n_a, r.n_b, r.baskets) for k, r in got.items()} == want
    for k, (ab, a, b, n) in want.items():
        assert math.isclose(got[k]["lift"], ab * n / (a * b), abs_tol=1e-8)
        assert math.isclose(got[k]["log_odds"], math.log((ab + 0.5) * (n - a - b + ab + 0.5) / ((a - ab + 0.5) * (b - ab + 0.5))), abs_tol=1e-8)


def test_pruning_is_exact(spark):
    got = {(r.item_a, r.item_b) for r in cooccurrence(frame(spark), 64, 3, 2).collect()}
    assert got == {p for p, (ab, a, b, n) in brute(64).items() if ab >= 3 and ab * n >= 2 * a * b} and got


@pytest.mark.parametrize("threshold,partitions,adaptive", [("-1", "64", "true"), ("-1", "4", "true"), ("-1", "64", "false"), ("10485760", "64", "true")])
def test_items_are_numbered_alike_at_every_use(spark, threshold, partitions, adaptive):
    """Without broadcasts, and with partitions that adaptive execution merges differently in each join."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": threshold, "spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.enabled": adaptive,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    rng = random.Random(9)
    rows = [(b, rng.randrange(50) if rng.random() < 0.3 else rng.randrange(6000)) for b in range(4000) for _ in range(6)]
    sets = {}
    for b, i in rows:
        sets.setdefault(b, set()).add(i)
    want = Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {(r.item_a, r.item_b): r.n_ab for r in cooccurrence(spark.createDataFrame(rows, "basket bigint, item bigint"), 64, 2).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {p: n for p, n in want.items() if n >= 2}


def test_no_numbering_is_left_to_later_executions(spark):
    plan = cooccurrence(frame(spark), 64)._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" not in plan and "SPARK_PARTITION_ID" not in plan.upper()


def test_no_baskets(spark):
    assert cooccurrence(frame(spark).limit(0), 64).count() == 0
    assert cooccurrence(frame(spark).where("basket = 1000"), 64).count() == 0


def test_sums_go_across_batches():
    batch = lambda *rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["code", "n"])
    out = [tuple(r.values()) for b in _sum_runs(iter([batch((1, 1), (2, 1)), batch(), batch((2, 4)), batch((2, 1), (3, 2))])) for r in b.to_pylist()]
    assert out == [(1, 1), (2, 6), (3, 2)] and list(_sum_runs(iter([]))) == []
    lists = pa.RecordBatch.from_arrays([pa.array([[3, 1], [1, 2, 3], [7]], pa.list_(pa.int64()))], names=["numbers"])
    assert [tuple(r.values()) for b in _codes(iter([lists])) for r in b.to_pylist()] == [(HALF + 2, 1), (HALF + 3, 2), (2 * HALF + 3, 1)]


def test_registered_pairs_include_those_of_one_net(spark, tmp_path):
    rows = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 2), (2, 3)]
    spark.createDataFrame(rows, "net_id bigint, vertex_id bigint").write.parquet(f"{tmp_path}/pins.parquet")
    got = {(r.vertex_a, r.vertex_b): (r.n_ab, r.n_a, r.n_b, r.baskets, r.lift) for r in QUERIES["p3_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2): (1, 1, 3, 3, 1.0), (2, 3): (2, 3, 2, 3, 1.0)}
