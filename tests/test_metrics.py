from graphs import DUPS, FOUR, THREE, cut_of, make, sides
from pyspark.sql import functions as F

from pinloom.model import Hypergraph, clean_pins
from pinloom.operators import coarsen, metrics, moves, simplify
from pinloom.operators.balance import assign_free, bisect_random, free_quota
from pinloom.functions import bisection_limits, max_part_weight


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_cut_of_a_small_graph(spark):
    h = make(spark, THREE, 3)
    assert tuple(metrics.cut_sizes(h.pins, sides(spark, [0, 1, 1]), h.nets).first()) == (2, 2)
    assert rows(metrics.net_counts(h.pins, sides(spark, [0, 1, 1])), "net_id") == [(0, 1, 1), (1, 1, 1)]
    assert rows(metrics.net_counts(h.pins, sides(spark, [1, 0, 1])), "net_id") == [(0, 0, 2), (1, 1, 1)]


def test_gains_and_starts(spark):
    h = make(spark, THREE, 3)
    gains = {r[0]: r[2] for r in metrics.move_gains(h.pins, sides(spark, [0, 1, 0]), h.nets).collect()}
    assert gains == {0: 0, 1: 1, 2: -1}
    assert [r[1] for r in rows(metrics.kstart(h.pins, sides(spark, [0, 1, 0]), 2), "position")] == [0, 3, 4]


def test_gain_is_the_fall_of_the_cut(spark):
    pins = [(n, v) for n in range(12) for v in range(8) if (n * 7 + v * 5) % 3 == 0]
    part = [v % 2 for v in range(8)]
    h = make(spark, pins, 8)
    for v, _, gain in metrics.move_gains(h.pins, sides(spark, part), h.nets).collect():
        moved = [1 - p if u == v else p for u, p in enumerate(part)]
        assert gain == cut_of(pins, part) - cut_of(pins, moved)


def test_free_vertices_and_their_assignment(spark):
    h = make(spark, FOUR, 4)
    pins = simplify.drop_small_nets(h.pins, 1)
    free = simplify.free_vertices(h.vertices, pins)
    assert [r[0] for r in rows(free.select("vertex_id"))] == [3]
    quota = free_quota(2, 1, 3, 3, 1)
    assert [tuple(r) for r in assign_free(free, quota).collect()] == [(3, 1)]


def test_duplicate_nets(spark):
    merged, mapping = simplify.merge_duplicate_nets(make(spark, DUPS, 4))
    assert rows(merged.nets, "net_id") == [(1, 2), (2, 1), (4, 2)]
    assert rows(mapping, "net_id") == [(0, 1), (1, 1), (2, 2), (3, 4), (4, 4)]


def test_rejection_of_unbalancing_moves(spark):
    log = [(0, 0, 5, -3), (0, 1, 3, -4), (0, 2, 1, 3), (0, 3, -2, -1), (0, 4, -2, 2), (1, 0, 5, -1), (1, 1, 4, -2), (1, 2, 2, -3), (1, 3, 1, 4), (1, 4, -5, 0)]
    df = spark.createDataFrame([(s, t, 10 * s + t, g, d) for s, t, g, d in log], "shard int, tag bigint, vertex_id bigint, gain bigint, dw bigint")
    judged = moves.reject_unbalanced(df, 20, 18, 22, 22)
    assert [(r.shard, r.tag) for r in judged.where("rejected").collect()] == [(0, 3)]
    assert judged.count() == 10
    kept = judged.where("not rejected").agg(F.sum("dw")).first()[0]
    assert 20 + kept <= 22 and 18 - kept <= 22


def test_best_prefix_takes_the_longest_of_equals(spark):
    df = spark.createDataFrame([(0, i, i, g, 0) for i, g in enumerate([1, -2, 1, 1, -3, 3, -9])], "shard int, tag bigint, vertex_id bigint, gain bigint, dw bigint")
    assert tuple(moves.best_prefix(df).first()) == (6, 1)
    assert tuple(moves.best_prefix(df.where("tag > 90")).first()) == (0, 0)


def test_limits():
    assert max_part_weight(318, 2, 0.03) == 163 and max_part_weight(318, 7, 0.1) == 49
    assert bisection_limits(2, 1, 1, 318, 163) == (163, 163)
    assert bisection_limits(7, 3, 4, 318, 49) == (141, 186)
    assert bisection_limits(3, 1, 2, 318, 109) == (109, 215)
    assert bisection_limits(4, 2, 2, 318, 81) == (160, 160)
    assert bisection_limits(2, 1, 1, 62, 31) == (31, 31)
    assert bisection_limits(2, 1, 1, 0, 0)[0] == 0


def test_random_sides_keep_their_limits(spark):
    h = make(spark, THREE, 200, weights=[1 + v % 3 for v in range(200)])
    total = sum(1 + v % 3 for v in range(200))
    limit = max_part_weight(total, 2, 0.1)
    got = {r[0]: r[1] for r in bisect_random(h.vertices, limit, limit).collect()}
    load = [sum(1 + v % 3 for v, p in got.items() if p == s) for s in (0, 1)]
    assert len(got) == 200 and max(load) <= limit


def test_contraction_keeps_weight_and_projection_keeps_the_cut(spark):
    pins = [(n, v) for n in range(20) for v in range(12) if (n * 5 + v * 7) % 4 == 0]
    h = make(spark, pins, 12, weights=list(range(1, 13)))
    matches = spark.createDataFrame([(1, 0), (2, 0), (7, 6)], "child_id bigint, parent_id bigint")
    coarse = coarsen.contract(h, matches)
    assert coarse.vertices.agg(F.sum("weight")).first()[0] == 78
    labels = coarse.vertices.select("vertex_id", (F.col("vertex_id") % 2).alias("part"))
    fine = coarsen.project_labels(h.vertices, matches, labels)
    assert fine.count() == 12
    assert metrics.cut_sizes(coarse.pins, labels, h.nets).first() == metrics.cut_sizes(h.pins, fine, h.nets).first()


def test_dirty_and_empty_tables(spark):
    pins = spark.createDataFrame([(1, 2, "x"), (1, 2, "x"), (None, 2, "y"), (3, None, None)], "net_id bigint, vertex_id bigint, part string")
    assert rows(clean_pins(pins)) == [(1, 2)]
    empty = Hypergraph.from_tables(pins.limit(0), spark.createDataFrame([], "vertex_id bigint, weight bigint, part bigint"), spark.createDataFrame([], "net_id bigint, cost bigint, size bigint"))
    assert tuple(metrics.cut_sizes(empty.pins, empty.vertices, empty.nets).first()) == (0, 0)
    assert metrics.load_balance(empty.vertices, 2).first()["imbalance"] == 0
    assert simplify.duplicate_nets(empty.pins).count() == 0
    assert metrics.move_gains(empty.pins, empty.vertices, empty.nets).count() == 0
    assert metrics.check_incidence(empty).count() == 0


def test_set_maintenance(spark):
    h = make(spark, FOUR, 4)
    gone = spark.createDataFrame([(0,)], "net_id bigint")
    assert rows(simplify.remove_nets(h, gone).pins) == [(1, 0), (1, 1), (2, 3)]
    more = simplify.add_vertices(h, spark.createDataFrame([(3, 9, None), (4, 2, None), (4, 2, None)], "vertex_id bigint, weight bigint, part bigint"))
    assert rows(more.vertices.select("vertex_id", "weight")) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 2)]
    sub = simplify.induced_subgraph(h, spark.createDataFrame([(0,), (2,), (3,)], "vertex_id bigint"))
    assert rows(sub.pins) == [(0, 0), (0, 2)]
