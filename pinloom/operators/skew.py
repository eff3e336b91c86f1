"""Per-key results and joins when a few keys hold most of the rows.

Heavy keys are found with a frequent-items sketch (`approx_top_k`), which runs as an ordinary aggregate: each task
sends one sketch of bounded size. The sketch keeps `tracked` counters, so a key with more than about 4 / tracked of
all rows is never missed, and at most `tracked / 4` keys are taken as heavy: that many rows, whatever the input, is
what gets broadcast. Heavy keys then never travel in a key-partitioned shuffle of raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinloom.model import clean_pins

TRACKED = 4096


def heavy_keys(df: DataFrame, key: str, share: float = 0.001, tracked: int = TRACKED) -> DataFrame:
    """(key, estimate) of the keys that may hold at least `share` of the rows; nulls are no key.

    Complete for `share` of at least 4 / tracked: the sketch's counts err by less than that share of the rows, and
    the error is allowed for. At most min(tracked / 4, 2 / share) + 1 rows, so the result is safe to broadcast.
    """
    if share * tracked < 4:
        raise ValueError("share must be at least 4 / tracked")
    top = int(min(tracked // 4, 2 / share)) + 1
    sketch = df.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {top}, {tracked})").alias("items"), F.count(F.lit(1)).alias("rows")
    )
    return sketch.select(F.explode("items").alias("i"), "rows").where(F.col("i.count") >= F.col("rows") * (share / 2)).select(
        F.col("i.item").alias(key), F.col("i.count").alias("estimate")
    )


def skew_join(facts: DataFrame, dim: DataFrame, key: str, how: str = "inner", heavy: DataFrame | None = None) -> DataFrame:
    """`facts` join `dim` on `key` where a few keys may hold most facts; `dim` must have each key at most once.

    Rows of heavy keys meet a broadcast of those keys' rows of `dim`, which are at most as many as heavy keys; they
    stay where they are. The rest goes through an ordinary shuffle join. The branches are disjoint and their union
    is the whole join. `how` is "inner" or "left"; a null key matches nothing and, with "left", is kept.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    heavy = (heavy_keys(facts, key) if heavy is None else heavy).select(key)
    hot = F.broadcast(heavy.withColumn("_hot", F.lit(True)))
    marked = facts.join(hot, key, "left")
    dim_hot = dim.join(F.broadcast(heavy), key, "left_semi")
    few = marked.where("_hot").drop("_hot").join(F.broadcast(dim_hot), key, how)
    rest = marked.where("_hot is null").drop("_hot").join(dim, key, how)
    return few.unionByName(rest)


def per_key(facts: DataFrame, key: str, aggs: Sequence[Column], merge: Sequence[Column], salt: str, heavy: DataFrame | None = None, salts: int = 64) -> DataFrame:
    """`facts.groupBy(key)` where a few keys may hold most facts.

    Heavy keys are aggregated in `salts` slices (by a hash of column `salt`) with `aggs`, and the slices are merged
    with `merge`; `merge[i]` combines the values of `aggs[i]` and bears its final name. Other keys are grouped by an
    ordinary shuffle. A null key is no key.
    """
    heavy = (heavy_keys(facts, key) if heavy is None else heavy).select(key)
    marked = facts.where(F.col(key).isNotNull()).join(F.broadcast(heavy.withColumn("_hot", F.lit(True))), key, "left")
    few = marked.where("_hot").groupBy(key, F.pmod(F.xxhash64(salt), F.lit(salts)).alias("_slice")).agg(*aggs).groupBy(key).agg(*merge)
    rest = marked.where("_hot is null").groupBy(key).agg(*aggs).groupBy(key).agg(*merge)
    return few.unionByName(rest)


def frequent_keys(pins: DataFrame, share: float = 0.01, tracked: int = TRACKED) -> DataFrame:
    """(side, key_id, pins): nets and vertices that hold at least `share` of all distinct pins.

    One pass makes both sketches and the total; they name a bounded set of candidates, which a broadcast join counts
    exactly over the distinct pins (the shuffle that made them distinct is reused), and that count decides.
    """
    if share * tracked < 4:
        raise ValueError("share must be at least 4 / tracked")
    distinct = clean_pins(pins)
    top = int(min(tracked // 4, 2 / share)) + 1
    items = [F.expr(f"approx_top_k({key}, {top}, {tracked})").alias(key) for key in ("net_id", "vertex_id")]
    sketch = distinct.agg(*items, F.count(F.lit(1)).alias("total"))
    out = None
    for side, key in (("net", "net_id"), ("vertex", "vertex_id")):
        candidates = sketch.select(F.explode(key).alias("i"), "total").where(F.col("i.count") >= F.col("total") * (share / 2)).select(F.col("i.item").alias(key), "total")
        exact = distinct.join(F.broadcast(candidates), key).groupBy(key, "total").agg(F.count(F.lit(1)).alias("pins"))
        found = exact.where(F.col("pins") / F.col("total") >= share - 1e-12).select(F.lit(side).alias("side"), F.col(key).alias("key_id"), "pins")
        out = found if out is None else out.unionByName(found)
    return out


def net_profile(pins: DataFrame, vertices: DataFrame, nets: DataFrame) -> DataFrame:
    """(net_id, size, weight, parts, cost) of every net that has a pin; all from distinct pins.

    weight: summed weight of the net's vertices, an unknown vertex or a null weight counting 0. parts: distinct
    parts of its vertices. cost: null if the net is unknown or its cost is. Hot vertices meet their weights by
    broadcast, hot nets are aggregated in slices.
    """
    facts = skew_join(clean_pins(pins), _unique(vertices, "vertex_id", "weight", "part"), "vertex_id", "left")
    aggs = [F.count(F.lit(1)).alias("size"), F.sum(F.coalesce("weight", F.lit(0))).alias("weight"), F.collect_set("part").alias("parts")]
    merge = [
        F.sum("size").alias("size"), F.sum("weight").cast("bigint").alias("weight"),
        F.size(F.array_distinct(F.flatten(F.collect_list("parts")))).cast("bigint").alias("parts"),
    ]
    profile = per_key(facts, "net_id", aggs, merge, "vertex_id")
    return profile.join(_unique(nets, "net_id", "cost"), "net_id", "left")


def vertex_profile(pins: DataFrame, vertices: DataFrame, nets: DataFrame) -> DataFrame:
    """(vertex_id, degree, cost, max_cost, weight) of every vertex that has a pin; all from distinct pins.

    cost and max_cost: sum and maximum of the costs of the vertex's nets, an unknown net or a null cost counting 1.
    weight: null if the vertex is unknown or its weight is.
    """
    facts = skew_join(clean_pins(pins), _unique(nets, "net_id", "cost"), "net_id", "left")
    cost = F.coalesce("cost", F.lit(1))
    aggs = [F.count(F.lit(1)).alias("degree"), F.sum(cost).alias("cost"), F.max(cost).cast("bigint").alias("max_cost")]
    merge = [F.sum("degree").alias("degree"), F.sum("cost").cast("bigint").alias("cost"), F.max("max_cost").alias("max_cost")]
    return per_key(facts, "vertex_id", aggs, merge, "net_id").join(_unique(vertices, "vertex_id", "weight"), "vertex_id", "left")


def _unique(dim: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row for each key: where a key is repeated, the smallest values in order of the columns, nulls first."""
    row = F.min(F.struct(*columns)).alias("r")
    return dim.where(F.col(key).isNotNull()).groupBy(key).agg(row).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])
