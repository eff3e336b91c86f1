"""Sizes, weights, cuts and gains.

`labels` is any DataFrame with (vertex_id, part); pins of vertices without a part count for nothing. All
aggregations combine on the map side, so a hot net or vertex costs one row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pinloom.model import Hypergraph
from pinloom.options import Metric


def net_sizes(pins: DataFrame) -> DataFrame:
    """(net_id, size): pins of each net."""
    return pins.groupBy("net_id").agg(F.count(F.lit(1)).alias("size"))


def vertex_degrees(vertices: DataFrame, pins: DataFrame) -> DataFrame:
    """(vertex_id, weight): nets of each vertex, 0 for a vertex without pins."""
    degree = pins.groupBy("vertex_id").agg(F.count(F.lit(1)).alias("degree"))
    return vertices.select("vertex_id").join(degree, "vertex_id", "left").select(
        "vertex_id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("weight")
    )


def part_weights(vertices: DataFrame, k: int) -> DataFrame:
    """(part, weight) for every part 0..k-1, 0 where a part is empty. A part outside that range is left out."""
    sums = vertices.where(F.col("part").between(0, k - 1)).groupBy("part").agg(F.sum("weight").alias("weight"))
    spine = vertices.sparkSession.range(k).select(F.col("id").alias("part"))
    return spine.join(sums, "part", "left").select("part", F.coalesce("weight", F.lit(0)).cast("bigint").alias("weight"))


def load_balance(vertices: DataFrame, k: int) -> DataFrame:
    """One row (max_weight, total_weight, imbalance): max part weight * k / total - 1; 0 where nothing has weight."""
    return part_weights(vertices, k).agg(
        F.max("weight").alias("max_weight"), F.sum("weight").alias("total_weight")
    ).withColumn("imbalance", F.when(F.col("total_weight") > 0, F.round(F.col("max_weight") * k / F.col("total_weight") - 1, 9)).otherwise(F.lit(0.0)))


def pin_labels(pins: DataFrame, labels: DataFrame) -> DataFrame:
    """(net_id, vertex_id, part): the part of each pin's vertex."""
    return pins.join(labels.where("part is not null").select("vertex_id", "part"), "vertex_id").select("net_id", "vertex_id", "part")


def net_counts(pins: DataFrame, sides: DataFrame) -> DataFrame:
    """(net_id, c0, c1): pins of each net on either side of a bisection."""
    return pin_labels(pins, sides).groupBy("net_id").agg(
        F.count_if(F.col("part") == 0).alias("c0"), F.count_if(F.col("part") == 1).alias("c1")
    )


def connectivity(pins: DataFrame, labels: DataFrame) -> DataFrame:
    """(net_id, connectivity): number of parts that a net touches."""
    return pin_labels(pins, labels).groupBy("net_id", "part").agg(F.lit(1).alias("one")).groupBy("net_id").agg(
        F.count(F.lit(1)).alias("connectivity")
    )


def cut_nets(pins: DataFrame, labels: DataFrame) -> DataFrame:
    """(net_id, connectivity) of the nets that touch more than one part."""
    return connectivity(pins, labels).where("connectivity > 1")


def cut_sizes(pins: DataFrame, labels: DataFrame, nets: DataFrame) -> DataFrame:
    """One row (cutnet, lambda_minus_one): the summed cost of cut nets, and of connectivity - 1 times cost."""
    return cut_nets(pins, labels).join(nets.select("net_id", "cost"), "net_id").agg(
        F.coalesce(F.sum("cost"), F.lit(0)).cast("bigint").alias("cutnet"),
        F.coalesce(F.sum((F.col("connectivity") - 1) * F.col("cost")), F.lit(0)).cast("bigint").alias("lambda_minus_one"),
    )


def cut_size(h: Hypergraph, labels: DataFrame, metric: Metric) -> int:
    row = cut_sizes(h.pins, labels, h.nets).first()
    return int(row[metric.value])


def cut_from_counts(counts: DataFrame, nets: DataFrame) -> DataFrame:
    """One row (cut): the summed cost of the nets with pins on both sides."""
    return counts.where("c0 > 0 and c1 > 0").join(nets.select("net_id", "cost"), "net_id").agg(
        F.coalesce(F.sum("cost"), F.lit(0)).cast("bigint").alias("cut")
    )


def move_gains(pins: DataFrame, sides: DataFrame, nets: DataFrame) -> DataFrame:
    """(vertex_id, part, gain): how much the cut falls if the vertex alone changes its side.

    A net that its vertex would leave behind uncut counts its cost, a net that is uncut now counts it negatively;
    nets of one pin count nothing.
    """
    counts = net_counts(pins, sides).where("c0 + c1 > 1").join(nets.select("net_id", "cost"), "net_id")
    here, there = (F.when(F.col("part") == side, F.col("c0")).otherwise(F.col("c1")) for side in (0, 1))
    gain = F.when(here == 1, F.col("cost")).otherwise(0) - F.when(there == 0, F.col("cost")).otherwise(0)
    sums = pin_labels(pins, sides).join(counts, "net_id").groupBy("vertex_id").agg(F.sum(gain).alias("gain"))
    return sides.where("part is not null").select("vertex_id", "part").join(sums, "vertex_id", "left").select(
        "vertex_id", "part", F.coalesce("gain", F.lit(0)).cast("bigint").alias("gain")
    )


def kstart(pins: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(position, start): for 0..k the number of pins in lower parts; position k holds all pins.

    The window runs over k + 1 rows, whatever the number of pins.
    """
    counts = pin_labels(pins, labels).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    spine = pins.sparkSession.range(k + 1).select(F.col("id").alias("position"))
    before = spine.join(counts.select((F.col("part") + 1).alias("position"), "n"), "position", "left")
    running = F.sum(F.coalesce("n", F.lit(0))).over(W.orderBy("position").rowsBetween(W.unboundedPreceding, 0))
    return before.select("position", running.cast("bigint").alias("start"))


def check_incidence(h: Hypergraph) -> DataFrame:
    """(kind, id) of pins whose net or vertex is unknown; an intact hypergraph gives no row."""
    lost_nets = h.pins.select("net_id").distinct().join(h.nets, "net_id", "left_anti").select(F.lit("net").alias("kind"), F.col("net_id").alias("id"))
    lost_vertices = h.pins.select("vertex_id").distinct().join(h.vertices, "vertex_id", "left_anti")
    return lost_nets.unionByName(lost_vertices.select(F.lit("vertex").alias("kind"), F.col("vertex_id").alias("id")))


def quality_report(h: Hypergraph, k: int) -> DataFrame:
    """One row (k, n_vertices, n_pins, imbalance, cutnet, lambda_minus_one, part_weights)."""
    weights = part_weights(h.vertices, k).agg(F.array_sort(F.collect_list(F.struct("part", "weight"))).alias("w"))
    return (
        h.vertices.agg(F.count(F.lit(1)).alias("n_vertices"))
        .join(h.pins.agg(F.count(F.lit(1)).alias("n_pins")))
        .join(load_balance(h.vertices, k).select("imbalance"))
        .join(cut_sizes(h.pins, h.vertices, h.nets))
        .join(weights)
        .select(F.lit(k).alias("k"), "n_vertices", "n_pins", "imbalance", "cutnet", "lambda_minus_one", F.expr("array_join(transform(w, x -> cast(x.weight as string)), ',')").alias("part_weights"))
    )


def gain_range(h: Hypergraph) -> DataFrame:
    """One row (most): the greatest summed net cost of a vertex; every gain lies between -most and most."""
    sums = h.pins.join(h.nets, "net_id").groupBy("vertex_id").agg(F.sum("cost").alias("w"))
    return sums.agg(F.coalesce(F.max("w"), F.lit(0)).cast("bigint").alias("most"))
