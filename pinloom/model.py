"""The hypergraph as three DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hypergraph:
    """`vertices(vertex_id, weight, part)`, `nets(net_id, cost)`, `pins(net_id, vertex_id)`; pins are distinct and not null.

    Net sizes and vertex degrees are never stored: they are always counted from `pins`.
    """

    vertices: DataFrame
    nets: DataFrame
    pins: DataFrame

    @classmethod
    def from_tables(cls, pins: DataFrame, vertices: DataFrame, nets: DataFrame) -> "Hypergraph":
        """From dirty feeds: rows with a null key are dropped, repeated pins count once, a missing weight or cost is 1."""
        return cls(
            vertices.where("vertex_id is not null").select(
                "vertex_id", F.coalesce("weight", F.lit(1).cast("bigint")).alias("weight"), "part"
            ),
            nets.where("net_id is not null").select("net_id", F.coalesce("cost", F.lit(1).cast("bigint")).alias("cost")),
            clean_pins(pins),
        )

    @classmethod
    def from_pairs(cls, pairs: DataFrame, net: str | Column, vertex: str | Column, degree_weights: bool = True) -> "Hypergraph":
        """From any two key columns of a table; costs are 1 and weights are degrees or 1."""
        pins = clean_pins(pairs.select(_col(net).cast("bigint").alias("net_id"), _col(vertex).cast("bigint").alias("vertex_id")))
        weight = F.count(F.lit(1)) if degree_weights else F.first(F.lit(1).cast("bigint"))
        return cls(
            pins.groupBy("vertex_id").agg(weight.alias("weight")).withColumn("part", F.lit(None).cast("bigint")),
            pins.select("net_id").distinct().withColumn("cost", F.lit(1).cast("bigint")),
            pins,
        )

    def labelled(self, labels: DataFrame) -> "Hypergraph":
        """The same hypergraph with `labels(vertex_id, part)` in place of its parts."""
        return Hypergraph(self.vertices.drop("part").join(labels.select("vertex_id", "part"), "vertex_id", "left"), self.nets, self.pins)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_pins(pins: DataFrame) -> DataFrame:
    """Distinct (net_id, vertex_id) with neither null. The pair is the shuffle key, so no hot net or vertex skews it."""
    return pins.where("net_id is not null and vertex_id is not null").select("net_id", "vertex_id").distinct()
