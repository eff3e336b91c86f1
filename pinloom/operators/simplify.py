"""Reductions that never change which cuts are possible, and set maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinloom.functions.columns import mixed
from pinloom.model import Hypergraph
from pinloom.operators.metrics import cut_nets, net_sizes


def drop_small_nets(pins: DataFrame, max_size: int = 1) -> DataFrame:
    """Pins of the nets with more than `max_size` pins."""
    return pins.join(net_sizes(pins).where(F.col("size") > max_size).select("net_id"), "net_id", "left_semi")


def free_vertices(vertices: DataFrame, pins: DataFrame) -> DataFrame:
    """Vertices without a pin."""
    return vertices.join(pins.select("vertex_id"), "vertex_id", "left_anti")


def remove_nets(h: Hypergraph, net_ids: DataFrame) -> Hypergraph:
    """Without the nets in `net_ids(net_id)` and their pins; vertices stay."""
    return Hypergraph(h.vertices, h.nets.join(net_ids, "net_id", "left_anti"), h.pins.join(net_ids, "net_id", "left_anti"))


def remove_vertices(h: Hypergraph, vertex_ids: DataFrame) -> Hypergraph:
    """Without the vertices in `vertex_ids(vertex_id)` and their pins; nets stay."""
    return Hypergraph(h.vertices.join(vertex_ids, "vertex_id", "left_anti"), h.nets, h.pins.join(vertex_ids, "vertex_id", "left_anti"))


def add_vertices(h: Hypergraph, rows: DataFrame) -> Hypergraph:
    """With those of `rows` whose vertex_id is new."""
    new = rows.select("vertex_id", "weight", "part").dropDuplicates(["vertex_id"]).join(h.vertices, "vertex_id", "left_anti")
    return Hypergraph(h.vertices.unionByName(new), h.nets, h.pins)


def add_nets(h: Hypergraph, rows: DataFrame, pins: DataFrame) -> Hypergraph:
    """With those of `rows` whose net_id is new, and all of `pins`; pins that exist already count once."""
    new = rows.select("net_id", "cost").dropDuplicates(["net_id"]).join(h.nets, "net_id", "left_anti")
    return Hypergraph(h.vertices, h.nets.unionByName(new), h.pins.unionByName(pins.select("net_id", "vertex_id")).distinct())


def induced_subgraph(h: Hypergraph, keep: DataFrame) -> Hypergraph:
    """The vertices in `keep(vertex_id)`, their pins, and of these the nets with at least two pins left. Costs stay."""
    vertices = h.vertices.join(keep.select("vertex_id"), "vertex_id", "left_semi")
    pins = drop_small_nets(h.pins.join(keep.select("vertex_id"), "vertex_id", "left_semi"), 1)
    return Hypergraph(vertices, h.nets.join(pins.select("net_id"), "net_id", "left_semi"), pins)


def remove_cut_nets(h: Hypergraph, labels: DataFrame) -> Hypergraph:
    """Without the nets that `labels` already cut: under the cut-net metric they can't matter again.

    The caller's hypergraph still has them, so there is nothing to put back at the end.
    """
    return remove_nets(h, cut_nets(h.pins, labels).select("net_id"))


def set_fingerprints(pins: DataFrame, owner: str, member: str) -> DataFrame:
    """(owner, n, f1, f2, f3): a hash of each owner's member set that does not depend on order.

    Counts, two xors and a sum all combine on the map side: no set is ever gathered, so its size does not matter.
    """
    return pins.groupBy(owner).agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(mixed(member, 11)).alias("f1"),
        F.bit_xor(mixed(member, 23)).alias("f2"),
        F.sum(mixed(member, 37).bitwiseAND(0xFFFFFFFF)).alias("f3"),
    )


def duplicate_nets(pins: DataFrame) -> DataFrame:
    """(net_id, rep_id): each net with the largest id among the nets of exactly the same vertices.

    Nets are grouped by fingerprint; then every net that is not its group's representative is checked pin by pin
    against it (an anti-join on (representative, vertex)), and one that differs represents itself.
    """
    prints = set_fingerprints(pins, "net_id", "vertex_id")
    groups = prints.groupBy("n", "f1", "f2", "f3").agg(F.max("net_id").alias("rep_id"), F.count(F.lit(1)).alias("members"))
    proposed = prints.join(groups.where("members > 1"), ["n", "f1", "f2", "f3"]).where("net_id <> rep_id").select("net_id", "rep_id")
    theirs = pins.join(proposed, "net_id")
    reps = pins.join(proposed.select(F.col("rep_id").alias("net_id")), "net_id", "left_semi").select(F.col("net_id").alias("rep_id"), "vertex_id")
    wrong = theirs.join(reps, ["rep_id", "vertex_id"], "left_anti").select("net_id").distinct()
    merged = proposed.join(wrong, "net_id", "left_anti")
    return prints.select("net_id").join(merged, "net_id", "left").select("net_id", F.coalesce("rep_id", "net_id").alias("rep_id"))


def merge_duplicate_nets(h: Hypergraph) -> tuple[Hypergraph, DataFrame]:
    """One net for each distinct vertex set, with the summed cost, and the mapping (net_id, rep_id)."""
    mapping = duplicate_nets(h.pins)
    nets = mapping.join(h.nets, "net_id").groupBy(F.col("rep_id").alias("net_id")).agg(F.sum("cost").alias("cost"))
    pins = h.pins.join(mapping.where("net_id = rep_id").select("net_id"), "net_id", "left_semi")
    return Hypergraph(h.vertices, nets, pins), mapping
