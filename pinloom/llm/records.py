"""Records that say the same in different writing: one record each, with the number of its copies.

A record is a multiset of normalized (field, value) pairs. Each pair has a 64-bit hash; a record's fingerprint is the
commutative combination of these hashes, so neither the order of fields nor that of values matters and nothing is
sorted. Records are grouped by fingerprint, and every other record of a group is then held against its first one, pair
by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from pinloom.operators.skew import heavy_keys, skew_join
from pinloom.partitions import spread
from pinloom.storage import durable

MASK = 2**61 - 1


def plain(text: Column) -> Column:
    """Text without what writing adds: in small letters, only letters and digits, numbers without leading zeros."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
    return F.regexp_replace(kept, r"^0+(?=[0-9]+$)", "")


def pair(field: str | Column, value: Column) -> Column:
    """A normalized pair as one string; the sign between cannot stand in normalized text."""
    return F.concat_ws("=", F.lit(field) if isinstance(field, str) else field, value)


def column_pairs(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """`df` with `_pairs` of `columns` (column: name): the name and the value, each normalized; of an array one pair an element.

    A null column or element says nothing; a row of nulls has no pairs and so no copies.
    """
    def of(c: str) -> Column:
        values = F.col(f"`{c}`") if isinstance(df.schema[c].dataType, ArrayType) else F.array(F.col(f"`{c}`"))
        return F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: pair(plain(F.lit(columns[c])), plain(x.cast("string"))))

    pairs = F.concat(*[F.coalesce(of(c), F.array().cast("array<string>")) for c in columns])
    return df.withColumn("_pairs", pairs).withColumn("_pairs", F.when(F.size("_pairs") > 0, F.col("_pairs")))


def parse_record(df: DataFrame) -> DataFrame:
    """`df(body)` with `_cost` and `_vertices` that a body states; null where it states none.

    Letter case, white space and punctuation do not matter: after the word cost comes the next number; every number
    marked with the letter v counts as a vertex. Leading zeros are dropped, repeated vertices count once. Numbers stay
    text, so none is too long. One projection for each step, so that no step is computed for each of its uses.
    """
    cost = F.regexp_extract("_text", r"cost[^0-9a-z]*+0*([0-9]+)", 1)
    vertices = F.regexp_extract_all("_text", F.lit(r"(?<![a-z0-9])v[^0-9a-z]*+0*([0-9]+)"), F.lit(1))
    found = df.withColumn("_text", F.lower("body")).withColumns({"_cost": cost, "_vertices": vertices}).drop("_text")
    return found.withColumns({"_cost": F.nullif("_cost", F.lit("")), "_vertices": F.when(F.size("_vertices") > 0, F.array_distinct("_vertices"))})


def record_pairs(df: DataFrame) -> DataFrame:
    """`df(body)` with `_pairs` of a net's record: its cost and each of its vertices; null if it states no cost or no vertex."""
    pairs = F.concat(F.array(pair("cost", F.col("_cost"))), F.transform("_vertices", lambda v: pair("vertex", v)))
    return parse_record(df).withColumn("_pairs", F.when(F.col("_cost").isNotNull() & F.col("_vertices").isNotNull(), pairs)).drop("_cost", "_vertices")


def fingerprint(pairs: str = "_pairs", seed: int = 1) -> Column:
    """The sum of the hashes of all pairs, modulo 2^61 - 1, hashed once more with their number; null of null."""
    total = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda acc, p: (acc + F.xxhash64(p, F.lit(seed)).bitwiseAND(MASK)) % MASK)
    return F.when(F.col(pairs).isNotNull(), F.xxhash64(total, F.size(pairs)))


def same_pairs(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values equally often, by hashed lookups and without sorting."""
    repeats = F.size(F.array_distinct(a)) < F.size(a)
    often = F.forall(F.array_distinct(a), lambda x: F.size(F.filter(a, lambda y: y == x)) == F.size(F.filter(b, lambda y: y == x)))
    return (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0) & (~repeats | often)


Maker = Callable[[DataFrame], DataFrame]


def collapse_pairs(records: DataFrame, make: Maker) -> DataFrame:
    """(rec_id, keep_id) of every record: the smallest rec_id of the records with the same multiset of pairs.

    `make` adds `_pairs`, an array of strings, to rows of `records`; a record for which it is null is its own group.
    rec_id must be unique; rows without one are left out. No rows give no rows.

    Fingerprints are computed once and kept; only these numbers are grouped, by hash aggregation that combines on the
    map side. Pairs are made a second time only for records that have a copy, to be compared. Groups that hold a large
    share of all rows meet their first record by broadcast, so no task gets a whole group. Records that differ from the
    first of their fingerprint are grouped once more by an independent one; what differs even then is its own group.
    """
    named = records.where("rec_id is not null")
    prints = durable(make(spread(named)).select("rec_id", fingerprint().alias("h")))
    found, odd = _matched(named, make, prints.where("h is not null"))
    if not odd.isEmpty():
        again, _ = _matched(named, make, make(named.join(odd, "rec_id")).select("rec_id", F.xxhash64("h", fingerprint(seed=2)).alias("h")))
        found = found.unionByName(again)
    return prints.select("rec_id").join(found, "rec_id", "left").select("rec_id", F.coalesce("keep_id", "rec_id").alias("keep_id"))


def _matched(records: DataFrame, make: Maker, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rec_id, keep_id) of the records that equal the first of their fingerprint, the first itself left out, and
    (rec_id, h) of those that don't."""
    groups = prints.groupBy("h").agg(F.min("rec_id").alias("keep_id"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "keep_id")
    copies = skew_join(prints, groups, "h").where("rec_id <> keep_id")
    ours = make(copies.withColumnsRenamed({"h": "_h", "keep_id": "_keep"}).join(records, "rec_id")).select("rec_id", F.col("_keep").alias("keep_id"), F.col("_h").alias("h"), "_pairs")
    firsts = make(groups.select(F.col("keep_id").alias("rec_id")).join(records, "rec_id")).select(F.col("rec_id").alias("keep_id"), F.col("_pairs").alias("first"))
    judged = durable(skew_join(ours, firsts, "keep_id", heavy=heavy_keys(copies, "keep_id")).select("rec_id", "keep_id", "h", same_pairs(F.col("_pairs"), F.col("first")).alias("same")))
    return judged.where("same").select("rec_id", "keep_id"), judged.where("not same").select("rec_id", "h")


def collapse_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`collapse_pairs` of `rows(rec_id, *columns)` of any table, by the normalized names and values of the columns."""
    named = {f"_{i}": c for i, c in enumerate(columns)}
    short = rows.select("rec_id", *[F.col(f"`{c}`").alias(n) for n, c in named.items()])
    return collapse_pairs(short, lambda df: column_pairs(df, named))


def collapse(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rec_id, keep_id) of every record and (keep_id, cost, n_vertices, vertices, copies) of every kept one.

    `records(rec_id, body)`: keep_id is the smallest rec_id of the records that state the same cost and the same set of
    vertices. A record that states no cost or no vertex, a null body included, is its own group, with copies 1. rec_id
    must be unique; other columns are not looked at. No rows give no groups.
    """
    bodies = records.where("rec_id is not null").select("rec_id", "body")
    members = collapse_pairs(bodies, record_pairs)
    copies = members.groupBy("keep_id").agg(F.count(F.lit(1)).alias("copies"))
    kept = copies.join(parse_record(bodies).withColumnRenamed("rec_id", "keep_id"), "keep_id")
    size = F.size(F.coalesce("_vertices", F.array().cast("array<string>")))
    return members, kept.select("keep_id", F.col("_cost").alias("cost"), size.alias("n_vertices"), F.col("_vertices").alias("vertices"), "copies")
