"""All pairs of records whose value sets are similar: a forest of sorted min-hash labels, then exact verification.

Each tree orders a record's values by an independent hash; the record's label is the prefix of that order, deepened
until it ends in a value that at most `frequent` records hold. Records with equal labels are neighbours. So every
neighbourhood has at most `frequent` members, however hot a value is, and nothing is cut off.

Two records agree in a tree iff, among all their values in the tree's order, some shared infrequent value comes before
every value that only one of them has. With i shared values of which r are infrequent and u in the union that is the
case with probability r / (r + u - i). For a record of n values of which p are frequent the least such probability over
all partners above the threshold is known, and the record takes as many trees as bring its recall to the target; a
pair's recall is at least that of its record with fewer trees. Records for which that would take more than `most_trees`
(nearly all their values are frequent) are compared among each other by an exact join instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pinloom.functions.columns import mixed
from pinloom.operators.skew import skew_join
from pinloom.storage import durable

U = np.uint64
SLICE = 1024


@lru_cache(maxsize=1 << 16)
def least_agreement(n: int, p: int, threshold: Fraction, least: int) -> float:
    """The least probability that a tree brings a record of n values, p of them frequent, and a partner together.

    Partners have at least `least` values and a similarity of at least `threshold`, and are not equal to the record.
    """
    out = 1.0
    for union in range(n, int(n / threshold) + 1):
        shared = max(math.ceil(threshold * union), least + n - union)
        if shared <= n and (shared, union) != (n, n):
            out = min(out, max(0, shared - p) / (union - p) if union > p else 0.0)
    return out


@lru_cache(maxsize=1 << 16)
def trees_for(n: int, p: int, threshold: Fraction, least: int, miss: float, most: int) -> int:
    """Trees that bring the chance of missing a partner down to `miss`; most + 1 if `most` don't."""
    agree = least_agreement(n, p, threshold, least)
    if agree >= 1:
        return 1
    return min(most + 1, math.ceil(math.log(miss) / math.log1p(-agree))) if agree > 0 else most + 1


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective mixing of 64-bit numbers, different for each seed."""
    with np.errstate(over="ignore"):
        x = x.astype(U) + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _labels(threshold: Fraction, least: int, miss: float, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            sizes = {c: batch.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rare", "common")}
            values = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("rare", "common")}
            n, p = sizes["rare"] + sizes["common"], sizes["common"]
            trees = np.array([trees_for(a, b, threshold, least, miss, most) for a, b in zip(n.tolist(), p.tolist())], np.int64)
            np.minimum(trees, most, out=trees)
            trees[sizes["rare"] == 0] = 0
            begin = {c: np.cumsum(s) - s for c, s in sizes.items()}
            bits = np.zeros(len(ids), U)
            for c in ("rare", "common"):
                np.bitwise_or.at(bits, np.repeat(np.arange(len(ids)), sizes[c]), U(1) << (mix(values[c], 3000) & U(63)))
            for t in range(int(trees.max()) if len(trees) else 0):
                rows = np.flatnonzero(trees > t)
                at = _ranges(begin["rare"][rows], sizes["rare"][rows])
                low = np.minimum.reduceat(mix(values["rare"][at], t), np.cumsum(sizes["rare"][rows]) - sizes["rare"][rows])
                label = low.copy()
                some = np.flatnonzero(p[rows] > 0)
                if len(some):
                    count = p[rows][some]
                    over = values["common"][_ranges(begin["common"][rows][some], count)]
                    before = mix(over, t) < np.repeat(low[some], count)
                    with np.errstate(over="ignore"):
                        label[some] += np.add.reduceat(np.where(before, mix(over, t + 1000), U(0)), np.cumsum(count) - count)
                with np.errstate(over="ignore"):
                    key = mix(label, t + 2000)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[rows]), pa.array(n[rows].astype(np.int32)), pa.array(bits[rows].view(np.int64))], names=["label", "id", "n", "bits"])

    return run


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenation of the ranges begin[i] .. begin[i] + size[i]."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def similar_classes(
    pairs: DataFrame, threshold: float, least: int = 1, miss: float = 1e-4, frequent: int = 256, most_trees: int = 64, large: int = 10_000,
) -> tuple[DataFrame, DataFrame]:
    """Classes (id, class_id, n) and similar classes (class_a, class_b, shared, similarity), class_a < class_b.

    `pairs(id, value)` are longs; rows with a null say nothing and repeated rows count once. Only records with at
    least `least` distinct values take part. A class is a group of records with equal value sets (equal counts and two
    equal 64-bit hashes), named by its smallest id. Two classes are similar if shared / union >= threshold, counted
    exactly; each such pair is found with a probability of at least 1 - miss. No rows give no classes.

    Records of more than `large` values, a number that does not grow with the data, are never gathered: their pairs are
    counted by joins. Partners of such a record have at least `threshold` times as many values.
    """
    ratio = Fraction(threshold).limit_denominator(1000)
    distinct = pairs.where("id is not null and value is not null").select("id", "value").distinct()
    degree = distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    big = durable(degree.where((F.col("n") > large * float(ratio)) & (F.col("n") >= least)).select("id", "n", (F.col("n") > large).alias("huge")))
    few = small_enough(big)
    any_huge = not big.where("huge").isEmpty()
    huge = few(big.where("huge").select("id"))

    marked = distinct.join(huge, "id", "left_anti").join(_frequent_values(distinct, frequent), "value", "left")
    rare, often = F.when(F.col("often").isNull(), F.col("value")), F.when(F.col("often"), F.col("value"))
    sets = durable(marked.groupBy("id").agg(
        F.collect_list(rare).alias("rare"), F.collect_list(often).alias("common"), F.count(F.lit(1)).cast("int").alias("n"),
        F.bit_xor(mixed("value", 11)).alias("f1"), F.bit_xor(mixed("value", 23)).alias("f2"),
    ).where(F.col("n") >= least))
    classes = _classes(sets.select("id", "n", "f1", "f2"))
    copies = classes.where("id <> class_id").select("id")
    whole = sets.join(copies, "id", "left_anti").select("id", "n", "rare", "common")

    labels = whole.select("id", "rare", "common").mapInArrow(_labels(ratio, least, miss, most_trees), "label bigint, id bigint, n int, bits bigint")
    near = labels.groupBy("label").agg(F.collect_list(F.struct("id", "n", "bits")).alias("m")).where(F.size("m") > 1)  # at most `frequent` members
    found = near.select(F.explode(F.expr(f"flatten(transform(m, a -> transform(filter(m, b -> a.id < b.id and {_fits(ratio)}), b -> struct(a.id as a, b.id as b))))")).alias("p")).select("p.a", "p.b")
    hard = whole.where(_may_be_hard(ratio, miss, most_trees))
    if not hard.isEmpty():
        found = found.unionByName(_among_frequent(hard, ratio, least, miss, most_trees))

    values = sets.select("id", "n", F.concat("rare", "common").alias("values"))
    both = found.distinct().join(values.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("values").alias("va")), "a").join(
        values.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("values").alias("vb")), "b")
    shared = both.select("a", "b", "na", "nb", F.size(F.array_intersect("va", "vb")).cast("bigint").alias("shared"))
    if any_huge:
        shared = shared.unionByName(_among_large(distinct, big, few, ratio))
        classes = classes.unionByName(big.where("huge").select("id", F.col("id").alias("class_id"), F.col("n").cast("int")))
    return classes, _above(shared, ratio)


def _fits(ratio: Fraction) -> str:
    """What two similar records a and b satisfy for certain: near sizes, and bitmaps that differ in no more places
    than their sets differ in values, since a value sets one bit."""
    less, more = ratio.denominator - ratio.numerator, ratio.denominator + ratio.numerator
    return (f"least(a.n, b.n) * {ratio.denominator}L >= greatest(a.n, b.n) * {ratio.numerator}L "
            f"and bit_count(a.bits ^ b.bits) * {more}L <= (a.n + b.n) * {less}L")


def _may_be_hard(ratio: Fraction, miss: float, most: int) -> Column:
    """Holds for every record that `most` trees may not serve: n * threshold - p over n - p bounds its agreement."""
    agree, p = -math.expm1(math.log(miss) / most), F.size("common")
    return (p > 0) & (F.col("n") * float(ratio) - p < agree * (F.col("n") - p) + 1e-9)


def _classes(prints: DataFrame) -> DataFrame:
    """(id, class_id, n): the smallest id of each fingerprint, found by map-side combined aggregation."""
    groups = prints.groupBy("n", "f1", "f2").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("c")).where("c > 1")
    joined = prints.join(groups.drop("c"), ["n", "f1", "f2"], "left")
    return joined.select("id", F.coalesce("class_id", "id").alias("class_id"), "n")


def _frequent_values(distinct: DataFrame, frequent: int, bound: int = 20_000) -> DataFrame:
    """(value, often) of the values that more than `frequent` records hold; broadcast if there are at most `bound`."""
    common = distinct.groupBy("value").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > frequent).select("value")
    first = common.limit(bound + 1).collect()
    if len(first) > bound:
        return common.withColumn("often", F.lit(True))
    return F.broadcast(distinct.sparkSession.createDataFrame([(r[0], True) for r in first], "value bigint, often boolean"))


def _among_frequent(may_be: DataFrame, ratio: Fraction, least: int, miss: float, most: int) -> DataFrame:
    """(a, b): candidates among the records that trees can't serve, from an exact prefix join.

    Ordered by rarity, two sets above the threshold share one of their first n - ceil(threshold * n) + 1 values.
    """
    def needs(n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([trees_for(int(a), int(b), ratio, least, miss, most) > most for a, b in zip(n, p)], dtype=bool)

    hard = may_be.where(F.pandas_udf(needs, "boolean")("n", F.size("common")))
    held = hard.select("id", "n", F.explode(F.concat("rare", "common")).alias("value"))
    order = held.groupBy("value").agg(F.count(F.lit(1)).alias("c"))
    first = F.row_number().over(W.partitionBy("id").orderBy("c", "value"))
    keep = F.col("n") - F.ceil(F.col("n") * ratio.numerator / ratio.denominator - 1e-9) + 1
    prefix = held.join(order, "value").withColumn("r", first).where(F.col("r") <= keep).select("id", "n", "value")
    other = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "value")
    fits = (F.least("n", "nb") * ratio.denominator >= F.greatest("n", "nb") * ratio.numerator) & (F.col("id") < F.col("b"))
    return prefix.join(other, "value").where(fits).select(F.col("id").alias("a"), "b")


def small_enough(rows: DataFrame, bound: int = 100_000) -> Callable[[DataFrame], DataFrame]:
    """A hint for tables of the rows of `rows`: to broadcast them if they were counted to be at most `bound`, else none."""
    return F.broadcast if rows.limit(bound + 1).count() <= bound else lambda df: df


def _among_large(distinct: DataFrame, big: DataFrame, few: Callable[[DataFrame], DataFrame], ratio: Fraction) -> DataFrame:
    """(a, b, na, nb, shared) of pairs with a huge record, from a join of the holders of a value. Records meet only those
    of their own and the next class of size, classes being as wide as the threshold, so most that are too unlike in
    size never do; adaptive execution splits values that many of them hold."""
    step = math.log(1 / float(ratio)) if ratio < 1 else 1.0
    held = distinct.join(few(big), "id").withColumn("class", F.floor(F.log(F.col("n").cast("double")) / step))
    left = held.select("value", F.col("id").alias("a"), F.col("n").alias("na"), F.col("huge").alias("ha"), F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"))
    right = held.select("value", "class", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("huge").alias("hb"))
    fits = (F.col("ha") | F.col("hb")) & (F.col("a") < F.col("b")) & (F.least("na", "nb") * ratio.denominator >= F.greatest("na", "nb") * ratio.numerator)
    return left.join(right, ["value", "class"]).where(fits).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))


def _above(counted: DataFrame, ratio: Fraction) -> DataFrame:
    union = F.col("na") + F.col("nb") - F.col("shared")
    return counted.where(F.col("shared") * ratio.denominator >= union * ratio.numerator).select(
        F.col("a").alias("class_a"), F.col("b").alias("class_b"), "shared", F.round(F.col("shared") / union, 9).alias("similarity")
    )


def similar_pairs(pairs: DataFrame, threshold: float, least: int = 1, **options: object) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of similar records, classes expanded. As many rows as there are pairs."""
    classes, similar = similar_classes(pairs, threshold, least, **options)
    left = classes.select(F.col("class_id").alias("class_a"), F.col("id").alias("x"))
    right = classes.select(F.col("class_id").alias("class_b"), F.col("id").alias("y"))
    across = similar.select("class_a", "class_b").join(left, "class_a").join(right, "class_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    # the members of a class, split into slices of about SLICE, meet slice by slice, so a large class is many tasks' work
    sizes = classes.where("id <> class_id").groupBy("class_id").agg(F.ceil((F.count(F.lit(1)) + 1) / SLICE).cast("int").alias("slices"))
    members = skew_join(classes.select("class_id", "id"), sizes, "class_id")
    left = members.select("class_id", F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"))
    right = members.select("class_id", F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    within = left.join(right, ["class_id", "slice"]).where("id_a < id_b")
    return across.unionByName(within.select("id_a", "id_b"))


def record_links(pairs: DataFrame, threshold: float, least: int = 1, **options: object) -> DataFrame:
    """(id, class_id, links): one row a record; links is its number of similar records, those of its class included."""
    classes, similar = similar_classes(pairs, threshold, least, **options)
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("members"))
    ends = similar.select(F.col("class_a").alias("class_id"), F.col("class_b").alias("other")).unionByName(similar.select(F.col("class_b").alias("class_id"), F.col("class_a").alias("other")))
    linked = ends.join(sizes.withColumnRenamed("class_id", "other"), "other").groupBy("class_id").agg(F.sum("members").alias("others"))
    per_class = sizes.join(linked, "class_id", "left").select("class_id", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return classes.select("id", "class_id").join(per_class, "class_id").select("id", "class_id", "links")
