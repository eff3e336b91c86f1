"""How often two items stand in the same basket, and how far that exceeds chance.

Pairs are counted by an external sort of packed 64-bit codes. A task turns its baskets into codes (two item numbers in
one long), sorts them in runs of bounded length and counts equal codes in each run; the runs are then
shuffled by code, sorted with Spark's external sorter (sorted runs spill to disk and are merged), and equal codes, now
neighbours, are summed as they pass by. No task holds a table of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinloom.model import clean_pins
from pinloom.operators.skew import heavy_keys, skew_join
from pinloom.storage import durable

HALF = 2**32
RUN = 1 << 20


def incidences_within(pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The distinct (basket, item) of baskets with at most `most` items, and one row (baskets): the number of these.

    Sizes are counted before anything is gathered. Baskets that hold a large share of all rows are counted apart; the
    too large ones among them, as all but always all of them are, leave before any shuffle by basket.
    """
    distinct = pairs.where("basket is not null and item is not null").select("basket", "item").distinct()
    heavy = heavy_keys(distinct, "basket").select("basket")
    hot = distinct.join(F.broadcast(heavy), "basket").groupBy("basket").agg(F.count(F.lit(1)).alias("n"))
    too_large = hot.where(F.col("n") > most).select("basket")  # at most as many rows as heavy keys
    rest = distinct.join(F.broadcast(too_large), "basket", "left_anti")
    sizes = rest.groupBy("basket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select("basket")
    return rest.join(sizes, "basket"), sizes.agg(F.count(F.lit(1)).alias("baskets"))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of (code, n) from lists of 32-bit numbers: codes of all pairs a < b of each list."""
    parts: list[np.ndarray] = []
    held = 0

    def run() -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(size) - size
        for m in np.unique(size[size > 1]):
            rows = start[size == m]
            left, right = np.triu_indices(int(m), 1)
            step = max(1, RUN // len(left))
            for at in range(0, len(rows), step):
                items = np.sort(flat[rows[at:at + step, None] + np.arange(m)], axis=1)
                parts.append((items[:, left] * HALF + items[:, right]).ravel())
                held += parts[-1].size
                if held >= RUN:
                    yield run()
                    parts, held = [], 0
    if held:
        yield run()


def _sum_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums n over equal neighbouring codes; the last code of a batch waits for the next batch."""
    last, waiting = None, 0

    def out(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        code, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        codes, sums = code[starts], np.add.reduceat(n, starts)
        if last is not None:
            if codes[0] == last:
                sums[0] += waiting
            else:
                codes, sums = np.concatenate(([last], codes)), np.concatenate(([waiting], sums))
        last, waiting = codes[-1], sums[-1]
        if len(codes) > 1:
            yield out(codes[:-1], sums[:-1])
    if last is not None:
        yield out(np.array([last]), np.array([waiting]))


def cooccurrence(pairs: DataFrame, largest_basket: int, least_together: int = 1, least_lift: float = 0.0) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, baskets, lift, log_odds) for the item pairs a < b of `pairs(basket, item)`.

    Only baskets of at most `largest_basket` distinct items count, everywhere: `baskets` is their number, n_a, n_b and
    n_ab how many hold a, b and both. lift = n_ab * baskets / (n_a * n_b). log_odds is the logarithm of the odds
    ratio of the 2 x 2 table with 0.5 added to every cell (the continuity correction), so it is always finite. Rows
    with a null are no incidence, repeated rows count once; no rows give no pairs.

    Pairs with n_ab < least_together or lift < least_lift are left out. Since n_ab <= min(n_a, n_b), an item with
    n_a < least_together, or with n_a * least_lift > baskets, can be in no result and makes no codes; that is exact.

    Usable items are numbered in 31 bits; more of them than that are an error.
    """
    rows, total = incidences_within(pairs, largest_basket)
    counts = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    usable = counts.join(F.broadcast(total)).where((F.col("n") >= least_together) & (F.col("n") * F.lit(float(least_lift)) <= F.col("baskets")))
    numbered = durable(_numbered(usable.select("item", "n", "baskets")))  # one numbering for encoding and for both ways back
    numbers = (
        skew_join(rows, numbered.select("item", "number"), "item")
        .groupBy("basket").agg(F.collect_list("number").alias("numbers")).where(F.size("numbers") > 1).select("numbers")
    )
    runs = numbers.mapInArrow(_codes, "code bigint, n bigint")
    sorted_runs = runs.repartition("code").sortWithinPartitions("code")
    found = sorted_runs.mapInArrow(_sum_runs, "code bigint, n bigint").where(F.col("n") >= least_together)
    unpacked = found.select(F.shiftright("code", 32).alias("a"), F.col("code").bitwiseAND(HALF - 1).alias("b"), F.col("n").alias("n_ab"))
    both = (
        unpacked.join(numbered.select(F.col("number").alias("a"), F.col("item").alias("x"), F.col("n").alias("n_x"), "baskets"), "a")
        .join(numbered.select(F.col("number").alias("b"), F.col("item").alias("y"), F.col("n").alias("n_y")), "b")
    )
    swap = F.col("x") > F.col("y")
    named = both.select(
        F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), "n_ab",
        F.when(swap, F.col("n_y")).otherwise(F.col("n_x")).alias("n_a"), F.when(swap, F.col("n_x")).otherwise(F.col("n_y")).alias("n_b"), "baskets",
    )
    lift = F.col("n_ab") * F.col("baskets") / (F.col("n_a").cast("double") * F.col("n_b"))
    cells = [F.col("n_ab"), F.col("baskets") - F.col("n_a") - F.col("n_b") + F.col("n_ab"), F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab")]
    a, d, b, c = (x + 0.5 for x in cells)
    kept = named.where(F.col("n_ab").cast("double") * F.col("baskets") >= F.lit(float(least_lift)) * F.col("n_a") * F.col("n_b"))
    return kept.withColumn("lift", F.round(lift, 9)).withColumn("log_odds", F.round(F.log(a * d / (b * c)), 9))


def _numbered(items: DataFrame) -> DataFrame:
    """`items` with a `number` below 2^31, different for different items.

    number = position in its partition * partitions + partition. How rows are spread over partitions may differ from
    one execution to the next (adaptive execution merges partitions), so the result must be computed once and kept:
    no two uses may number for themselves. Within one execution rows are sorted, so a rerun of a task numbers alike.
    """
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = items.repartition(parts, "item").sortWithinPartitions("item")
    number = F.monotonically_increasing_id().bitwiseAND(2**33 - 1) * parts + F.spark_partition_id()
    checked = F.when(F.col("number") < HALF // 2, F.col("number")).otherwise(F.raise_error(F.lit("more items than 31 bits can number")).cast("bigint"))
    return placed.withColumn("number", number).withColumn("number", checked)


def vertex_pairs(pins: DataFrame, largest_net: int = 64, least_together: int = 1, least_lift: float = 0.0) -> DataFrame:
    """`cooccurrence` of vertices in nets."""
    return cooccurrence(clean_pins(pins).select(F.col("net_id").alias("basket"), F.col("vertex_id").alias("item")), largest_net, least_together, least_lift)
