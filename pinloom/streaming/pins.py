"""The feed of pins as a stream: repeated deliveries dropped within a delay, sizes of nets kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PINS = "net_id bigint, vertex_id bigint, shard int, read_at timestamp, loaded_at timestamp"


def read_pins(spark: SparkSession, folder: str, schema: str = PINS) -> DataFrame:
    """Parquet files of the feed as they arrive in `folder`."""
    return spark.readStream.schema(schema).parquet(folder)


def new_pins(feed: DataFrame, delay: str = "2 days") -> DataFrame:
    """(net_id, vertex_id, loaded_at): each pin once among deliveries loaded within `delay` of each other.

    Rows with a null key are no pin, rows without loaded_at can't be placed in time; both are left out. State is kept
    for `delay` only, so a pin sent again later than that comes through again; `net_sizes` over a table of
    distinct pins is exact, this is the running view.
    """
    keyed = feed.where("net_id is not null and vertex_id is not null and loaded_at is not null")
    return keyed.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["net_id", "vertex_id"]).select("net_id", "vertex_id", "loaded_at")


def arrivals(feed: DataFrame, window: str = "1 hour", delay: str = "2 days") -> DataFrame:
    """(begin, rows, late): rows of the feed for each window of loading time, and how many were read a day or more before."""
    late = F.count_if(F.col("read_at") < F.col("loaded_at") - F.expr("interval 1 day")).alias("late")
    counted = feed.where("loaded_at is not null").withWatermark("loaded_at", delay).groupBy(F.window("loaded_at", window)).agg(F.count(F.lit(1)).alias("rows"), late)
    return counted.select(F.col("window.start").alias("begin"), "rows", "late")
