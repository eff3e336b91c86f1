"""Spreading small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt out to all cores if its files are so small that a scan would leave cores without a task.

    For operators whose work on a row is large beside sending it. Spark cuts files into no pieces smaller than
    spark.sql.files.openCostInBytes; an input of that size for each core is left as it is, so at scale nothing moves.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    least = df._jdf.sparkSession().sessionState().conf().filesOpenCostInBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * least else df
