"""Cutting lineage in storage that every executor shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the cluster's checkpoint folder, so that a lost executor loses nothing.

    The folder is the session's `spark.checkpoint.dir`. Only where that is unset, as in tests in one JVM, a
    temporary folder is used; on any other master an unset folder is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pinloom-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
