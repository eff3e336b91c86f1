"""The distributed-matrix file: pins grouped by part."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from pinloom.operators.metrics import kstart, pin_labels


def export_pins(pins: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, net, vertex), 1-based, range-sorted by (part, vertex, net): the body of the file."""
    return pin_labels(pins, labels).select("part", (F.col("net_id") + 1).alias("net"), (F.col("vertex_id") + 1).alias("vertex")).orderBy("part", "vertex", "net")


def write_partition(pins: DataFrame, labels: DataFrame, k: int, nets: int, vertices: int, path: str | Path) -> None:
    """Banner, `m n nnz k`, the k + 1 starts, then the pins by part. The sort is distributed; the file is one, so the
    driver streams the sorted partitions into it, holding one at a time."""
    starts = [r[1] for r in kstart(pins, labels, k).orderBy("position").collect()]  # k + 1 rows
    with open(path, "w") as file:
        file.write(f"%%MatrixMarket distributed-matrix coordinate pattern general\n{nets} {vertices} {starts[-1]} {k}\n")
        file.writelines(f"{s}\n" for s in starts)
        for row in export_pins(pins, labels).toLocalIterator():
            file.write(f"{row[1]} {row[2]}\n")


def result_path(folder: str | Path, source: str, k: int) -> Path:
    return Path(folder) / f"{Path(source).name}-k{k}"
