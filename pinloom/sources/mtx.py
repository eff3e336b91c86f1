"""MatrixMarket files: a Spark data source that reads byte ranges in parallel, and the hypergraph made from it."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pinloom.model import Hypergraph
from pinloom.options import Weights
from pinloom.sources.matrix_lines import REASONS, check_entries, parse_banner
from pinloom.sources.structural import LF, PERCENT, index, whole_numbers

BLOCK = 32 << 20


class MatrixMarketError(ValueError):
    """The file is missing or is no MatrixMarket coordinate file."""


def read_header(path: str) -> tuple[str, str, int, int, int, int]:
    """(field, symmetry, nets, vertices, entries, offset of the first entry)."""
    try:
        file = open(path, "rb")
    except OSError as e:
        raise MatrixMarketError(f"{path}: {e.strerror}") from e
    with file:
        kind = parse_banner(file.readline().decode("utf-8", "replace").removesuffix("\n"))
        if isinstance(kind, str):
            raise MatrixMarketError(f"{path}: {kind}")
        for line in iter(file.readline, b""):
            if line.startswith(b"%") or not line.strip(b" \t\r\n"):
                continue
            data = np.frombuffer(line.removesuffix(b"\n"), np.uint8)
            ix = index(data, np.zeros(1, np.int64), np.array([len(data)]))
            good, value = whole_numbers(ix, np.arange(len(ix.start)))
            if len(good) != 3 or not good.all():
                break
            return *kind, *map(int, value), file.tell()
    raise MatrixMarketError(f"{path}: size line needs three whole numbers")


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int, header: tuple) -> None:
        self.path, self.begin, self.end, self.header = path, begin, end, header


class MatrixMarketSource(DataSource):
    """`spark.read.format("mtx").load(path)`: rows (net_id, vertex_id), 0-based, mirrored for symmetric files.

    Rows are as in the file, so repeated entries repeat. An entry that does not parse is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return "net_id bigint, vertex_id bigint"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("blockbytes", BLOCK)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, block_bytes: int) -> None:
        self.path, self.block_bytes = path, block_bytes

    def partitions(self) -> list[InputPartition]:
        header = read_header(self.path)
        size = os.path.getsize(self.path)
        return [_Range(self.path, at, min(at + self.block_bytes, size), header) for at in range(header[-1], size, self.block_bytes)] or [_Range(self.path, size, size, header)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """A range owns the lines that begin in it."""
        with open(partition.path, "rb") as file:
            at = partition.begin
            if at > partition.header[-1]:
                file.seek(at - 1)
                file.readline()
                at = file.tell()
            if at >= partition.end:
                return
            file.seek(at)
            data = file.read(partition.end - at)
            if not data.endswith(b"\n"):
                data += file.readline()
        yield from parse_block(data, partition.header, partition.path)


def parse_block(text: bytes, header: tuple, path: str) -> Iterator[pa.RecordBatch]:
    field, symmetry, nets, vertices, _, _ = header
    data = np.frombuffer(text if text.endswith(b"\n") else text + b"\n", np.uint8)
    ends = np.flatnonzero(data == LF)
    starts = np.concatenate(([0], ends[:-1] + 1))
    ix = index(data, starts, ends)
    rows = np.flatnonzero((ix.count > 0) & (data[starts] != PERCENT))
    full = lambda x: np.full(len(rows), x)
    reason, e, v = check_entries(ix, rows, full(field == "pattern"), full(nets), full(vertices))
    if reason.any():
        bad = rows[np.flatnonzero(reason)[0]]
        raise MatrixMarketError(f"{path}: {REASONS[reason[reason > 0][0]]}: {data[starts[bad]:ends[bad]].tobytes()[:80]!r}")
    if symmetry == "symmetric":
        mirror = e != v
        e, v = np.concatenate((e, v[mirror])), np.concatenate((v, e[mirror]))
    yield pa.RecordBatch.from_arrays([pa.array(e - 1), pa.array(v - 1)], names=["net_id", "vertex_id"])


def read_hypergraph(spark: SparkSession, path: str, weights: Weights = Weights.ONE, check_count: bool = True) -> Hypergraph:
    """The hypergraph of a MatrixMarket file: rows are nets, columns vertices.

    Every column is a vertex, also without entries; a row without entries makes no net; repeated entries are one pin.
    With `check_count` a number of entries other than the header's is an error. Weights are 1 or the degree.
    """
    _, symmetry, _, vertices, entries, _ = read_header(path)
    spark.dataSource.register(MatrixMarketSource)
    raw = spark.read.format("mtx").load(path)
    if check_count:
        n, diagonal = raw.agg(F.count(F.lit(1)), F.count_if(F.col("net_id") == F.col("vertex_id"))).first()
        found = (n + diagonal) // 2 if symmetry == "symmetric" else n
        if found != entries:
            raise MatrixMarketError(f"{path}: {found} entries, the header says {entries}")
    pins = raw.distinct()
    spine = spark.range(vertices).select(F.col("id").alias("vertex_id"))
    degree = pins.groupBy("vertex_id").agg(F.count(F.lit(1)).alias("weight"))
    weight = F.lit(1).cast("bigint") if weights is Weights.ONE else F.coalesce("weight", F.lit(0)).cast("bigint")
    return Hypergraph(
        spine.join(degree, "vertex_id", "left").select("vertex_id", weight.alias("weight"), F.lit(None).cast("bigint").alias("part")),
        pins.select("net_id").distinct().withColumn("cost", F.lit(1).cast("bigint")), pins,
    )


def random_pins(spark: SparkSession, nets: int, vertices: int, pins: int, seed: int = 1) -> DataFrame:
    """(net_id, vertex_id): exactly `pins` distinct random pairs, the same for the same seed.

    Cells of the nets x vertices matrix are permuted by an affine map modulo the number of cells; the first `pins`
    images are taken, so none repeats and none is rejected.
    """
    cells = nets * vertices
    if pins > cells:
        raise ValueError("more pins than cells")
    if not pins:
        return spark.createDataFrame([], "net_id bigint, vertex_id bigint")
    rng = np.random.default_rng(seed)
    while np.gcd(step := int(rng.integers(1, cells)) if cells > 1 else 1, cells) != 1:
        pass
    begin = int(rng.integers(cells))
    cell = ((F.col("id").cast("decimal(19,0)") * F.lit(step).cast("decimal(19,0)") + begin) % cells).cast("bigint")
    return spark.range(pins).select(cell.alias("c")).select(F.expr(f"c div {vertices}").alias("net_id"), (F.col("c") % vertices).alias("vertex_id"))


def write_matrix(pins: DataFrame, nets: int, vertices: int, path: str) -> None:
    """A pattern general file, streamed through the driver partition by partition."""
    with open(path, "w") as file:
        file.write(f"%%MatrixMarket matrix coordinate pattern general\n{nets} {vertices} {pins.count()}\n")
        for row in pins.select("net_id", "vertex_id").toLocalIterator():
            file.write(f"{row[0] + 1} {row[1] + 1}\n")
