"""Loading lines of MatrixMarket files: valid entries on one side, rejected lines with a reason on the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinloom.operators.skew import heavy_keys, skew_join
from pinloom.sources.structural import PERCENT, Index, decimals, index, whole_numbers

# Fixed values of the format.
BANNER = ("%%MatrixMarket", "matrix", "coordinate")
FIELDS = ("real", "integer", "pattern")
SYMMETRIES = ("general", "symmetric")

# What a line is.
ENTRY, COMMENT, BLANK, HEADER, UNREAD, REJECT = "entry", "comment", "blank", "header", "unread", "reject"


def parse_banner(line: str | None) -> tuple[str, str] | str:
    """(field, symmetry) of a banner line, or the reason why it is none."""
    if line is None:
        return "banner is null"
    words = line.removesuffix("\r").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    if len(words) != 5:
        return "banner needs five fields"
    if tuple(words[:3]) != BANNER:
        return "banner names another format"
    if words[3] not in FIELDS:
        return "banner has an unknown field type"
    if words[4] not in SYMMETRIES:
        return "banner has an unknown symmetry"
    return words[3], words[4]


def block(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of a string column, nulls being empty; nothing is copied but a null's range."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[:at[-1]] if data is not None and at[-1] else np.zeros(0, np.uint8), at[:-1], at[1:]


def check_entries(ix: Index, rows: np.ndarray, pattern: np.ndarray, nets: np.ndarray, vertices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(reason number or 0, e, v) of each of the records `rows`; the other arrays are by row. See REASONS."""
    reason = np.zeros(len(rows), np.int8)
    e, v = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    want = np.where(pattern, 2, 3)
    reason[ix.count[rows] != want] = 1
    fields = np.concatenate(([0], np.cumsum(ix.stray, dtype=np.int64)))
    first = ix.first[rows]
    reason[fields[first + ix.count[rows]] - fields[first] > 0] = 2
    ok = np.flatnonzero(reason == 0)
    for j, (into, most, bad) in enumerate(((e, nets, 3), (v, vertices, 4))):
        good, value = whole_numbers(ix, ix.field(rows[ok], j))
        into[ok] = value
        reason[ok[~good]] = bad
        reason[ok[good & ((value < 1) | (value > most[ok]))]] = bad + 2
        ok = np.flatnonzero(reason == 0)
    valued = ok[~pattern[ok]]
    reason[valued[~decimals(ix, ix.field(rows[valued], 2))]] = 7
    return reason, e, v


REASONS = np.array([
    "", "wrong number of fields", "stray quote", "net is no whole number", "vertex is no whole number",
    "net is out of range", "vertex is out of range", "value is no finite decimal number",
], dtype=object)


def _headers(lines: DataFrame) -> DataFrame:
    """One row for each file: (file_id, field, symmetry, nets, vertices, entries, size_line, bad_line, bad_reason).

    bad_line is the line of a failed banner or size line; size_line is null if the file has none.
    """
    plain = (F.col("line_no") > 1) & F.col("line").isNotNull() & ~F.col("line").startswith("%") & ~F.col("line").rlike(r"\A[ \t]*\r?\z")
    firsts = lines.groupBy("file_id").agg(
        F.min(F.when(F.col("line_no") == 1, F.struct(F.col("line").isNull().alias("none"), "line"))).alias("banner"),
        F.min(F.when(plain, F.struct("line_no", "line"))).alias("size"),
    ).select("file_id", F.col("banner").isNotNull().alias("begun"), F.col("banner.line").alias("banner"), F.col("size.line_no").alias("size_line"), F.col("size.line").alias("size"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            ix = index(*block(batch.column("size")))
            three = np.flatnonzero(ix.count == 3)
            good, values = np.zeros(n, bool), np.zeros((3, n), np.int64)
            good[three] = True
            for j in range(3):
                is_whole, value = whole_numbers(ix, ix.field(three, j))
                good[three] &= is_whole
                values[j, three] = value
            out = []
            for i, (begun, banner, at) in enumerate(zip(batch.column("begun").to_pylist(), batch.column("banner").to_pylist(), batch.column("size_line").to_pylist())):
                kind = parse_banner(banner) if begun else "banner is missing"
                if isinstance(kind, str):
                    out.append((None, None, at, 1, kind))
                elif at is not None and not good[i]:
                    out.append((*kind, at, at, "size line needs three whole numbers"))
                else:
                    out.append((*kind, at, None, None))
            field, symmetry, at, bad, reason = (list(x) for x in zip(*out)) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([
                batch.column("file_id"), pa.array(field, pa.string()), pa.array(symmetry, pa.string()), *map(pa.array, values),
                pa.array(at, pa.int64()), pa.array(bad, pa.int64()), pa.array(reason, pa.string()),
            ], names=["file_id", "field", "symmetry", "nets", "vertices", "entries", "size_line", "bad_line", "bad_reason"])

    return firsts.mapInArrow(parse, "file_id bigint, field string, symmetry string, nets bigint, vertices bigint, entries bigint, size_line bigint, bad_line bigint, bad_reason string")


def load_lines(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, kind, e, v, symmetric, reason) for each row of `lines(file_id, line_no, line)`.

    kind: "entry" (e and v filled, 1-based as written), "comment", "blank", "header" (a good banner or size line),
    "reject" (reason filled), or "unread": a line of a file whose banner or size line is rejected, or that has none.
    A null line after the banner is rejected and never taken for the size line. A row without file_id or line_no is
    rejected. Whole numbers beyond 2^63 - 1 count as that number. Other columns of `lines` are not looked at.

    A file's header is found by a map-side combined aggregate. Lines meet it in a join that sends the lines of files
    holding a large share of all rows nowhere (their headers are broadcast, a bounded number), then one pass of
    structural indexing checks whole batches.
    """
    lines = lines.select(F.col("file_id").cast("bigint").alias("file_id"), F.col("line_no").cast("bigint").alias("line_no"), "line")
    placed = lines.where("file_id is not null and line_no is not null")
    joined = skew_join(placed, _headers(placed), "file_id", "inner", heavy_keys(placed, "file_id"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {name: batch.column(name) for name in batch.schema.names}
            numbers = {c: col[c].fill_null(0).to_numpy(zero_copy_only=False) for c in ("line_no", "size_line", "bad_line", "nets", "vertices")}
            line_no, n = numbers["line_no"], batch.num_rows
            is_null = col["line"].is_null().to_numpy(zero_copy_only=False)
            data, starts, ends = block(col["line"])
            ix = index(data, starts, ends)
            comment = np.zeros(n, bool)
            some = ends > starts
            comment[some] = data[starts[some]] == PERCENT
            kind = np.full(n, ENTRY, object)
            reason = np.full(n, None, object)
            kind[(ix.count == 0) & ~is_null] = BLANK
            kind[comment] = COMMENT
            kind[is_null] = REJECT
            reason[is_null] = "line is null"
            kind[(line_no == 1) | ((line_no == numbers["size_line"]) & (numbers["size_line"] > 0))] = HEADER
            failed = numbers["bad_line"] > 0
            kind[failed | ((numbers["size_line"] == 0) & (kind == ENTRY))] = UNREAD
            here = failed & (line_no == numbers["bad_line"])
            kind[here] = REJECT
            reason[~failed & (kind == HEADER)] = None
            reason[failed] = None
            reason[here] = col["bad_reason"].to_numpy(zero_copy_only=False)[here]
            rows = np.flatnonzero(kind == ENTRY)
            pattern = (np.asarray(col["field"].to_numpy(zero_copy_only=False)) == "pattern")[rows]
            why, e, v = check_entries(ix, rows, pattern, numbers["nets"][rows], numbers["vertices"][rows])
            reason[rows[why > 0]] = REASONS[why[why > 0]]
            kind[rows[why > 0]] = REJECT
            entry = np.zeros(n, bool)
            entry[rows[why == 0]] = True
            full = np.zeros((2, n), np.int64)
            full[0, rows], full[1, rows] = e, v
            symmetric = np.asarray(col["symmetry"].to_numpy(zero_copy_only=False)) == "symmetric"
            yield pa.RecordBatch.from_arrays([
                col["file_id"], col["line_no"], pa.array(kind, pa.string()), pa.array(full[0], mask=~entry), pa.array(full[1], mask=~entry),
                pa.array(symmetric), pa.array(reason, pa.string()),
            ], names=["file_id", "line_no", "kind", "e", "v", "symmetric", "reason"])

    schema = "file_id bigint, line_no bigint, kind string, e bigint, v bigint, symmetric boolean, reason string"
    known = joined.select("file_id", "line_no", "line", "field", "symmetry", "nets", "vertices", "size_line", "bad_line", "bad_reason").mapInArrow(check, schema)
    nowhere = lines.where("file_id is null or line_no is null").selectExpr(
        "file_id", "line_no", "'reject' as kind", "cast(null as bigint) as e", "cast(null as bigint) as v", "false as symmetric", "'row has no place in a file' as reason"
    )
    return known.unionByName(nowhere)


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, reason) of the lines that fail."""
    return load_lines(lines).where("kind = 'reject'").select("file_id", "line_no", "reason")


def loaded_pins(lines: DataFrame) -> DataFrame:
    """(file_id, net_id, vertex_id), 0-based and distinct, of the valid entries; symmetric files also give (v, e)."""
    entries = load_lines(lines).where("kind = 'entry'")
    pairs = F.when(F.col("symmetric") & (F.col("e") != F.col("v")), F.array(F.struct("e", "v"), F.struct(F.col("v").alias("e"), F.col("e").alias("v")))).otherwise(F.array(F.struct("e", "v")))
    return entries.select("file_id", F.explode(pairs).alias("p")).select("file_id", (F.col("p.e") - 1).alias("net_id"), (F.col("p.v") - 1).alias("vertex_id")).distinct()
