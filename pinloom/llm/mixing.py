"""Mixing sources so that each has its target share of all tokens.

A classifier, fitted on a bounded sample of the rows that name their source, gives every document its posteriors over
the domains (the named sources). Each document then gets a rate, how often it is to be used, between 0 and the most
repeats its source allows and needs. Rates solve a least-squares problem by projected gradient: the expected tokens of
each domain under the posteriors are to be the target share of the total, where the tokens of each source are that
share already. A round is one distributed sum over the documents; what comes back are a few numbers for each source.
A document's rate follows from its own row and the steps of all rounds, so no table of rates is kept or collected.
Rates are turned into whole copies so that every source ends within half a document of its share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pinloom.llm.tokens import FOLDER, VOCABULARY, encoder
from pinloom.partitions import spread
from pinloom.storage import durable

BUCKETS = 4096
SAMPLE = 2000
SLICES = 4096


def fit_classifier(documents: DataFrame, domains: list[str], sample: int = SAMPLE, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Log probabilities (domains, BUCKETS) of token classes, with the log prior's share in the last column.

    Multinomial naive Bayes on at most `sample` labelled documents of each domain, those of the smallest hashes; counts
    are summed in the workers, domains * BUCKETS numbers come back. Rows are ranked only after a bound on the hash has
    left about two samples of each domain, so no large source is shuffled or sorted.
    """
    labelled = documents.where(F.col("source").isin(domains) & F.col("text").isNotNull()).select("doc_id", "source", "text")
    bound = labelled.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", (F.lit(2.0 * sample) / F.col("n")).alias("bound"))  # a row for each domain
    few = labelled.withColumn("h", uniform("doc_id")).join(F.broadcast(bound), "source").where(F.col("h") < F.col("bound"))
    rank = F.row_number().over(W.partitionBy("source").orderBy("h", "doc_id"))
    chosen = few.withColumn("r", rank).where(F.col("r") <= sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(domains), BUCKETS), np.int64)
        encode = encoder(folder, vocabulary).encode
        for batch in batches:
            for source, text in zip(batch.column("source").to_pylist(), batch.column("text").to_pylist()):
                sums[domains.index(source)] += np.bincount(np.asarray(encode(text), np.int64) % BUCKETS, minlength=BUCKETS)
        d, b = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(sums[d, b])], names=["d", "b", "n"])

    counts = np.ones((len(domains), BUCKETS))
    for row in chosen.select("source", "text").mapInArrow(count, "d int, b int, n bigint").groupBy("d", "b").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["d"], row["b"]] += row["n"]
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def uniform(key: str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 52)).cast("double") / float(1 << 52)


def posteriors(ids: list[int], log_probabilities: np.ndarray) -> np.ndarray:
    """Domain posteriors of a document; evidence is averaged over tokens and tempered, since tokens of one text are far
    from independent. Without tokens all domains are equally likely."""
    n = len(log_probabilities)
    if not ids:
        return np.full(n, 1 / n)
    score = log_probabilities[:, np.asarray(ids, np.int64) % BUCKETS].mean(axis=1) * min(len(ids), 32)
    p = np.exp(score - score.max())
    return p / p.sum()


@dataclass
class Sums:
    """Of all documents under some rates, by source: their tokens times the rates, and the tokens of those whose rate
    may still move; by domain: expected tokens times the rates."""

    tokens: np.ndarray
    free: np.ndarray
    expected: np.ndarray


Step = tuple[np.ndarray, np.ndarray]


def rates_after(steps: list[Step], start: np.ndarray, cap: np.ndarray, source: np.ndarray, domain: np.ndarray) -> np.ndarray:
    """The rates of documents after the steps (by source, by domain), each followed by the projection on 0 to cap."""
    x, most = start[source], cap[source]
    for by_source, by_domain in steps:
        x = np.clip(x - by_source[source] - domain @ by_domain, 0, most)
    return x


def solve_rates(sums: Callable[[list[Step]], Sums], available: np.ndarray, wanted: np.ndarray, rounds: int = 10, settle: int = 10, close: float = 1e-4) -> list[Step]:
    """The steps of the projected gradient, found by one call of `sums` a round.

    A gradient step is (expected - wanted) over the tokens that the domain has in all, which bounds the curvature, so
    the squares of the domains' errors never rise by it. The shift that brings a source back to its wanted tokens is a
    Newton step for its part of the projection. The last `settle` rounds only do that, until every source is `close`.
    """
    steps: list[Step] = []
    none = np.zeros(len(wanted))
    for r in range(rounds + settle):
        now = sums(steps)
        off = now.tokens - wanted
        if r >= rounds and np.all(np.abs(off) <= close * np.maximum(wanted, 1)):
            break
        shift = np.where(now.free > 0, off / np.maximum(now.free, 1e-9), 0.0)
        steps.append((shift, (now.expected - wanted) / np.maximum(available, 1e-9) if r < rounds else none))
    return steps


def fill(rows: DataFrame) -> DataFrame:
    """`rows(s, key, doc_id, grow, room)` with `more`: whether the row is among those that, in the order of (key,
    doc_id) within s, fill `room` up with their `grow` to the nearest row. Keys are in [0, 1); room is the same within s.

    Only the place of the cut is looked for: sums over slices of the key name the slice it lies in, sums over slices of
    that one a finer one, and only the rows of the finer slice, one in 16 million, are ranked.
    """
    wide = rows.withColumn("_a", F.floor(F.col("key") * SLICES)).withColumn("_b", F.floor((F.col("key") * SLICES - F.col("_a")) * SLICES))
    first = wide.join(F.broadcast(_cut(wide, "_a", F.lit(0)).select("s", F.col("_cut").alias("_cut_a"), F.col("_before").alias("_before_a"))), "s", "left")
    inside = first.where(F.col("_a") == F.col("_cut_a"))
    second = _cut(inside, "_b", F.col("_before_a")).select("s", F.col("_cut").alias("_cut_b"), F.col("_before").alias("_before_b"))
    placed = first.join(F.broadcast(second), "s", "left")
    last = (F.col("_a") == F.col("_cut_a")) & (F.col("_b") == F.col("_cut_b"))
    filled = F.col("_before_b") + F.sum("grow").over(W.partitionBy("s").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    ranked = placed.where(last).withColumn("more", (F.col("grow") > 0) & (filled - F.col("grow") / 2 < F.col("room")))
    before = F.col("_cut_a").isNull() | (F.col("_a") < F.col("_cut_a")) | ((F.col("_a") == F.col("_cut_a")) & (F.col("_cut_b").isNull() | (F.col("_b") < F.col("_cut_b"))))
    others = placed.where(~F.coalesce(last, F.lit(False))).withColumn("more", (F.col("grow") > 0) & before)
    return others.unionByName(ranked).drop("_a", "_b", "_cut_a", "_before_a", "_cut_b", "_before_b")


def _cut(rows: DataFrame, slice_of: str, begin: Column) -> DataFrame:
    """(s, _cut, _before): the slice in which the running sum of `grow` reaches `room`, and the sum before it; no row
    for an s whose rows don't fill it. At most SLICES sums for each s."""
    sums = rows.groupBy("s", slice_of).agg(F.sum("grow").alias("g"), F.min("room").alias("room"), F.min(begin).alias("begin"))
    running = F.sum("g").over(W.partitionBy("s").orderBy(slice_of)) + F.col("begin")
    reached = sums.withColumn("c", running).where(F.col("c") >= F.col("room"))
    first = reached.groupBy("s").agg(F.min(F.struct(slice_of, (F.col("c") - F.col("g")).alias("before"))).alias("m"))
    return first.select("s", F.col(f"m.{slice_of}").alias("_cut"), F.col("m.before").alias("_before"))


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, sample: int = SAMPLE, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, n_tokens, copies) and its shares, one row for each target source:
    (source, target_share, max_repeats, available_tokens, wanted_tokens, reached_tokens, reached_share).

    `documents(doc_id, text, source)`; sizes are tokens of the vocabulary. `targets(source, target_share,
    max_repeats)`: a few rows; shares are taken relative to their sum, a repeated source counts once (its first row in
    order), rows with a null or a share of 0 or less count for nothing. A document whose source is null or not a
    target takes no part. Only documents with copies of at least 1 are in the mixture. Texts without tokens
    need no room and are left out. Without `total_tokens` the total is the largest at which every source that has any
    tokens can reach its share; with it, a source that can't stays at max_repeats copies of everything. Sources without
    tokens reach 0; the others then share the total in proportion. No documents give an empty mixture.
    """
    rows = sorted({r["source"]: (r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in sorted(
        targets.where("source is not null and target_share > 0 and max_repeats is not null").select("source", "target_share", "max_repeats").collect(), reverse=True)}.values())
    domains = [r[0] for r in rows]
    named = documents.where(F.col("source").isin(domains) & F.col("doc_id").isNotNull()).select("doc_id", "source", "text")
    model = fit_classifier(named, domains, sample, folder, vocabulary) if domains else np.zeros((0, BUCKETS))

    k = len(domains)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(folder, vocabulary).encode, {d: i for i, d in enumerate(domains)}
        for batch in batches:
            ids = [encode(t) for t in batch.column("text").to_pylist()]
            source = pa.array([number[s] for s in batch.column("source").to_pylist()], pa.int32())
            domain = pa.array([posteriors(i, model).astype(np.float32) for i in ids], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), source, pa.array([len(i) for i in ids], pa.int64()), domain], names=["doc_id", "s", "n_tokens", "domain"])

    key_type = documents.schema["doc_id"].dataType.simpleString()
    sized = durable(spread(named).mapInArrow(measure, f"doc_id {key_type}, s int, n_tokens bigint, domain array<float>").where("n_tokens > 0"))

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = batch.column("domain").flatten().to_numpy(zero_copy_only=False)
        return batch.column("s").to_numpy(zero_copy_only=False), batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(float), flat.reshape(-1, k)

    def summed(steps: list[Step], start: np.ndarray, cap: np.ndarray) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens, free, expected = np.zeros(k), np.zeros(k), np.zeros(k)
            for batch in batches:
                source, size, domain = arrays(batch)
                x = rates_after(steps, start, cap, source, domain)
                tokens += np.bincount(source, size * x, k)
                free += np.bincount(source, size * ((x > 0) & (x < cap[source])), k)
                expected += (size * x) @ domain
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), *map(pa.array, (tokens, free, expected))], names=["s", "tokens", "free", "expected"])

        out = Sums(np.zeros(k), np.zeros(k), np.zeros(k))
        total = [F.sum(c).alias(c) for c in ("tokens", "free", "expected")]
        for row in sized.select("s", "n_tokens", "domain").mapInArrow(run, "s bigint, tokens double, free double, expected double").groupBy("s").agg(*total).collect():
            out.tokens[row["s"]], out.free[row["s"]], out.expected[row["s"]] = row["tokens"], row["free"], row["expected"]
        return out

    share, cap = np.array([r[1] for r in rows]), np.array([max(0, r[2]) for r in rows], float)
    all_once = summed([], np.ones(k), np.full(k, 2.0)) if k else Sums(*np.zeros((3, 0)))
    have = np.round(all_once.tokens)
    active = (have > 0) & (cap > 0)
    part = np.where(active, share, 0)
    part = part / part.sum() if part.sum() else part
    total = float(total_tokens) if total_tokens is not None else min((cap[active] * have[active] / part[active]).tolist(), default=0.0)
    wanted = np.floor(np.minimum(part * total, cap * have) + 1e-6)
    # nothing is repeated that need not be: a source with enough tokens uses no document twice
    cap = np.minimum(cap, np.maximum(1, np.ceil(wanted / np.maximum(have, 1) - 1e-9)))
    start = np.minimum(cap, wanted / np.maximum(have, 1))
    steps = solve_rates(lambda made: summed(made, start, cap), all_once.expected, wanted) if have.any() else []
    spark = documents.sparkSession

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, _, domain = arrays(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "s", "n_tokens")), pa.array(rates_after(steps, start, cap, source, domain))], names=["doc_id", "s", "n_tokens", "rate"])

    # whole copies below the rate for all, one more for as many as fill the source's tokens up
    rated = durable(sized.mapInArrow(rate, f"doc_id {key_type}, s int, n_tokens bigint, rate double").withColumn("base", F.floor(F.col("rate") + 1e-9)))
    limits = spark.createDataFrame([(i, d, int(c), int(w)) for i, (d, c, w) in enumerate(zip(domains, cap, wanted))], "s int, source string, most int, wanted bigint")
    used = rated.groupBy("s").agg(F.sum(F.col("base") * F.col("n_tokens")).alias("used"))
    room = limits.join(F.broadcast(used), "s").select("s", "source", "most", (F.col("wanted") - F.col("used")).alias("room"))
    key = uniform("doc_id") / F.greatest(F.col("rate") - F.col("base"), F.lit(1e-6))
    growing = rated.join(F.broadcast(room), "s").withColumn("key", key / (1 + key)).withColumn("grow", F.when(F.col("base") < F.col("most"), F.col("n_tokens")).otherwise(0))
    taken = fill(growing).withColumn("copies", (F.col("base") + F.col("more").cast("int")).cast("bigint"))
    mixture = durable(taken.where("copies > 0").select("doc_id", "source", "n_tokens", "copies"))
    reached = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached_tokens"))
    goal = spark.createDataFrame([(d, float(s), int(r[2]), int(h), int(w)) for d, s, r, h, w in zip(domains, share, rows, have, wanted)], "source string, target_share double, max_repeats int, available_tokens bigint, wanted_tokens bigint")
    shares = goal.join(reached, "source", "left").withColumn("reached_tokens", F.coalesce("reached_tokens", F.lit(0)).cast("bigint"))
    everything = shares.agg(F.sum("reached_tokens").alias("all"))
    shares = shares.join(F.broadcast(everything)).withColumn("reached_share", F.when(F.col("all") > 0, F.round(F.col("reached_tokens") / F.col("all"), 9)).otherwise(F.lit(0.0))).drop("all")
    return mixture, shares
