"""Target-distribution importance resampling over hashed word runs.

Every text is a bag of its runs of 1 to 3 words, hashed into BUCKETS by CRC-32. A bucket's gain is the scaled, floored log of its smoothed
share among the target's runs over its share among the corpus's; a text's weight is the sum of gains over its runs. Documents are drawn without
replacement by adding Gumbel noise made from the document's id (the Gumbel top-k rule).

Work that depends on the text alone is done once a distinct text: rows are grouped by their full text and counted (Spark combines copies before
the shuffle), runs are hashed once, corpus totals multiply by the number of copies, and weights are joined back to the documents by the text's SHA-256 before
noise and ranks. The ranks come from a range sort and one offset a partition, so no task sees all scores.

Results: one row per document. A null text has no words, no runs and weight 0; equal scores go by the smaller doc_id; an empty corpus gives no rows, an
empty target a total of 0. One text is worked on in pieces, whatever its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import dropped, records, written
from evidara.llm.crc import extended, word_crcs
from evidara.llm.textarrays import LOWER, buffers, pieces, slices, word_spans
from evidara.plans.registry import table, texts

BUCKETS, RUN, SCALE = 10_000, 3, 1000
MIN_WORDS, PERCENT, SEED = 20, 5, 42
#: Bytes of text that a task works on at a time.
SLICE = 2 << 20
#: Words are ASCII letters, digits and all that is not ASCII.
OUTSIDE = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])
BLANK = np.uint32(0xE96CCF45)  # CRC-32 of one blank
BAGS = "digest binary, copies bigint, n_words bigint, n_features bigint, buckets binary, counts binary"


def run_buckets(data: np.ndarray, offsets: np.ndarray, before: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Bucket and row of every run, words of each row, and the last words (CRC, size). ``before``: the words that stood before a single row,
    for texts in pieces; runs that end in this piece count, however far back they begin."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, OUTSIDE)
    crc, size = word_crcs(data, starts, ends), ends - starts
    n_words, row = np.diff(first), np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(crc)) - first[row]
    old = 0
    if before is not None and len(before[0]):
        old = len(before[0])
        crc, size = np.concatenate([before[0], crc]), np.concatenate([before[1], size])
        row, place = np.zeros(len(crc), dtype=np.int64), np.arange(len(crc))
    led = extended(np.full(len(crc), BLANK), size) ^ crc  # of a blank and the word
    found, rows, runs = [crc[old:]], [row[old:]], crc
    for length in range(1, RUN):
        runs = np.concatenate([runs[:1], extended(runs[:-1], size[1:] + 1) ^ led[1:]])
        whole = place >= length
        whole[:old] = False
        found.append(runs[whole])
        rows.append(row[whole])
    return np.concatenate(found) % np.uint32(BUCKETS), np.concatenate(rows), n_words, (crc[1 - RUN :], size[1 - RUN :])


def _bags(rows: DataFrame) -> DataFrame:
    """Of (digest, copies, text): sorted buckets and how often each occurs, per row."""
    kinds = pa.schema([("digest", pa.binary()), ("copies", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary())])

    def bag(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = buffers(part.column(2))
        if part.num_rows == 1 and len(data) > SLICE:
            total, n_words, before = np.zeros(BUCKETS, dtype=np.int64), np.zeros(1, dtype=np.int64), None
            for piece in pieces(data, OUTSIDE, SLICE):
                bucket, _, n, before = run_buckets(piece, np.array([0, len(piece)]), before)
                total += np.bincount(bucket, minlength=BUCKETS)
                n_words += n
            key, n = np.flatnonzero(total), total[total > 0]
        else:
            bucket, row, n_words, _ = run_buckets(data, offsets)
            key, n = np.unique(row * BUCKETS + bucket, return_counts=True)
        bounds = np.searchsorted(key, np.arange(part.num_rows + 1) * BUCKETS)
        sums = np.concatenate([[0], np.cumsum(n)])
        raw, times = (key % BUCKETS).astype("<u2").tobytes(), n.astype("<u4").tobytes()
        spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        return pa.record_batch(
            [part.column(0), part.column(1), pa.array(n_words, pa.int64()), pa.array(np.diff(sums[bounds])), pa.array([raw[2 * a : 2 * b] for a, b in spans], pa.binary()), pa.array([times[4 * a : 4 * b] for a, b in spans], pa.binary())], schema=kinds
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield bag(part)

    return rows.select("digest", "copies", "text").mapInArrow(run, BAGS)


def bags(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row for each distinct text: its SHA-256, how many rows hold it, and its hashed runs."""
    whole = rows.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = whole.groupBy("text").agg(F.count("*").alias("copies"))
    return written(_bags(grouped.select(digest("text"), "copies", "text")))


def digest(text: str) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest")


def totals(found: DataFrame) -> np.ndarray:
    """Runs in each bucket over all rows, copies included: at most BUCKETS numbers, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for copies, buckets, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                sums[np.frombuffer(buckets.as_buffer(), dtype="<u2")] += copies * np.frombuffer(counts.as_buffer(), dtype="<u4").astype(np.int64)
        at = np.flatnonzero(sums)
        yield pa.record_batch({"bucket": pa.array(at, pa.int64()), "n": pa.array(sums[at])})

    out = np.zeros(BUCKETS, dtype=np.int64)
    for x in found.select("copies", "buckets", "counts").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[x["bucket"]] = x["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(SCALE * math.log((b + 1.0) * (s + BUCKETS) / ((a + 1.0) * (t + BUCKETS)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(digest, n_words, n_features, weight) of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                int(gain[np.frombuffer(buckets.as_buffer(), dtype="<u2")] @ np.frombuffer(counts.as_buffer(), dtype="<u4").astype(np.int64))
                for buckets, counts in zip(batch.column(3), batch.column(4), strict=True)
            ]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(made, pa.int64())], names=["digest", "n_words", "n_features", "weight"])

    return found.select("digest", "n_words", "n_features", "buckets", "counts").mapInArrow(run, "digest binary, n_words bigint, n_features bigint, weight bigint")


def noise(key: str, seed: int = SEED) -> F.Column:
    """Scaled, floored Gumbel noise from the document's id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, draws: int) -> DataFrame:
    """(doc_id, rank) of the ``draws`` highest scores: rows sorted by range, then one offset a partition."""
    order = F.desc("score"), F.asc("doc_id")
    placed = written(scored.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", F.monotonically_increasing_id().alias("at")))
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, at = [], 0
    for x in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a partition
        before.append((x["part"], at))
        at += x["count"]
    offsets = scored.sparkSession.createDataFrame(before, "part bigint, before bigint")
    return placed.select("doc_id", part.alias("part"), inside.alias("inside")).join(offsets, "part").select("doc_id", (F.col("before") + F.col("inside") + 1).alias("rank")).where(F.col("rank") <= draws)


def resample(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (1, 2, ... of the drawn; null for all others)."""
    rows = records(docs, key, text).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found, wanted = bags(rows), bags(target, target_text)
    gain = gains(totals(found), totals(wanted))
    dropped(wanted)
    weighed = rows.select("doc_id", digest("text")).join(weights(found, gain), "digest")
    scored = written(weighed.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise("doc_id", seed)).alias("score")))
    dropped(found)
    able = scored.where(F.col("n_words") >= min_words).select("doc_id", "score")
    return scored.join(ranked(able, percent * able.count() // 100), "doc_id", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def query(spark, sf_dir: str) -> DataFrame:
    return resample(texts(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("n_words")
