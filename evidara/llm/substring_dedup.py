"""Word-window dedup with difference-cover anchors.

A perfect difference set D modulo P has, for any two positions i and j, a shift d < P that brings both onto positions that are in D
modulo P. So only windows of ``window - P + 1`` words at cover positions are hashed: two equal windows of ``window`` words, wherever they start, share an
anchor at the same distance from their starts. Anchors whose hash occurs once in the corpus are dropped; around the others
the full windows are digested (128 bits of BLAKE2b over the words themselves, one blank between), and those whose digest occurs in more than
one place cover the words to remove.

Steps: anchors by hash (a window count, sorted and spilled, nothing gathered per hash); anchor positions per document; window
digests around them; positions per document again. No hash is a hot key: one that a bounded sample of the documents holds twice is known as repeated and
needs no counting, and of one that several rows of a slice of texts hold only one row is counted, the others being known as repeated.

Results: one row per document. Null texts have no words. Documents shorter than the window lose nothing. Every occurrence goes,
the first too; overlaps and occurrences within one document count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.common import NAMED, dropped, records, sampled, written
from evidara.llm.textarrays import among, buffers, cover, digests, mix, runs, single_spaced, slices, spread, word_hashes, word_spans, word_windows
from evidara.plans.registry import texts

WINDOW = 35
#: Bytes of text that a task works on at a time.
SLICE = 1 << 20
#: Perfect difference sets, by modulus.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
NOTHING = np.zeros((0, 2), dtype=np.uint64)
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept binary"


def period(window: int) -> int:
    """The largest modulus that leaves anchors of two fifths of the window at least."""
    return max(p for p in COVERS if p == 1 or window - p + 1 >= 0.4 * window)


def _positions(first: np.ndarray) -> np.ndarray:
    """Word number within its row, for all words of a batch."""
    return np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))


def _room(first: np.ndarray, width: int) -> np.ndarray:
    """Which word positions have width words of their row from there on."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])
    return left >= width


def anchors(docs: DataFrame, window: int, known: np.ndarray = NOTHING) -> DataFrame:
    """(h, doc_id, pos): hash of the anchor window at every cover position; -1 - pos where it is known as repeated: by the slice, or by ``known``."""
    p = period(window)
    width = window - p + 1
    covered = np.isin(np.arange(p), COVERS[p])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, offsets = buffers(part.column(1))
                starts, ends, first = word_spans(data, offsets)
                h = word_windows(word_hashes(data, starts, ends), width)
                pos = _positions(first)
                # a document without room for one whole window has no anchors
                whole = np.repeat(np.diff(first) >= window, np.diff(first))
                at = np.flatnonzero((covered[pos % p] & _room(first, width) & whole)[: len(h)])
                row = np.searchsorted(first, at, side="right") - 1
                _, several, h = spread(h[at])
                sure = among(h, known[:, 0])
                h = np.where(sure, mix(h + np.arange(len(h), dtype=np.uint64), 0x5B), h)
                pos = np.where(several | sure, -1 - pos[at], pos[at])
                yield pa.record_batch({"h": pa.array(h.view(np.int64)), "doc_id": pa.array(part.column(0).to_numpy()[row], pa.int64()), "pos": pa.array(pos.astype(np.int32))})

    return docs.mapInArrow(run, "h bigint, doc_id bigint, pos int")


def windows(docs: DataFrame, window: int, known: np.ndarray = NOTHING) -> DataFrame:
    """(h1, h2, doc_id, pos): digest of every full window that holds one of the document's anchors ``at``; -1 - pos where it is known
    as repeated (by the slice, or by ``known``), and no h2 where it needs no counting."""
    p = period(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, offsets = buffers(part.column(1))
                starts, ends, first = word_spans(data, offsets)
                raw, starts, ends = single_spaced(data, starts, ends)
                found = part.column(2)
                n = np.diff(found.offsets.to_numpy())
                anchor = np.repeat(first[:-1], n) + found.flatten().to_numpy()
                # an anchor that a match shares lies less than P words from the match's start
                low = np.maximum(anchor - (p - 1), np.repeat(first[:-1], n))
                at = np.flatnonzero(cover(first[-1], low, anchor + 1) & _room(first, window))
                row = np.searchsorted(first, at, side="right") - 1
                h1, h2 = digests(raw, starts[at], ends[at + window - 1])
                sure = among(h1, known[:, 0])
                sure[sure] = known[np.searchsorted(known[:, 0], h1[sure]), 1] == h2[sure]
                later, several, h1 = spread(h1, second=h2)
                h1 = np.where(sure, mix(h1 + np.arange(len(h1), dtype=np.uint64), 0x5B), h1)
                pos = at - first[row]
                yield pa.record_batch(
                    {
                        "h1": pa.array(h1.view(np.int64)), "h2": pa.array(h2.view(np.int64), mask=later | sure),
                        "doc_id": pa.array(part.column(0).to_numpy()[row], pa.int64()), "pos": pa.array(np.where(several | sure, -1 - pos, pos).astype(np.int32)),
                    }
                )

    return docs.mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint, pos int")


def _known(df: DataFrame, *keys: str) -> np.ndarray:
    """The most common of the keys that rows of a sample repeat, one a row, sorted: at most NAMED."""
    found = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").orderBy(F.desc("_n"), *keys).limit(NAMED)
    known = np.array([tuple(x) for x in found.select(*keys).collect()], dtype=np.int64).reshape(-1, len(keys)).view(np.uint64)
    return known[np.argsort(known[:, 0])]


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Positions per document of the rows that are known as repeated (negative positions) or whose key occurs more than once."""
    counted = df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n > 1 or pos < 0")
    return counted.groupBy("doc_id").agg(F.collect_list(F.when(F.col("pos") < 0, -1 - F.col("pos")).otherwise(F.col("pos"))).alias("at"))


def remove_repeated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, spans of removed words, kept (remaining words, joined by one blank, UTF-8)."""
    texts = records(docs, key, text).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    few = sampled(texts, "doc_id")
    known = _known(anchors(few, window), "h")
    hits = written(_repeated(anchors(texts, window, known), "h"))
    around = lambda rows: rows.join(hits, "doc_id").select("doc_id", "text", "at")
    known = _known(windows(around(few), window).where("h2 is not null"), "h1", "h2")
    found = written(_repeated(windows(around(texts), window, known), "h1", "h2"))
    dropped(hits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                n_words, n_removed, spans, kept = [], [], [], []
                for raw, at in zip(part.column(1), part.column(2), strict=True):
                    words = (raw.as_buffer().to_pybytes() if raw.is_valid else b"").split()
                    at = at.values.to_numpy() if at.is_valid else np.zeros(0, np.int64)
                    gone = cover(len(words), at, at + window)
                    a, b = runs(gone)
                    n_words.append(len(words))
                    n_removed.append(int(gone.sum()))
                    spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                    edges = [0, *(x for y in zip(a.tolist(), b.tolist(), strict=True) for x in y), len(words)]
                    kept.append(b" ".join(w for i in range(0, len(edges), 2) for w in words[edges[i] : edges[i + 1]]))
                yield pa.record_batch([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return texts.join(found, "doc_id", "left").select("doc_id", "text", "at").mapInArrow(run, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    found = remove_repeated(texts(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
