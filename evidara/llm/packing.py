"""Mixture-controlled packing: deficit round-robin over source queues, windows filled to target proportions.

Each source is a queue of its documents' token ids, in order of doc_id. Windows of ``size`` tokens take from every queue its target share;
what rounding leaves of a share is the queue's deficit and goes to later windows. The scheduler has a closed form: after y tokens in all, a
queue has been given the share of y that a balanced tree of the queues hands down, each node giving its left half floor(y * left / all) and its
right half the rest. That grows with y, adds up to y exactly, and stays within one token a level of the target, so any task can place
any document knowing only the queue totals: deficits carry across windows and partitions alike. When a queue with a target above its supply runs dry, the
others share on in their proportions (a new phase).

Targets are given by source (``weights``; sources that it does not name share one queue, which comes after all others), or are the supplies to a power:
1 spreads every source evenly over all windows, less gives small sources more of the early windows. Then the QUEUES sources with the most
documents have queues of their own and all others share one more. No source ever shares a queue with a named one.

The last, partial window is cut into sequences of powers of two, which need no padding.

Results: one row per piece; a null or empty text still has its end id; a null source is a source of its own; an empty
table gives no rows. Sequences depend on the table alone, not on how it is dealt over partitions or machines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.common import records, written
from evidara.llm.textarrays import leaves_nothing, slices
from evidara.llm.tokens import END_ID, KEEP, binary, encoder, id_width, release

SIZE = 4096
QUEUES = 1024
#: Bytes of text that a task encodes at a time.
SLICE = 2 << 20
#: Power of the supplies that are the query's targets.
POWER = 0.7
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


@dataclass
class Phase:
    """A stretch of the output in which the same queues take part. supply: tokens of each queue in it, in queue order."""

    start: int
    total: int
    supply: list[int]
    used: list[int]

    def __post_init__(self):
        self.sums = np.concatenate([[0], np.cumsum(np.array(self.supply, dtype=np.int64))])


def phases(totals: list[int], weights: list[float] | None = None) -> list[Phase]:
    """Phases from queue totals and target weights (default: the totals). A queue without weight comes last of all."""
    left, out, at = list(totals), [], 0
    while any(left):
        live = [i for i, n in enumerate(left) if n and (weights is None or weights[i] > 0)] or [i for i, n in enumerate(left) if n]
        share = {i: (totals[i] if weights is None else weights[i] or totals[i]) for i in live}
        scale = min(left[i] / share[i] for i in live)
        take = [min(left[i], int(share[i] * scale + 0.5)) if i in share else 0 for i in range(len(left))]
        dry = min(live, key=lambda i: left[i] / share[i])
        take[dry] = left[dry]
        if weights is None:
            take = list(left)
        used = [t - n for t, n in zip(totals, left, strict=True)]
        out.append(Phase(at, sum(take), take, used))
        at += sum(take)
        left = [n - t for n, t in zip(left, take, strict=True)]
    return out


def given(phase: Phase, queue: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that a queue, and all queues before it, have been given after y tokens of the phase."""
    sums = phase.sums
    y = y.astype(object) if phase.total >= 1 << 31 else y.astype(np.int64)
    before, lo, hi = y * 0, 0, len(phase.supply)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        n = int(sums[hi] - sums[lo])
        left = y * int(sums[mid] - sums[lo]) // max(n, 1)
        if queue < mid:
            y, hi = left, mid
        else:
            before, y, lo = before + left, y - left, mid
    return y, before


def sequence_starts(total: int, size: int, lo: int, hi: int) -> np.ndarray:
    """Starts of the sequences that touch [lo, hi), and the end of the last."""
    full = total // size
    first, last = min(lo // size, full), min(-(-hi // size), full)
    starts = [*range(first * size, last * size + 1, size)]
    if hi > full * size:
        at = full * size
        for bit in range(size.bit_length(), -1, -1):
            if (total - full * size) >> bit & 1:
                at += 1 << bit
                starts.append(at)
    return np.array(starts, dtype=np.int64)


def sequence_number(start: np.ndarray, total: int, size: int) -> np.ndarray:
    """Number of the sequence that starts there."""
    full = total // size
    tail = sequence_starts(total, size, full * size, total) if total > full * size else np.array([full * size])
    return np.where(start < full * size, start // size, full + np.searchsorted(tail, start))


def cut(plan: list[Phase], queue: int, lo: int, hi: int, size: int) -> tuple[np.ndarray, ...]:
    """Where the stream of a queue is cut between lo and hi: queue position, sequence number and offset of each cut.

    Each phase is a tree of its own; a window across two phases has segments from both."""
    total = plan[-1].start + plan[-1].total
    out = []
    for phase in plan:
        own, used = phase.supply[queue], phase.used[queue]
        a, b = max(lo, used) - used, min(hi, used + own) - used
        if a >= b:
            continue
        slack = len(phase.supply).bit_length() + 2
        y0 = max(0, (a - slack) * phase.total // own - 1)
        y1 = min(phase.total, (b + slack) * phase.total // own + 1)
        starts = sequence_starts(total, size, phase.start + y0, phase.start + y1)
        edges = np.unique(np.clip(np.concatenate([starts, [phase.start, phase.start + phase.total]]), phase.start, phase.start + phase.total))
        got, before = given(phase, queue, edges - phase.start)
        got, before = got.astype(np.int64), before.astype(np.int64)
        seq_start = starts[np.clip(np.searchsorted(starts, edges[:-1], side="right") - 1, 0, None)]
        offset = edges[:-1] - seq_start + np.diff(before)
        keep = (got[1:] > got[:-1]) & (got[1:] > a) & (got[:-1] < b)
        out.append((used + got[:-1][keep], sequence_number(seq_start, total, size)[keep], offset[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def queued(docs: DataFrame, *, key: str, text: str, source: str, named: list[str | None] | None) -> tuple[DataFrame, list[str | None]]:
    """(queue, doc_id, text) and the sources that have queues of their own, by queue number; the next number is for all others."""
    spark = docs.sparkSession
    rows = records(docs.select(key, text, source), key, text, source).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
    if named is None:
        most = rows.groupBy("source").count().orderBy(F.desc("count"), "source").limit(QUEUES)
        named = [x["source"] for x in most.collect()]
    named = sorted(named, key=lambda x: (x is not None, x))
    numbers = spark.createDataFrame([(x, i) for i, x in enumerate(named)], "_source string, queue int")
    found = rows.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("_source")), "left")  # QUEUES rows, or those of the weights
    return found.select(F.coalesce("queue", F.lit(len(named))).alias("queue"), "doc_id", "text"), named


def tokenised(rows: DataFrame, tokenizer: str, end: int = END_ID, keep: int = KEEP, release_after: bool = False, limit: int = SLICE) -> DataFrame:
    """(queue, own, doc_id, n, ids, part) in order of queue and doc_id over parts; ids little-endian, two bytes each if the vocabulary
    allows, else four; own: ids before the document's in its part's queue."""
    width = id_width(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        own = encoder(tokenizer, keep)
        for batch in batches:
            for part in slices(batch, "text", limit):
                ids, bounds = own.encode(part.column(2), end)
                before = []
                sizes = np.diff(bounds)
                for q, n in zip(part.column(0).to_pylist(), sizes.tolist(), strict=True):
                    before.append(sums.get(q, 0))
                    sums[q] = before[-1] + n
                yield pa.record_batch([part.column(0), pa.array(before, pa.int64()), part.column(1), pa.array(sizes), binary(ids.astype(width), bounds)], names=["queue", "own", "doc_id", "n", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encode(batches)
        if release_after:
            release()

    ordered = rows.repartitionByRange("queue", "doc_id").sortWithinPartitions("queue", "doc_id")
    return ordered.mapInArrow(run, "queue int, own bigint, doc_id bigint, n bigint, ids binary").withColumn("part", F.spark_partition_id())


def pack(
    docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", source: str = "source", size: int = SIZE, end: int = END_ID,
    weights: dict[str | None, float] | None = None, power: float = 1.0, keep: int = KEEP, release_after: bool = False, limit: int = SLICE,
) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    weights: target proportion of each source; without, targets are the supplies to the given power.
    keep: bytes of a generation of a worker's store of ids. release_after: tasks give back the memory of their encoder, which the next task then loads anew.
    limit: bytes of text that a task encodes at a time, some 75 bytes of arrays for each."""
    rows, named = queued(docs, key=key, text=text, source=source, named=None if weights is None else list(weights))
    table = written(tokenised(rows, tokenizer, end, keep, release_after, limit))
    sums = table.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    totals = [0] * (len(named) + 1)
    for x in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect():  # one row a queue
        totals[x["queue"]] = x["n"]
    if weights is not None:
        plan = phases(totals, [float(weights[x]) for x in named] + [0.0])
    else:
        plan = phases(totals, None if power == 1 else [float(n) ** power for n in totals])
    earlier = F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select("part", "queue", F.coalesce(earlier, F.lit(0)).alias("before"))
    # parts are ranges of queues: there are fewer rows than parts and queues together
    placed = table.join(F.broadcast(before), ["part", "queue"]).select("queue", (F.col("before") + F.col("own")).alias("at"), "doc_id", "n", "ids")

    width = id_width(tokenizer)

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queue, at, doc, n = (batch.column(i).to_pylist() for i in range(4))
            ids = batch.column(4)
            order = sorted(range(len(at)), key=lambda i: (queue[i], at[i]))
            out, i = [], 0
            while i < len(order):
                j, q = i + 1, queue[order[i]]
                while j < len(order) and queue[order[j]] == q and at[order[j]] == at[order[j - 1]] + n[order[j - 1]]:
                    j += 1
                run = order[i:j]
                lo, hi = at[run[0]], at[run[-1]] + n[run[-1]]
                pos, seq, offset = cut(plan, q, lo, hi, size)
                for d in run:
                    raw = np.frombuffer(ids[d].as_buffer(), dtype=width).astype("<u4").tobytes()
                    a, b = at[d], at[d] + n[d]
                    k = int(np.searchsorted(pos, a, side="right")) - 1
                    while a < b:
                        c = min(b, int(pos[k + 1])) if k + 1 < len(pos) else b
                        piece = raw[4 * (a - at[d]) : 4 * (c - at[d])]
                        out.append((doc[d], a - at[d], c - a, zlib.crc32(piece), n[d], int(seq[k]), int(offset[k]) + a - int(pos[k]), piece))
                        a, k = c, k + 1
                i = j
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(leaves_nothing(cut_all) if release_after else cut_all, PIECES)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), power=POWER).drop("ids")
