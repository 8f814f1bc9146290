"""Exact byte-level dedup with suffix arrays by Lyndon grouping.

Equal strings of ``window`` bytes are found where they can be: every window holds one anchor, the substring of half its length with the
smallest hash among those in it, and equal windows have equal anchors at equal places. Anchors that occur once are dropped. The
surroundings of an anchor (all windows that hold it) are a context. Equal contexts (anchors with equal hashes, contexts with equal XXH3 of their bytes) count
once: the first occurrence in order of (doc_id, position) stands for them and all others lose every window of theirs. Where an anchor has several
different contexts, the bytes of their first occurrences are fetched; a suffix array over these contexts (``suffix_array``:
Lyndon groups, over units of 8 bytes that are cut outward from the anchor) brings windows with a common start next to each
other, common-prefix lengths split them into classes of equal windows, and in each class all but the first occurrence are removed.

Every step is a shuffle on the anchor's hash or on doc_id; a task reads its anchors as a sorted stream. No anchor is a hot key: one that a bounded sample
of the documents names as common is dealt by its contexts too. Contexts of one anchor are solved together, up to SPLIT of them; the windows of
an anchor with more are digested one by one (128 bits of BLAKE2b) and the first of each is found by a shuffle on the digests.

Results: one row per document, null texts empty. A byte goes if a window over it also starts earlier (smaller doc_id, or same
document and earlier start); windows are judged on the input. Documents shorter than the window lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

import xxhash
from evidara.llm.common import NAMED, dropped, records, sampled, written
from evidara.llm.suffix_array import suffix_array
from evidara.llm.textarrays import among, buffers, byte_windows, cover, digests, mix, runs, slices, sliding_argmin, spread
from evidara.plans.registry import texts

WINDOW = 100
#: Bytes of text that a task works on at a time.
SLICE = 1 << 20
UNIT = 8
#: Contexts that one suffix array holds, when their anchors have fewer each.
TOGETHER = 4096
#: Different contexts of one anchor that one suffix array holds at most; contexts of anchors with more that a task works on at a time.
SPLIT, AT_ONCE = 8192, 2048
#: Rows of a sample that make an anchor common, and what marks it in column left.
OFTEN, COMMON = 10, 1 << 14
NOTHING = np.zeros(0, dtype=np.uint64)
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept binary"


def anchors(docs: DataFrame, window: int, common: np.ndarray) -> DataFrame:
    """(h, c, doc_id, pos, left, right): hashes of each anchor and of its context, and the context's bytes on both sides. Rows that are not
    the first of their kind in the slice are known as copies: they have no c, and an h of their own. Common anchors have an h for each context, and left + COMMON."""
    k = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, offsets = buffers(part.column(1))
                h = byte_windows(data, k)
                at = sliding_argmin(h, window - k + 1)
                row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
                at = np.unique(at[row[: len(at)] == row[window - 1 : window - 1 + len(at)]])
                row = row[at]
                lo, hi = np.maximum(offsets[row], at - (window - k)), np.minimum(offsets[row + 1], at + window)
                raw, h = data.tobytes(), h[at]
                c = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], dtype=np.uint64) ^ mix((at - lo).astype(np.uint64), 0x12)
                doc = part.column(0).to_numpy()[row]
                place = np.empty(len(at), np.int64)
                place[np.lexsort((at, doc))] = np.arange(len(at))
                often = among(h, common)
                both = mix(h) ^ c
                later, _, loose = spread(both, order=place)
                yield pa.record_batch(
                    {
                        "h": pa.array(np.where(later, loose, np.where(often, both, h)).view(np.int64)), "c": pa.array(c.view(np.int64), mask=later), "doc_id": pa.array(doc, pa.int64()),
                        "pos": pa.array((at - offsets[row]).astype(np.int32)), "left": pa.array((at - lo + np.where(often, COMMON, 0)).astype(np.int16)), "right": pa.array((hi - at - k).astype(np.int16)),
                    }
                )

    return docs.mapInArrow(run, "h bigint, c bigint, doc_id bigint, pos int, left smallint, right smallint")


def contexts(firsts: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """(h, doc_id, pos, left, right, bytes): the context of every listed anchor, filled up to 3/2 windows around the anchor."""
    k = window // 2
    side = window - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, offsets = buffers(part.column(1))
                padded = np.concatenate([np.zeros(side, np.uint8), data, np.zeros(window, np.uint8)])
                found = part.column(2)
                n = np.diff(found.offsets.to_numpy())
                items = found.flatten()
                pos, left, right = (items.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                at = np.repeat(offsets[:-1], n) + pos
                h = byte_windows(data, k)[at].view(np.int64)
                out = padded[at[:, None] + np.arange(side + window)]
                cols = np.arange(side + window)
                out[(cols < (side - left)[:, None]) | (cols >= (side + k + right)[:, None])] = 0
                width = side + window
                whole = pa.Array.from_buffers(pa.binary(width), len(out), [None, pa.py_buffer(np.ascontiguousarray(out))]).cast(pa.binary())
                doc = np.repeat(part.column(0).to_numpy(), n)
                yield pa.record_batch({"h": pa.array(h), "doc_id": pa.array(doc, pa.int64()), "pos": pa.array(pos), "left": pa.array(left), "right": pa.array(right), "bytes": whole})

    listed = firsts.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "left", "right")).alias("at"))
    joined = texts.join(listed, "doc_id").select("doc_id", "text", "at")
    return joined.mapInArrow(run, "h bigint, doc_id bigint, pos int, left smallint, right smallint, bytes binary")


def equal_windows(h: np.ndarray, rank: np.ndarray, left: np.ndarray, right: np.ndarray, table: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows with an earlier equal one in another context: (context, bytes from window start to anchor) pairs.

    table: bytes of the contexts, anchors in the same columns."""
    k = window // 2
    side = window - k
    m = len(h)
    n_left, n_right = left.astype(np.int64) // UNIT, -(-right.astype(np.int64) // UNIT)
    depth, reach = side // UNIT, -(-side // UNIT)
    # units cut outward from the anchor, as numbers in byte order; then anchor and end marks
    lefts = np.stack([table[:, side - UNIT * (j + 1) : side - UNIT * j] for j in range(depth)], axis=1) if depth else np.zeros((m, 0, UNIT), np.uint8)
    rights = np.zeros((m, reach, UNIT), np.uint8)
    rights.reshape(m, -1)[:, :side] = table[:, side + k :]
    values = np.concatenate([lefts, rights], axis=1).copy().view(">u8")[:, :, 0]
    _, code = np.unique(values, return_inverse=True)
    code = code.reshape(values.shape) + 2 * m + 1
    _, group = np.unique(h, return_inverse=True)
    width = depth + 1 + reach + 1
    grid = np.zeros((m, width), dtype=np.int64)
    grid[:, :depth] = code[:, :depth][:, ::-1]
    grid[:, depth] = m + 1 + group
    grid[:, depth + 1 : depth + 1 + reach] = code[:, depth:]
    cols = np.arange(width)
    used = (cols >= (depth - n_left)[:, None]) & (cols < (depth + 1 + n_right)[:, None])
    grid[np.arange(m), depth + 1 + n_right] = 1 + np.arange(m)
    used[np.arange(m), depth + 1 + n_right] = True
    owner, kind = np.nonzero(used)
    order = np.array(suffix_array([*grid[used].tolist(), 0]))[1:]
    order_owner, order_start = owner[order], depth - kind[order]  # units before the anchor where the suffix starts
    out_context, out_back = [], []
    for j in range(depth + 1):
        rows = order_owner[order_start == j]
        if len(rows) < 2:
            continue
        body = table[rows, side - UNIT * j :]
        differ = body[1:] != body[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), body.shape[1])
        # beyond a short context its bytes are zeros; windows that would need them are left out by ``fits``
        common[group[rows[1:]] != group[rows[:-1]]] = 0
        for back in range(UNIT * j, min(UNIT * (j + 1), side + 1)):
            extra = back - UNIT * j
            same = np.concatenate([[0], np.cumsum(common < window - extra)])
            ahead = np.zeros((len(rows), UNIT), np.uint8)  # the window's bytes before the unit
            ahead[:, :extra] = table[rows, side - back : side - back + extra]
            _, key = np.unique(np.stack([same.view(np.uint64), ahead.view("<u8")[:, 0]], axis=1), axis=0, return_inverse=True) if extra else (None, same)
            fits = (left[rows] >= back) & (right[rows] >= window - k - back)
            own = rows[fits]
            key = key[fits]
            at = np.lexsort((rank[own], key))
            again = np.zeros(len(own), dtype=bool)
            again[1:] = key[at[1:]] == key[at[:-1]]
            out_context.append(own[at[again]])
            out_back.append(np.full(int(again.sum()), back))
    return (np.concatenate(out_context), np.concatenate(out_back)) if out_context else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def digested_ranges(found: DataFrame, window: int) -> DataFrame:
    """(doc_id, start, end) to remove in the contexts of ``found``, any number of them for one anchor: windows by their digests."""
    k = window // 2
    side = window - k

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                doc, pos, left, right = (part.column(x).to_numpy() for x in ("doc_id", "pos", "left", "right"))
                raw = b"".join(x.as_buffer() for x in part.column("bytes"))
                back = np.arange(side + 1)
                row, back = np.nonzero((back <= left[:, None]) & (back >= window - k - right[:, None]))
                start = row * (side + window) + side - back
                h1, h2 = digests(raw, start, start + window)
                # a window that holds several anchors is judged for each of them, at its place in the window
                h1 ^= mix(part.column("h").to_numpy().view(np.uint64), 0x21)[row] ^ mix(back.astype(np.uint64), 0x22)
                start = pos[row] - back
                place = np.empty(len(row), np.int64)
                place[np.lexsort((start, doc[row]))] = np.arange(len(row))
                later, _, h1 = spread(h1, second=h2, order=place)
                yield pa.record_batch({"h1": pa.array(h1.view(np.int64)), "h2": pa.array(h2.view(np.int64), mask=later), "doc_id": pa.array(doc[row]), "start": pa.array(start.astype(np.int32))})

    keyed = found.select("h", "doc_id", "pos", "left", "right", "bytes").mapInArrow(cut, "h1 bigint, h2 bigint, doc_id bigint, start int")
    number = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("doc_id", "start"))
    return keyed.withColumn("number", number).where("number > 1 or h2 is null").select("doc_id", "start", (F.col("start") + window).cast("int").alias("end"))


def mixed_ranges(found: DataFrame, window: int) -> DataFrame:
    """(doc_id, start, end) to remove in the contexts of anchors that have several, from ``contexts`` rows."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(parts).combine_chunks()
        h, doc, pos, left, right = (batch.column(x).to_numpy() for x in ("h", "doc_id", "pos", "left", "right"))
        table = np.frombuffer(b"".join(x.as_buffer() for x in batch.column("bytes").combine_chunks()), np.uint8).reshape(len(h), -1)
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((pos, doc))] = np.arange(len(h))
        context, back = equal_windows(h, rank, left, right, table, window)
        order = np.lexsort((back, context))
        context, back = context[order], back[order]
        # neighbouring starts make one range
        cut = np.flatnonzero((np.diff(context, prepend=-1) != 0) | (np.diff(back, prepend=-9) != 1))
        last = np.append(cut[1:], len(back))[: len(cut)] - 1
        at = context[cut]
        return pa.record_batch({"doc_id": pa.array(doc[at]), "start": pa.array((pos[at] - back[last]).astype(np.int32)), "end": pa.array((pos[at] - back[cut] + window).astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(key)) + 1
            if waiting and waiting[-1].column(0)[-1].as_py() != key[0] and sum(x.num_rows for x in waiting) >= TOGETHER:
                yield solve(waiting)
                waiting = []
            at = 0
            for c in cuts.tolist():
                if sum(x.num_rows for x in waiting) + c - at >= TOGETHER:
                    yield solve([*waiting, batch.slice(at, c - at)])
                    waiting, at = [], c
            if at < batch.num_rows:
                waiting.append(batch.slice(at))
        if waiting:
            yield solve(waiting)

    many = written(found.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT).select("h"))
    few = found.join(many, "h", "left_anti").select("h", "doc_id", "pos", "left", "right", "bytes")
    solved = few.repartition("h").sortWithinPartitions("h").mapInArrow(run, "doc_id bigint, start int, end int")
    return solved if many.isEmpty() else solved.union(digested_ranges(found.join(many, "h", "left_semi"), window))


def remove_repeated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans of removed bytes, kept (the remaining bytes)."""
    k = window // 2
    texts = records(docs, key, text).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    long_enough = texts.where(F.octet_length("text") >= window)
    often = anchors(sampled(long_enough, "doc_id"), window, NOTHING).groupBy("h").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(NAMED)
    common = np.sort(np.array([x["h"] for x in often.collect()], dtype=np.int64).view(np.uint64))
    rows = anchors(long_enough, window, common).repartition("h")
    first = (F.row_number().over(Window.partitionBy("h", "c").orderBy("doc_id", "pos")) == 1) & F.col("c").isNotNull()
    by_anchor = Window.partitionBy("h")
    rows = rows.withColumn("first", first).withColumn("mixed", (F.min("c").over(by_anchor) != F.max("c").over(by_anchor)) | (F.col("left") >= COMMON))
    # of copies only the place matters from here on; a lone first occurrence loses nothing
    hits = written(rows.where("not first or mixed").select("first", "doc_id", "pos", (F.col("left") % COMMON).cast("smallint").alias("left"), "right"))
    copies = hits.where(~F.col("first") & (F.col("left") + F.col("right") >= window - k)).select(
        "doc_id", (F.col("pos") - F.col("left")).cast("int").alias("start"), (F.col("pos") + k + F.col("right")).cast("int").alias("end")
    )
    found = written(contexts(hits.where("first"), long_enough, window))
    ranges = copies.union(mixed_ranges(found, window)).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("at"))
    ranges = written(ranges)
    dropped(hits)
    dropped(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                size, removed, spans, kept = [], [], [], []
                for raw, at in zip(part.column(1), part.column(2), strict=True):
                    data = raw.as_buffer().to_pybytes() if raw.is_valid else b""
                    a = b = np.zeros(0, np.int64)
                    if at.is_valid:
                        a, b = runs(cover(len(data), at.values.field(0).to_numpy(), at.values.field(1).to_numpy()))
                    size.append(len(data))
                    removed.append(int((b - a).sum()))
                    spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                    edges = [0, *np.stack([a, b], axis=1).reshape(-1).tolist(), len(data)]
                    kept.append(b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                yield pa.record_batch([part.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return texts.join(ranges, "doc_id", "left").select("doc_id", "text", "at").mapInArrow(run, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    found = remove_repeated(texts(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
