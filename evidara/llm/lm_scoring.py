"""Language-model scoring with a log-frequency Bloom filter.

The filter holds quantised counts: an n-gram seen c times is entered with the levels 1 .. 1 + floor(log_BASE c), and its count is read by probing level
after level until one is missing. It is cut into blocks of 2^20 bits, and all levels of an n-gram lie in the block that its hash names, so blocks are built
apart, by the tasks to which Spark shuffles their n-grams, from the exact counts over the whole corpus. There are as many blocks as the distinct n-grams need at
BITS bits an entry, so false positives are as rare in a large corpus as in a small one. The filter is nowhere held whole: n-grams come to the task that has their
blocks, TOGETHER at a time, are entered there, and the same rows then ask for their levels. So what a task holds does not grow with the corpus, and a text's n-grams are looked up once.

1. Texts become slices: distinct tokens, token numbers, document bounds. A document begins with a start mark and ends with the end token.
2. Token counts are summed by token and joined back to the slices, exact: they give the base score and the unigrams of the model.
3. N-grams of 2 .. ORDER tokens are counted per slice, shuffled by groups of blocks, summed, entered, and probed; their levels go back to the slice.
4. The model: from order to order, P(w|h) = s c(hw) / c(h) + (1 - s) P(w|shorter h), and the last is the base's
   share. s is the share of training tokens after histories of the same count level whose n-gram would still be known without them (counted twice or more);
   it is 0 after an unknown history. So the probabilities of all words after a history sum to 1 but for quantising.

Results: one row per document. A null or empty text is its end token alone. Without training documents every base probability is 1, by the given rule. An empty table
gives no rows. A long text is cut into pieces that begin with the tokens before them, so a task holds SLICE bytes of text and no more than one word beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import dropped, records, written
from evidara.llm.textarrays import LOWER, SPACE, buffers, leaves_nothing, mix, pieces, slices, word_hashes, word_spans
from evidara.plans.registry import texts

ORDER, BASE = 3, 1.5
#: Bits for each level of an n-gram, probes for each, bits of a block, blocks that a task holds at most, and levels per n-gram that the filter is sized for.
BITS, PROBES, BLOCK, TOGETHER, PER_GRAM = 10, 4, 1 << 20, 16, 1.2
SLICE = 4 << 20
#: Bytes of rows that a task's Python gets at a time (one row at least); n-grams that are summed or probed at a time.
BATCH, AT_ONCE = 8 << 20, 1 << 19
#: One n-gram hash in so many is counted to size the filter.
SIZED_BY = 256
LEVELS = 96
#: Positions that are looked up at a time: their arrays stay in a core's cache.
NEAR = 1 << 15
START, END = b"\n", b""  # neither is a word
LEFT = np.uint64(0x9FB21C651E98DF25)
TOKENS = "doc_id array<bigint>, held array<boolean>, bounds array<bigint>, lead int, codes binary, tokens array<binary>, times array<bigint>, few array<bigint>"
ONE = ("doc_id", "held", "bounds", "lead", "codes")
WHOLE = "doc_id array<bigint>, held array<boolean>, bounds array<bigint>, lead int, codes binary, counts binary, levels binary, seen array<bigint>"


def level_of(count: np.ndarray) -> np.ndarray:
    """1 + floor(log_BASE count); 0 for 0."""
    edges = np.array([math.ceil(BASE**j - 1e-9) for j in range(LEVELS)])
    return np.searchsorted(edges, count, side="right")


def _level_means() -> np.ndarray:
    """The mean of the whole numbers of each level."""
    low = np.array([math.ceil(BASE**j - 1e-9) for j in range(LEVELS + 1)], dtype=np.float64)
    return np.concatenate([[0.0], (low[:-1] + low[1:] - 1) / 2])


MEANS = _level_means()


def pressed(x: np.ndarray) -> bytes:
    """Numbers by bytes of equal rank, compressed, after how many they are: rows that move are as small in shuffles and sorts as in files."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T) if len(x) else np.zeros(0, np.uint8)
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpressed(raw: bytes | pa.Buffer, kind: str) -> np.ndarray:
    raw = memoryview(raw)
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = pa.Codec("zstd").decompress(raw[8:], n * size)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


def grams(seq: np.ndarray, place: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 2: a hash of the n-gram that ends at each position, and where it has all its tokens. place: position in the text's piece."""
    out = seq
    for n in range(2, order + 1):
        left = np.zeros_like(seq)
        left[n - 1 :] = seq[: len(seq) - n + 1]
        out = mix(left * LEFT + out, n)
        yield out, place >= n - 1


def stretches(seq: np.ndarray, place: np.ndarray, order: int) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """``grams`` in stretches of NEAR positions: number of the length, positions, hashes and where they are whole. So no array but the result has a slice's size."""
    for a in range(0, len(seq), NEAR):
        low = max(0, a - order + 1)
        part = slice(low, a + NEAR)
        for i, (h, whole) in enumerate(grams(seq[part], place[part], order)):
            yield i, slice(a, a + len(h) - (a - low)), h[a - low :], whole[a - low :]


class Slice:
    """Arrays of one row of the token table."""

    def __init__(self, row: dict):
        self.doc_id, self.held, self.lead = row["doc_id"], np.array(row["held"], dtype=bool), row["lead"]
        self.bounds = np.array(row["bounds"], dtype=np.int64)
        n = int(self.bounds[-1])
        self.codes = unpressed(row["codes"], "<u4")
        size = np.diff(self.bounds)
        self.row = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.place = np.arange(n, dtype=np.int32) - self.bounds.astype(np.int32)[self.row]
        self.counts = self.place >= self.lead  # what stands before belongs to the piece before, or is the start mark

    def learnt(self) -> np.ndarray:
        return self.counts & ~self.held[self.row]


def _hashes(tokens: pa.Array) -> np.ndarray:
    data, offsets = buffers(tokens)
    return word_hashes(data, offsets[:-1], offsets[1:])


def token_slices(docs: DataFrame, held: str, order: int = ORDER, size: int | None = None) -> DataFrame:
    """Slices of (doc_id, text, held) as a table, each with a number."""
    limit = size or SLICE

    def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets)
        return data[~SPACE[data]], ends - starts, first

    def row(doc_ids: list, flags: list, packed: np.ndarray, sizes: np.ndarray, bounds: np.ndarray, lead: int) -> pa.RecordBatch:
        column = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)])), pa.py_buffer(np.ascontiguousarray(packed))])
        coded = column.dictionary_encode()
        tokens, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        own = np.repeat(np.arange(len(doc_ids)), np.diff(bounds))
        place = np.arange(len(codes)) - bounds[own]
        # the start mark is counted once a training document, in its first piece
        train = ~np.array(flags, dtype=bool)[own] & ((place >= lead) | ((place == 0) & (lead == 1)))
        few, learnt = [np.zeros(0, np.uint64)], train & (place >= lead)
        for _, at, h, whole in stretches(_hashes(tokens)[codes], place, order):
            few.append(h[whole & learnt[at] & (h % np.uint64(SIZED_BY) == 0)])
        few = np.unique(np.concatenate(few)).view(np.int64)
        one = lambda x, kind: pa.array([x], kind)
        longs = pa.list_(pa.int64())
        return pa.record_batch(
            {
                "doc_id": one(doc_ids, longs), "held": one(flags, pa.list_(pa.bool_())), "bounds": one(bounds, longs), "lead": one(lead, pa.int32()),
                "codes": one(pressed(codes.astype("<u4")), pa.binary()),
                "tokens": pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), tokens.cast(pa.binary())), "times": one(np.bincount(codes[train], minlength=len(tokens)), longs), "few": one(few, longs),
            }
        )

    def marked(packed: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A start mark before and an end (no bytes) after each row's words."""
        at = np.concatenate([[0], np.cumsum(sizes)])[first[:-1]]
        n = np.arange(len(first) - 1)
        sizes = np.insert(sizes, first[1:], 0)
        return np.insert(packed, at, START[0]), np.insert(sizes, first[:-1] + n, len(START)), np.concatenate([[0], first[1:] + 2 * (n + 1)])

    def long_text(doc_id: int, flag: bool, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        before, lengths, lead = np.frombuffer(START, np.uint8), np.array([len(START)]), 1
        cuts = list(pieces(data, SPACE, limit))
        for i, piece in enumerate(cuts):
            packed, sizes, _ = words(piece, np.array([0, len(piece)]))
            packed, sizes = np.concatenate([before, packed]), np.concatenate([lengths, sizes])
            if i == len(cuts) - 1:
                sizes = np.append(sizes, 0)
            yield row([doc_id], [flag], packed, sizes, np.array([0, len(sizes)]), lead)
            lead = min(order, len(sizes))
            lengths = sizes[len(sizes) - lead :]
            before = packed[len(packed) - int(lengths.sum()) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", limit):
                data, offsets = buffers(part.column(1))
                if part.num_rows == 1 and len(data) > limit:
                    yield from long_text(part.column(0)[0].as_py(), part.column(2)[0].as_py(), data)
                    continue
                packed, sizes, bounds = marked(*words(data, offsets))
                yield row(part.column(0).to_pylist(), part.column(2).to_pylist(), packed, sizes, bounds, 1)

    return written(docs.select("doc_id", "text", held).mapInArrow(leaves_nothing(run), TOKENS).withColumn("slice", F.monotonically_increasing_id()), batch=BATCH)


def token_counts(table: DataFrame) -> DataFrame:
    """(token, c) of all training tokens, the start mark too."""
    return written(table.select(F.explode(F.arrays_zip("tokens", "times")).alias("x")).groupBy(F.col("x.tokens").alias("token")).agg(F.sum("x.times").alias("c")).where("c > 0"))


def answers(table: DataFrame, counts: DataFrame) -> DataFrame:
    """(slice, pos, c) as a table, a few rows a slice: the corpus counts of its tokens that have any, and their places in the slice's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, pos, c = (batch.column(i).to_numpy() for i in range(3))
            first = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(first[1:], len(part))
            cells = lambda x: pa.array([pressed(x[i:j]) for i, j in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())  # noqa: B023, E731
            yield pa.record_batch({"slice": pa.array(part[first]), "pos": cells(pos.astype("<i4")), "c": cells(c.astype("<i8"))})

    asked = table.select("slice", F.posexplode("tokens").alias("pos", "token"))
    found = asked.join(counts, "token").select("slice", "pos", "c").repartition("slice").sortWithinPartitions("slice")
    return written(found.mapInArrow(leaves_nothing(run), "slice bigint, pos binary, c binary"), batch=BATCH)


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def _name(h: np.ndarray) -> np.ndarray:
    """What an n-gram is called in its block: 40 bits; a block holds under 2^17 n-grams at any corpus size."""
    return mix(h, 0x77) & np.uint64((1 << 40) - 1)


def _probes(name: np.ndarray, level: int) -> Iterator[np.ndarray]:
    x = mix(name + (np.uint64(level) << np.uint64(40)), 0x39)
    at, step = x & np.uint64(BLOCK - 1), (x >> np.uint64(24)) | np.uint64(1)
    for _ in range(PROBES):
        yield at.astype(np.int64)
        at = (at + step) & np.uint64(BLOCK - 1)


def gram_names(part: Slice, seq: np.ndarray, blocks: int, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The n-grams of a slice by stretches: number of the length, the positions where they end, and their block (from bit 40 on) with their name in it."""
    for i, at, h, whole in stretches(seq, part.place, order):
        where = np.flatnonzero(whole)
        h = h[where]
        yield i, where + at.start, _block(h, blocks) << np.uint64(40) | _name(h)


def _groups(spark, blocks: int, together: int) -> int:
    """Groups of blocks that lie side by side, of at most ``together``."""
    return min(blocks, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // together)))


def _read(row: pa.RecordBatch) -> tuple[Slice, np.ndarray]:
    """A row of the token table, and the hashes of its tokens in their order."""
    part = Slice(row.select(list(ONE)).to_pylist()[0])
    return part, _hashes(row.column("tokens").flatten())[part.codes]


def named(table: DataFrame, blocks: int, groups: int, order: int = ORDER) -> DataFrame:
    """(slice, group, names, n): per slice and group of blocks its n-grams as sorted names (the steps between them), with their counts among its training texts (0: held out alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq = _read(batch.slice(i, 1))
                learnt = part.learnt()
                found = [np.zeros(0, np.uint64), *(name << np.uint64(1) | learnt[at].astype(np.uint64) for _, at, name in gram_names(part, seq, blocks, order))]
                found = np.concatenate(found)
                if not len(found):
                    continue
                found.sort()
                name = found >> np.uint64(1)
                head = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
                name, n = name[head], np.add.reduceat(found & np.uint64(1), head)
                group = (name >> np.uint64(40)) * np.uint64(groups) // np.uint64(blocks)
                first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                ends = np.append(first[1:], len(name))
                n, step = n.astype("<u4"), np.diff(name, prepend=np.uint64(0)).astype("<u8")
                step[first] = name[first]
                steps = [pressed(step[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                times = [pressed(n[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                slice_ = pa.array(np.full(len(first), batch.column("slice")[i].as_py(), dtype=np.int64))
                yield pa.record_batch({"slice": slice_, "group": pa.array(group[first].astype(np.int32)), "names": pa.array(steps, pa.binary()), "n": pa.array(times, pa.binary())})

    return table.select("slice", *ONE, "tokens").mapInArrow(leaves_nothing(run), "slice bigint, group int, names binary, n binary")


def _names(raw: pa.Scalar) -> np.ndarray:
    return np.cumsum(unpressed(raw.as_buffer(), "<u8"))


class Entries:
    """The n-grams of a group of blocks with their counts, of which no more than twice the distinct ones are held."""

    def __init__(self):
        self.names, self.counts, self.held, self.size = [], [], 0, AT_ONCE

    def add(self, names: pa.Scalar, n: pa.Scalar) -> None:
        n = unpressed(n.as_buffer(), "<u4").astype(np.int64)
        self.names.append(_names(names)[n > 0])
        self.counts.append(n[n > 0])
        self.held += len(self.names[-1])
        if self.held > self.size:  # sum what has come so far
            name, n = self.summed()
            self.names, self.counts, self.held = [name], [n], len(name)
            self.size = max(self.size, 2 * self.held)

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        name, n = np.concatenate([np.zeros(0, np.uint64), *self.names]), np.concatenate([np.zeros(0, np.int64), *self.counts])
        at = np.argsort(name)
        name, n = name[at], n[at]
        head = np.flatnonzero(np.diff(name, prepend=~name[:1]))
        return name[head], np.add.reduceat(n, head) if len(head) else n

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """Every block that holds anything, and its bits."""
        name, n = self.summed()
        if not len(name):
            return
        level, block = level_of(n), (name >> np.uint64(40)).astype(np.int64)
        name = name & np.uint64((1 << 40) - 1)
        first = np.flatnonzero(np.diff(block, prepend=-1))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(block)], strict=True):
            bits = np.zeros(BLOCK, dtype=bool)
            for j in range(1, int(level[a:b].max()) + 1):
                for at in _probes(name[a:b][level[a:b] >= j], j):
                    bits[at] = True
            yield int(block[a]), np.packbits(bits)


def filter_blocks(table: DataFrame, blocks: int, order: int = ORDER) -> DataFrame:
    """(block, bits) of every block that holds anything, as a table. ``table``: token slices."""
    groups = _groups(table.sparkSession, blocks, TOGETHER)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Entries()

        def finished() -> Iterator[pa.RecordBatch]:
            for block, bits in held.blocks():
                yield pa.record_batch({"block": pa.array([block], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

        for batch in batches:
            for group, names, n in zip(batch.column("group").to_pylist(), batch.column("names"), batch.column("n"), strict=True):
                if group != now:
                    yield from finished()
                    now, held = group, Entries()
                held.add(names, n)
        yield from finished()

    dealt = named(table, blocks, groups, order).repartition("group").sortWithinPartitions("group")
    return written(dealt.mapInArrow(leaves_nothing(enter), "block bigint, bits binary"), batch=BATCH)


def look_up(table: DataFrame, blocks: int, groups: int, order: int = ORDER) -> DataFrame:
    """(slice, group, levels) as a table: the filter's levels of the names that ``named`` has for each slice and group, in their order.

    A group's rows come twice, sorted, to the task that has it: first their counts are entered, then each asks. They are doubled after the shuffle."""

    def filled(group: int, held: Entries) -> tuple[int, np.ndarray]:
        """The group's first block, and the bits of all its blocks."""
        first, last = -(-group * blocks // groups), -(-(group + 1) * blocks // groups)
        bits = np.zeros((last - first, BLOCK // 8), dtype=np.uint8)
        for block, packed in held.blocks():
            bits[block - first] = packed
        return first, bits.ravel()

    def answers_of(rows: pa.RecordBatch, first: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = [_names(x) for x in rows.column("names")]
        ends = np.cumsum([len(x) for x in names])
        for a, b in _stretched(ends, AT_ONCE):
            name = np.concatenate(names[a:b])
            found = _probed(name & np.uint64((1 << 40) - 1), ((name >> np.uint64(40)).astype(np.int64) - first) * (BLOCK // 8), bits)
            sizes = np.concatenate([[0], ends[a:b] - (ends[a - 1] if a else 0)]).astype(np.int32)
            levels = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(sizes), pa.py_buffer(found)])
            yield pa.record_batch({"slice": rows.column("slice").slice(a, b - a), "group": rows.column("group").slice(a, b - a), "levels": levels})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, made = None, Entries(), None
        for batch in batches:
            group, asks = batch.column("group").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(group) != 0) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)], strict=True):
                if b > a and group[a] != now:
                    now, held, made = int(group[a]), Entries(), None
                if b > a and asks[a]:
                    if made is None:
                        made, held = filled(now, held), Entries()
                    yield from answers_of(batch.slice(a, b - a), *made)
                    continue
                for names, n in zip(batch.column("names").slice(a, b - a), batch.column("n").slice(a, b - a), strict=True):
                    held.add(names, n)

    dealt = named(table, blocks, groups, order).repartition("group")
    twice = dealt.select("slice", "group", F.explode(F.array(F.lit(False), F.lit(True))).alias("asks"), "names", "n")
    rows = twice.select("slice", "group", "asks", "names", F.when(~F.col("asks"), F.col("n")).alias("n")).sortWithinPartitions("group", "asks")
    return written(rows.mapInArrow(leaves_nothing(run), "slice bigint, group int, levels binary"), batch=BATCH)


def _stretched(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows, given where each ends, of about ``limit`` in all (one row at least)."""
    cuts = np.flatnonzero(np.diff((ends - 1) // limit)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(ends)], strict=True)


def _probed(name: np.ndarray, base: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Levels of n-grams whose blocks begin at the given bytes of ``bits``."""
    out = np.zeros(len(name), dtype=np.uint8)
    at, level = np.arange(len(name)), 1
    while len(at) and level < LEVELS:
        hit = np.arange(len(at))
        for p in _probes(name, level):
            p = p[hit]
            hit = hit[bits[base[hit] + (p >> 3)] >> (7 - (p & 7)).astype(np.uint8) & 1 == 1]
        at, base, name = at[hit], base[hit], name[hit]
        out[at] = level
        level += 1
    return out


def probed(h: np.ndarray, blocks: int, first: int, bits: np.ndarray) -> np.ndarray:
    """Levels of the n-grams whose blocks are among the given ones (from ``first`` on); 0 for all others."""
    out = np.zeros(len(h), dtype=np.uint8)
    block = _block(h, blocks).astype(np.int64) - first
    at = np.flatnonzero((block >= 0) & (block < len(bits) * 8 // BLOCK))
    out[at] = _probed(_name(h[at]), block[at] * (BLOCK // 8), bits)
    return out


def laid_out(part: Slice, seq: np.ndarray, found: np.ndarray, blocks: int, order: int) -> np.ndarray:
    """Levels for each order and position, from those of the slice's distinct names in their order."""
    n = len(part.codes)
    where, name = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i, at, x in gram_names(part, seq, blocks, order):
        where.append(at + i * n)
        name.append(x)
    where, name = np.concatenate(where), np.concatenate(name)
    at = np.argsort(name)
    name = name[at]
    rank = np.cumsum(np.diff(name, prepend=~name[:1]) != 0) - 1
    if len(found) != (int(rank[-1]) + 1 if len(rank) else 0):
        raise ValueError(f"{len(found)} levels of {len(name)} n-grams")
    out = np.zeros((order - 1) * n, np.uint8)
    out[where[at]] = found[rank]
    return out.reshape(order - 1, n)


def whole_slices(table: DataFrame, known: DataFrame, found: DataFrame, blocks: int, order: int = ORDER) -> DataFrame:
    """The slices with the counts of their tokens and their levels by order, as a table; ``seen`` has, for each order and level of history, how many training tokens
    stand after it, and of how many the n-gram was counted twice or more.

    A slice comes first in the sorted stream, then its counts, then its levels group by group, so one slice and what one row brings to it are held at a time."""
    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                data, offsets = buffers(one.column("tokens").flatten())
                words, sizes = (pa.array([pressed(x)], pa.binary()) for x in (data, np.diff(offsets).astype("<u4")))
                yield pa.record_batch({c: one.column(c) for c in ("slice", *ONE)} | {"words": words, "sizes": sizes})

    moved = table.select("slice", *ONE, "tokens").mapInArrow(leaves_nothing(packing), "slice bigint, doc_id array<bigint>, held array<boolean>, bounds array<bigint>, lead int, codes binary, words binary, sizes binary")
    rows = moved.withColumn("group", F.lit(-2))
    rows = rows.unionByName(known.select("slice", F.lit(-1).alias("group"), "pos", "c"), allowMissingColumns=True)
    rows = rows.unionByName(found.select("slice", "group", "levels"), allowMissingColumns=True)

    def row(part: Slice, one: pa.RecordBatch, seq: np.ndarray, counts: np.ndarray, levels: list[np.ndarray]) -> pa.RecordBatch:
        laid = laid_out(part, seq, np.concatenate([np.zeros(0, np.uint8), *levels]), blocks, order)
        seen, learnt = np.zeros((order - 1, LEVELS + 1, 2), dtype=np.int64), part.learnt()
        for i, (level, before, _) in enumerate(_histories(part, counts, laid)):
            seen[i, :, 0] = np.bincount(before[learnt], minlength=LEVELS + 1)
            seen[i, :, 1] = np.bincount(before[learnt & (level >= 2)], minlength=LEVELS + 1)
        made = {"counts": pa.array([pressed(counts)], pa.binary()), "levels": pa.array([laid.tobytes()], pa.binary()), "seen": pa.array([seen.ravel()], pa.list_(pa.int64()))}
        return pa.record_batch({c: one.column(c) for c in ONE} | made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, levels = None, []
        for batch in batches:
            for i, group in enumerate(batch.column("group").to_pylist()):
                if group == -2:
                    if now is not None:
                        yield row(*now, levels)
                    one = batch.slice(i, 1)
                    part, ends = Slice(one.select(list(ONE)).to_pylist()[0]), np.cumsum(unpressed(one.column("sizes")[0].as_buffer(), "<u4").astype(np.int64))
                    seq = word_hashes(unpressed(one.column("words")[0].as_buffer(), "u1"), np.append(0, ends[:-1]), ends)[part.codes]
                    now, levels = (part, one, seq, np.zeros(len(ends), dtype=np.int64)), []
                elif group == -1:
                    now[3][unpressed(batch.column("pos")[i].as_buffer(), "<i4")] = unpressed(batch.column("c")[i].as_buffer(), "<i8")
                else:
                    levels.append(np.frombuffer(batch.column("levels")[i].as_py(), np.uint8))
        if now is not None:
            yield row(*now, levels)

    return written(rows.repartition("slice").sortWithinPartitions("slice", "group").mapInArrow(leaves_nothing(run), WHOLE), batch=BATCH)


def _histories(part: Slice, known: np.ndarray, levels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length from 2: level of the n-gram at each position, level of its history, and the history's count."""
    count = known[part.codes].astype(np.float64)
    level = level_of(known)[part.codes]
    for i in range(len(levels)):
        before, n = np.zeros(len(level), dtype=np.int64), np.zeros(len(level))
        before[1:], n[1:] = level[:-1], count[:-1]
        before[part.place < i + 1] = 0
        level = levels[i].astype(np.int64)
        count = MEANS[level]
        yield level, before, n


def shares(table: DataFrame, order: int = ORDER) -> np.ndarray:
    """s for each order and level of history: 2 x (ORDER - 1) x (LEVELS + 1) sums come to the driver."""
    seen = np.zeros(2 * (order - 1) * (LEVELS + 1), dtype=np.int64)
    for x in table.select(F.posexplode("seen").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
        seen[x["at"]] = x["n"]
    n, again = seen.reshape(-1, 2).T
    out = np.where(n > 0, (again + 0.5) / (n + 1), 0).reshape(order - 1, LEVELS + 1)
    for line in out:
        # a level that no training token stands after takes the share of the next lower one
        for j in range(2, LEVELS + 1):
            line[j] = line[j] or line[j - 1]
        line[0] = 0
    return out


def scored(table: DataFrame, share: np.ndarray, n: int, v: int, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) as a table, one row a piece of text."""
    total = float(n + v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield row(batch.slice(i, 1))

    def row(one: pa.RecordBatch) -> pa.RecordBatch:
        part, known = Slice(one.select(list(ONE)).to_pylist()[0]), unpressed(one.column("counts")[0].as_buffer(), "<i8")
        levels = np.frombuffer(one.column("levels")[0].as_buffer(), np.uint8).reshape(order - 1, -1)
        unigram = (known + 1) / total
        base, p = np.log10(unigram)[part.codes], unigram[part.codes]
        for i, (level, before, count) in enumerate(_histories(part, known, levels)):
            s = share[i][before]
            p = s * np.minimum(MEANS[level] / np.maximum(count, 1), 1) + (1 - s) * p
        own = part.row[part.counts]
        by_row = lambda w: np.bincount(own, weights=w[part.counts], minlength=len(part.doc_id))
        whole = lambda w: pa.array(by_row(w.astype(np.float64)).astype(np.int64))
        return pa.record_batch(
            {
                "doc_id": pa.array(part.doc_id, pa.int64()), "held_out": pa.array(part.held), "n_tokens": whole(np.ones(len(p))), "n_known": whole(known[part.codes] > 0),
                "base_score": pa.array(by_row(base)), "score": pa.array(by_row(np.log10(p))),
            }
        )

    rows = table.select(*ONE, "counts", "levels")
    return written(rows.mapInArrow(leaves_nothing(run), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"), batch=BATCH)


def held_out(key: str = "doc_id") -> F.Column:
    return F.crc32(F.col(key).cast("string")) % 7 == 2


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text", held: F.Column | None = None, order: int = ORDER, round_blocks: int = TOGETHER, size: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. round_blocks: blocks of the filter that a task holds at most."""
    rows = records(docs, key, text).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    table = token_slices(rows.withColumn("held", held_out("doc_id") if held is None else held), "held", order, size)
    counts = token_counts(table)
    n, v = counts.where(F.col("token") != F.lit(bytearray(START))).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    distinct = table.select(F.explode("few").alias("h")).distinct().count() * SIZED_BY
    blocks = max(1, math.ceil(distinct * PER_GRAM * BITS / BLOCK))
    known = answers(table, counts)
    dropped(counts)
    found = look_up(table, blocks, _groups(docs.sparkSession, blocks, round_blocks), order)
    whole = whole_slices(table, known, found, blocks, order)
    for done in (table, known, found):
        dropped(done)
    parts = scored(whole, shares(whole, order), n, v, order)
    dropped(whole)
    out = parts.groupBy("doc_id", "held_out").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return score(texts(spark, sf_dir))
