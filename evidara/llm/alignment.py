"""Cross-tokenizer alignment by a cogroup of postings.

Two public vocabularies (A byte-level, B pieces with byte fallback) encode each text with a blank before it. Where tokens of both end at the same byte
the text is cut into groups, and the two tokens that end there are linked. How often an id pair is linked in the whole corpus, and whether that is
the most for its B id, comes back to every document as two sums.

1. Texts are encoded once; what is kept are one row a document (counts, digest of the groups) and postings: for each B id of a slice of
   texts the A ids, documents and multiplicities of its links, in order.
2. Postings are shuffled by B id, as is one row with the corpus count of each pair (summed map-side first). Both lie in one sorted stream, the counts of an id before
   its postings, so a task holds the counts of one B id (at most one for each A id) and a buffer of fixed size, whatever the id's postings; Spark sorts and spills.
   An id with more postings than a share of the whole is dealt into shares, each of which gets the id's counts.
3. Each task adds up its documents' contributions as the buffer fills, and a sum by document brings them together.

Results: one row per document. A text that is null or empty, or that a vocabulary does not give back byte by byte (U+2581 stands for a blank in B), has
no tokens: zeros, and an empty digest. An empty table gives no rows. Texts of any length are worked on in pieces, cut at blanks between ASCII letters, where tokens of
both vocabularies end.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import dropped, records, written
from evidara.llm.textarrays import buffers, slices
from evidara.llm.tokens import Encoder
from evidara.plans.registry import texts

#: Bytes of text that a task works on at a time, bytes of kept parts for each vocabulary, and contributions in a task's buffer (Spark sums what
#: leaves it by document before the shuffle).
SLICE, KEEP, BUFFER = 2 << 20, 24 << 20, 1 << 16
#: Shares of the postings for each shuffle partition: an id with more than one share is dealt out.
SHARES = 4
ROWS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, b int, n bigint, base bigint, a binary, docs binary, m binary"
KINDS = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string())]
    + [("b", pa.int32()), ("n", pa.int64()), ("base", pa.int64()), ("a", pa.binary()), ("docs", pa.binary()), ("m", pa.binary())]
)
LETTER = np.array([chr(x).isalpha() and x < 128 for x in range(256)])


class ByteTokens(Encoder):
    """A byte-level vocabulary; special strings are ordinary text."""

    def __init__(self, path: str):
        super().__init__(path, special_as_text=True, keep=KEEP)
        back = {chr(c): b for b, c in self.letters.items()}
        names = sorted(((i, t) for t, i in self.library.get_vocab().items()), key=lambda x: x[0])
        self.bytes = [b""] * (names[-1][0] + 1)
        for i, t in names:
            self.bytes[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()


class PieceTokens(Encoder):
    """A vocabulary of pieces in which U+2581 only leads a piece: no merge crosses from a character to the blank after it, so parts that begin
    with blanks encode on their own."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a vocabulary with pieces that hold blanks inside is not supported")
        byte = lambda p: re.fullmatch("<0x([0-9A-F]{2})>", p)
        self.bytes = [b"" if self.model.is_control(i) or self.model.is_unknown(i) else bytes([int(byte(p)[1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.specials, self.find_specials, self.drops_space, self.size = {}, None, False, len(pieces)
        self.young, self.old, self.held, self.keep = {}, {}, 0, KEEP

    def _spans(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        opens = np.zeros(len(data) + 1, dtype=bool)
        blank = data == 0x20
        opens[1:-1] = blank[1:] & ~blank[:-1]
        opens[borders] = True
        starts = np.flatnonzero(opens[:-1])
        return starts, np.append(starts[1:], len(data))[: len(starts)]

    def _learn(self, parts: list[bytes]) -> list[bytes]:
        # the library puts a blank before a text by itself, but not before an empty one
        made = self.model.encode([p[1:].decode() for p in parts], num_threads=1)
        return [array("I", x if len(p) > 1 else [self.model.piece_to_id("▁")]).tobytes() for p, x in zip(parts, made, strict=True)]


_kept: dict[tuple[type, str], Encoder] = {}


def _encoder(kind: type, path: str) -> Encoder:
    """One for each worker process and file."""
    if (kind, path) not in _kept:
        _kept[kind, path] = kind(path)
    return _kept[kind, path]


def _strings(a: Encoder, b: Encoder) -> pa.Array:
    """Ids as text with what follows them: A before another, A before B, B before another, B before the next group."""
    return pa.array([f"{i}{mark}".encode() for n, mark in ((len(a.bytes), ","), (len(a.bytes), "|"), (len(b.bytes), ","), (len(b.bytes), ";")) for i in range(n)], pa.large_binary())


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = _encoder(ByteTokens, path_a), _encoder(PieceTokens, path_b)
        self.tables = [pa.array(x.bytes, pa.large_binary()) for x in (self.a, self.b)]
        self.sizes = [np.array([len(t) for t in x.bytes], dtype=np.int64) for x in (self.a, self.b)]
        self.strings = _strings(self.a, self.b)

    def _encoded(self, which: int, column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows, their bounds by row, and which rows the tokens spell byte by byte."""
        ids, bounds = (self.a, self.b)[which].encode(column)
        ids = np.delete(ids, bounds[1:] - 1).astype(np.int64)  # without the end ids
        bounds = bounds - np.arange(len(bounds))
        spelt = self.tables[which].take(pa.array(ids))
        got, at = buffers(spelt)
        at = at[bounds]
        if np.array_equal(at, offsets) and np.array_equal(got, data):
            return ids, bounds, np.ones(len(offsets) - 1, dtype=bool)
        same = [np.array_equal(got[at[i] : at[i + 1]], data[offsets[i] : offsets[i + 1]]) for i in range(len(offsets) - 1)]
        return ids, bounds, np.array(same, dtype=bool)

    def align(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Of rows that begin with a blank: which are spelt by both; A tokens, B tokens, groups and group text (with a last mark) of each
        row; row, A id and B id of every link. Rows that are not spelt have none of them."""
        data, offsets = buffers(column)
        ids_a, bounds_a, fine = self._encoded(0, column, data, offsets)
        ids_b, bounds_b, too = self._encoded(1, column, data, offsets)
        fine = fine & too
        if not fine.all():
            out = self.align(column.filter(pa.array(fine))) if fine.any() else None
            full = np.flatnonzero(fine)
            counts = [np.zeros(len(fine), dtype=np.int64) for _ in range(3)]
            text, links = [b""] * len(fine), [np.zeros(0, np.int64)] * 3
            if out:
                for mine, x in zip(counts, out[1:4], strict=True):
                    mine[full] = x
                for i, x in zip(full.tolist(), out[4], strict=True):
                    text[i] = x
                links = [full[out[5]], *out[6:]]
            return fine, *counts, text, *links
        ends_a, ends_b = np.cumsum(self.sizes[0][ids_a]), np.cumsum(self.sizes[1][ids_b])
        mark = np.zeros(len(data) + 1, dtype=bool)
        mark[ends_a] = True
        last_b = np.flatnonzero(mark[ends_b])
        last_a = np.searchsorted(ends_a, ends_b[last_b])
        row = np.searchsorted(offsets, ends_b[last_b], side="left") - 1
        n_groups = np.bincount(row, minlength=len(fine))
        # texts of groups: A tokens of a group, then its B tokens
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        order = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        more_a, more_b = ids_a.copy(), ids_b + 2 * len(self.sizes[0])
        more_a[last_a] += len(self.sizes[0])
        more_b[last_b] += len(self.sizes[1])
        order[np.arange(len(ids_a)) + np.repeat(last_b + 1 - size_b, size_a)] = more_a
        order[np.arange(len(ids_b)) + np.repeat(last_a + 1, size_b)] = more_b
        raw, at = buffers(self.strings.take(pa.array(order)))
        at = at[bounds_a + bounds_b]
        whole = raw.tobytes()
        text = [whole[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return fine, np.diff(bounds_a), np.diff(bounds_b), n_groups, text, row, ids_a[last_a], ids_b[last_b]


def _cuts(data: np.ndarray, limit: int) -> list[int]:
    """Where a long text may be cut: before a blank between ASCII letters."""
    blank = np.flatnonzero((data[1:-1] == 0x20) & LETTER[data[:-2]] & LETTER[data[2:]]) + 1
    cuts, at = [0], 0
    while len(data) - at > limit:
        i = np.searchsorted(blank, at + limit, side="right") - 1
        i = i if i >= 0 and blank[i] > at else i + 1
        if i >= len(blank):
            break
        at = int(blank[i])
        cuts.append(at)
    return [*cuts, len(data)]


def _postings(doc_ids: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
    """Links of a slice as one row for each B id."""
    if not len(row):
        return None
    key, m = np.unique(b.astype(np.uint64) << np.uint64(48) | a.astype(np.uint64) << np.uint64(32) | row.astype(np.uint64), return_counts=True)
    docs = doc_ids[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    base = int(docs.min())
    wide = "<u4" if int(docs.max()) - base < 1 << 32 else "<u8"
    b = (key >> np.uint64(48)).astype(np.int64)
    first = np.flatnonzero(np.diff(b, prepend=-1))
    ends = np.append(first[1:], len(b))
    cells = lambda x: (lambda raw, w: pa.array([raw[w * i : w * j] for i, j in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary()))(x.tobytes(), x.dtype.itemsize)
    n = len(first)
    return pa.record_batch(
        [*(pa.nulls(n, KINDS.field(i).type) for i in range(5)), pa.array(b[first], pa.int32()), pa.array(ends - first), pa.array(np.full(n, base)), cells((key >> np.uint64(32) & np.uint64(0xFFFF)).astype("<u2")), cells((docs - base).astype(wide)), cells(m.astype("<u4"))],
        schema=KINDS,
    )


def _documents(doc_ids: pa.Array, n_a: np.ndarray, n_b: np.ndarray, n_groups: np.ndarray, digests: list[str]) -> pa.RecordBatch:
    n = len(doc_ids)
    return pa.record_batch([doc_ids, pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()), pa.array(digests, pa.string()), *(pa.nulls(n, KINDS.field(i).type) for i in range(5, 11))], schema=KINDS)


def encoded(docs: DataFrame, path_a: str, path_b: str, size: int | None = None) -> DataFrame:
    """Rows of two kinds: documents (doc_id not null) and postings (b not null)."""
    limit = size or SLICE

    def long_text(aligner: Aligner, doc_id: pa.Array, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts, counts, hasher, links, fine = _cuts(data, limit), np.zeros(3, dtype=np.int64), hashlib.sha256(), [], True
        rest = b""
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            ok, n_a, n_b, n_groups, text, _, a, b = aligner.align(pa.array([data[x:y].tobytes()], pa.large_binary()))
            fine = fine and bool(ok[0])
            if not fine:
                break
            hasher.update(rest + text[0][:-1])
            rest = b";"
            counts += [n_a[0], n_b[0], n_groups[0]]
            key, m = np.unique(b.astype(np.int64) << 16 | a.astype(np.int64), return_counts=True)
            links.append((key, m))
        yield _documents(doc_id, *(counts[i : i + 1] * fine for i in range(3)), [hasher.hexdigest() if fine else ""])
        if fine:
            for key, m in links:
                whole = np.repeat(key, m)
                yield _postings(doc_id.to_numpy(), np.zeros(len(whole), np.int64), whole & 0xFFFF, whole >> 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            for part in slices(batch, "text", limit):
                data, offsets = buffers(part.column(1))
                sizes, doc_ids = np.diff(offsets), part.column(0)
                full = np.flatnonzero(sizes)
                if len(full) < len(sizes):
                    none = doc_ids.filter(pa.array(sizes == 0))
                    yield _documents(none, *(np.zeros(len(none), np.int64) for _ in range(3)), [""] * len(none))
                if not len(full):
                    continue
                doc_ids = doc_ids.take(pa.array(full))
                led = np.insert(data, offsets[:-1][full], 0x20)  # a blank before each text
                bounds = np.concatenate([[0], np.cumsum(sizes[full] + 1)])
                if len(full) == 1 and len(led) > limit:
                    yield from long_text(aligner, doc_ids, led)
                    continue
                column = pa.Array.from_buffers(pa.large_binary(), len(full), [None, pa.py_buffer(bounds), pa.py_buffer(led)])
                _, n_a, n_b, n_groups, text, row, a, b = aligner.align(column)
                yield _documents(doc_ids, n_a, n_b, n_groups, [hashlib.sha256(x[:-1]).hexdigest() if x else "" for x in text])
                found = _postings(doc_ids.to_numpy(), row, a, b)
                if found is not None:
                    yield found

    return docs.mapInArrow(run, ROWS)


def pair_counts(postings: DataFrame) -> DataFrame:
    """(b, a, n): links of each id pair in the corpus; every batch of postings is summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x.as_buffer()) // 2 for x in batch.column(1)]
            key = np.repeat(batch.column(0).to_numpy().astype(np.int64) << 16, sizes) | np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2")
            m = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").astype(np.int64)
            key, at = np.unique(key, return_inverse=True)
            yield pa.record_batch({"b": pa.array((key >> 16).astype(np.int32)), "a": pa.array((key & 0xFFFF).astype(np.int32)), "n": pa.array(np.bincount(at, weights=m, minlength=len(key)).astype(np.int64))})

    return postings.select("b", "a", "m").mapInArrow(run, "b int, a int, n bigint").groupBy("b", "a").agg(F.sum("n").alias("n"))


def contributions(stream: DataFrame) -> DataFrame:
    """(doc_id, n_best, count_sum), several rows a document, from a stream sorted by (b, share, kind): counts (kind 0), then postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, now, best = 0, [], None, 0
        count = np.zeros(1 << 16, dtype=np.int64)

        def flush() -> pa.RecordBatch:
            docs, n_best, sums = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order = np.argsort(docs, kind="stable")
            docs = docs[order]
            first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
            return pa.record_batch({"doc_id": pa.array(docs[first]), "n_best": pa.array(np.add.reduceat(n_best[order], first)), "count_sum": pa.array(np.add.reduceat(sums[order], first))})

        for batch in batches:
            if not batch.num_rows:
                continue
            b, share, kind = (batch.column(i).to_numpy() for i in range(3))
            key = b.astype(np.int64) << 32 | share
            cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if key[x] != now:
                    now, best = key[x], 0
                    count[:] = 0
                part = batch.slice(x, y - x)
                if not kind[x]:
                    n = part.column(4).to_numpy()
                    count[part.column(3).to_numpy()] = n
                    best = max(best, int(n.max()))
                    continue
                ids = [v.as_buffer() for v in part.column(6)]
                docs = [np.frombuffer(d, "<u4" if 2 * len(i) == len(d) else "<u8").astype(np.int64) + base for i, d, base in zip(ids, (v.as_buffer() for v in part.column(7)), part.column(5).to_pylist(), strict=True)]
                for p in range(0, len(ids), 4096):
                    c = count[np.frombuffer(b"".join(ids[p : p + 4096]), "<u2")]
                    m = np.frombuffer(b"".join(v.as_buffer() for v in part.column(8).slice(p, 4096)), "<u4").astype(np.int64)
                    waiting.append((np.concatenate(docs[p : p + 4096]), np.where(c == best, m, 0), c * m))
                    held += len(c)
                    if held >= BUFFER:
                        yield flush()
                        held, waiting = 0, []
        if waiting:
            yield flush()

    return stream.mapInArrow(run, "doc_id bigint, n_best bigint, count_sum bigint")


def align(docs: DataFrame, path_a: str, path_b: str, *, key: str = "doc_id", text: str = "text", shares: int = SHARES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    rows = records(docs, key, text).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    made = written(encoded(rows, path_a, path_b))
    postings = made.where("b is not null")
    sizes = postings.groupBy("b").agg(F.sum("n").alias("n")).collect()  # one row a B id: the vocabulary bounds them
    share = max(1, sum(x["n"] for x in sizes) // (shares * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = F.broadcast(spark.createDataFrame([(x["b"], -(-x["n"] // share)) for x in sizes], "b int, shares int"))
    counts = pair_counts(postings).join(dealt, "b").select("b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), F.col("a").alias("id"), "n")
    lists = postings.select("b", "base", "a", "docs", "m").join(dealt, "b").withColumn("share", F.pmod(F.xxhash64("base", "docs"), F.col("shares")).cast("int"))
    both = counts.unionByName(lists.select("b", "share", F.lit(1).alias("kind"), "base", "a", "docs", "m"), allowMissingColumns=True)
    stream = both.select("b", "share", "kind", "id", "n", "base", "a", "docs", "m").repartition("b", "share").sortWithinPartitions("b", "share", "kind")
    sums = written(contributions(stream).groupBy("doc_id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    known = written(made.where("doc_id is not null").select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256"))
    dropped(made)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return known.join(sums, "doc_id", "left").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
