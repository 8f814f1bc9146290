"""Benchmark decontamination with spaced-seed hashing.

Tokens are lower-cased runs of letters, digits and non-ASCII bytes. A mask names the token positions of a short span
that count; the others are ignored, so a hit survives substitutions at them. Hashes of all masks at all positions of the
benchmark are joined with those of the training texts. Every joined hit fixes a diagonal (where the item would start in the
document), and along it the substitution-tolerant overlaps are found: the longest stretch of which at
least 80 % agree, then the longest to its left and right, and so on.

Before the join a bit table of the benchmark's hashes (its size follows the benchmark, up to 2**MOST_BITS bits) drops
training hashes that cannot join; it never drops one that can. Documents are read once: around their remaining hits they
hand on the token hashes that the check needs. A small benchmark's hashes are broadcast, so a seed that all documents
hold is no hot key; those of a large one are dealt with SALT copies of each.

Tokens are known by a real hash (XXH64), and an overlap is a run of equal hashes.

Results: one row per document, item and overlap (item_start, doc_start, length in tokens, matches). An overlap counts when it has
13 tokens, or the whole item if that is shorter (5 at least); different tokens at its edges count there but are not reported. Null or empty texts match nothing; an empty benchmark gives an
empty result; repeated items each report.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from evidara.llm.common import records, written
from evidara.llm.textarrays import LOWER, buffers, mix, slices, word_spans
from evidara.plans.registry import texts

#: Fixed masks over consecutive tokens: 1 counts, 0 is ignored.
MASKS = ("11101", "1101011", "10110011")
#: Besides, for items of fewer than SHORT_ITEM tokens, which those can miss with one substitution.
SHORT_MASKS = ("1111", "11011", "10111")
SHORT_ITEM = 7
MIN_TOKENS = 13
MIN_ITEM = 5
SIMILARITY = 0.8
#: Bits of the largest bit table; bits of a block of it, as it is made and collected.
MOST_BITS, BLOCK_BITS = 28, 15
#: Benchmark hashes that are broadcast at most; copies of each beyond that.
FEW, SALT = 2_000_000, 16
OUTSIDE = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every token of a batch, and the index of each row's first token (one more than rows)."""
    data, offsets = buffers(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, OUTSIDE)
    raw = data.tobytes()
    return np.array([xxh64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.uint64), first


def seeds(tokens: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the counted positions of a mask at every start that has room for it."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, number + 1, dtype=np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            h = h * np.uint64(0x9DDFEA08EB382D69) + tokens[i : i + n]
    return mix(h, number)


def rows_of(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, at, side="right") - 1


def _benchmark_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, first = token_hashes(batch.column(1))
        ids = batch.column(0).to_numpy()
        for number, mask in enumerate(MASKS + SHORT_MASKS):
            h = seeds(tokens, mask, number)
            row = rows_of(first, np.arange(len(h)))
            keep = np.arange(len(h)) + len(mask) <= first[row + 1]
            if number >= len(MASKS):
                keep &= np.diff(first)[row] < SHORT_ITEM
            at = np.arange(len(h)) - first[row]
            yield pa.record_batch({"h": pa.array(h[keep].view(np.int64)), "item_id": pa.array(ids[row[keep]], pa.int64()), "ipos": pa.array(at[keep].astype(np.int32))})


def _benchmark_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, first = token_hashes(batch.column(1))
        yield pa.record_batch({"item_id": batch.column(0), "item": pa.array([tokens[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()), "n_item": pa.array(np.diff(first).astype(np.int32))})


def longest(same: np.ndarray, share: Fraction) -> tuple[int, int]:
    """Begin and end of the longest stretch in which at least that share is true, the first of equals."""
    # matches less the share of all tokens, in whole numbers, so that a stretch at the very limit counts
    total = np.concatenate([[0], np.cumsum(same * share.denominator - share.numerator)])
    # for each end the earliest prefix that is not larger
    begins = np.searchsorted(-np.minimum.accumulate(total), -total)
    end = int(np.argmax(np.arange(len(total)) - begins))
    return int(begins[end]), end


def overlaps(item: np.ndarray, tokens: np.ndarray, start: int, similarity: float, least: int) -> list[tuple[int, int, int]]:
    """Similar stretches of ``least`` tokens or more along a diagonal (start: of the item, in tokens): item position, length and matches,
    without different tokens at their edges."""
    low, high = max(0, -start), min(len(item), len(tokens) - start)
    same = item[low:high] == tokens[start + low : start + high] if low < high else np.zeros(0, bool)
    share, out, open_ = Fraction(similarity).limit_denominator(1000), [], [(0, len(same))]
    while open_:
        a, b = open_.pop()
        if b - a < least:
            continue
        begin, end = longest(same[a:b], share)
        inside = np.flatnonzero(same[a + begin : a + end])
        if end - begin < least or not len(inside):
            continue
        out.append((low + a + begin + int(inside[0]), int(inside[-1] - inside[0]) + 1, len(inside)))
        open_ += [(a, a + begin), (a + end, b)]
    return sorted(out)


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """Which top ``bits`` bits occur among the hashes ``h``, as 64-bit words. Made in blocks by tasks; the driver sees blocks alone, 2**bits bits in all."""
    words = 1 << (BLOCK_BITS - 6)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            number = (slot >> np.uint64(BLOCK_BITS)).astype(np.int64)
            word = ((slot >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64)
            at, place = np.unique(number, return_inverse=True)
            table = np.zeros((len(at), words), dtype=np.uint64)
            np.bitwise_or.at(table, (place, word), np.uint64(1) << (slot & np.uint64(63)))
            for x, row in zip(at.tolist(), table, strict=True):
                blocks[x] = blocks[x] | row if x in blocks else row
        yield pa.record_batch({"block": pa.array(list(blocks), pa.int64()), "bits": pa.array([x.tobytes() for x in blocks.values()], pa.binary())})

    dealt = hashes.select("h").repartition(F.shiftrightunsigned("h", 64 - bits + BLOCK_BITS))
    out = np.zeros(((1 << bits) // 64 + words - 1) // words * words, dtype=np.uint64).reshape(-1, words)
    for x in dealt.mapInArrow(fill, "block bigint, bits binary").collect():  # 2**bits bits at most
        out[x["block"]] = np.frombuffer(x["bits"], np.uint64)
    return out.reshape(-1)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY
) -> DataFrame:
    """Overlaps of documents with benchmark items: doc_id, item_id, item_start, doc_start, n_tokens, n_matches, n_item."""
    spark = docs.sparkSession
    items = records(benchmark, item, F.col("text").alias("text")).select(F.col(item).alias("item_id"), "text")
    index = items.mapInArrow(_benchmark_seeds, "h bigint, item_id bigint, ipos int")
    size = index.count()
    most, short = items.mapInArrow(_benchmark_tokens, "item_id bigint, item binary, n_item int").agg(F.max("n_item"), F.max(F.col("n_item").between(MIN_ITEM, SHORT_ITEM - 1))).first()
    masks = MASKS + SHORT_MASKS if short else MASKS
    bits = min(MOST_BITS, max(16, (64 * size).bit_length()))
    shared = spark.sparkContext.broadcast(bit_table(index, bits))
    margin = int(most or 0)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        shift = np.uint64(64 - bits)
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, first = token_hashes(part.column(1))
                found, at = [], []
                for number, mask in enumerate(masks):
                    h = seeds(tokens, mask, number)
                    s = h >> shift
                    pos = np.flatnonzero(table[s >> np.uint64(6)] >> (s & np.uint64(63)) & np.uint64(1))
                    pos = pos[pos + len(mask) <= first[rows_of(first, pos) + 1]]
                    found.append(h[pos]), at.append(pos)
                at, found = np.concatenate(at), np.concatenate(found)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, found = at[order], found[order]
                row = rows_of(first, at)
                # hits of one document whose surroundings overlap make one region
                cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(at) > 2 * margin)) + 1
                starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
                ids = part.column(0).to_numpy()
                lo = np.maximum(first[row[starts]], at[starts] - margin)
                hi = np.minimum(first[row[starts] + 1], at[ends - 1] + margin + 1)
                yield pa.record_batch(
                    {
                        "doc_id": pa.array(ids[row[starts]], pa.int64()),
                        "start": pa.array((lo - first[row[starts]]).astype(np.int32)),
                        "tokens": pa.array([tokens[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()),
                        "hashes": pa.array([found[a:b].view(np.int64) for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int64())),
                        "at": pa.array([(at[a:b] - lo[k]).astype(np.int32) for k, (a, b) in enumerate(zip(starts, ends, strict=True))], pa.list_(pa.int32())),
                    }
                )

    texts = records(docs, key, text).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    regions = written(texts.mapInArrow(hits, "doc_id bigint, start int, tokens binary, hashes array<bigint>, at array<int>"))
    # one row per region, item and diagonal, however many seeds hit on it
    hit = regions.select("doc_id", "start", F.explode(F.arrays_zip("hashes", "at")).alias("x")).select("doc_id", "start", F.col("x.hashes").alias("h"), F.col("x.at").alias("at"))
    if size <= FEW:
        met = hit.join(F.broadcast(index), "h")
    else:
        copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = hit.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALT)).cast("int")).join(copies, ["h", "salt"])
    lines = met.select("doc_id", "start", "item_id", (F.col("at") - F.col("ipos")).alias("line")).groupBy("doc_id", "start", "item_id", "line").agg(F.count("*").alias("n_hits"))
    lines = lines.join(items.mapInArrow(_benchmark_tokens, "item_id bigint, item binary, n_item int"), "item_id")
    # a line takes along only the tokens beside the item
    beside = F.substr("tokens", F.greatest("line", F.lit(0)) * 8 + 1, (F.col("n_item") + F.least("line", F.lit(0))) * 8)
    checked = lines.join(regions.select("doc_id", "start", "tokens"), ["doc_id", "start"]).select("doc_id", "start", "item_id", "line", "item", beside.alias("tokens"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                item, tokens = np.frombuffer(x["item"], np.uint64), np.frombuffer(x["tokens"], np.uint64)
                least = min(min_tokens, max(MIN_ITEM, len(item)))
                for begin, n, same in overlaps(item, tokens, min(x["line"], 0), similarity, least):
                    out.append((x["doc_id"], x["item_id"], begin, x["start"] + x["line"] + begin, n, same, len(item)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64()] * 2 + [pa.int32()] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "item_start", "doc_start", "n_tokens", "n_matches", "n_item"])

    return checked.mapInArrow(verify, "doc_id bigint, item_id bigint, item_start int, doc_start int, n_tokens int, n_matches int, n_item int")


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(texts(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
