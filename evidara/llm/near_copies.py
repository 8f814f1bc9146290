"""Near copies by true Jaccard similarity of word shingles, without false negatives.

A text is the set of its distinct shingles. In any one order of all shingles, two sets with a Jaccard similarity of s or more
share a shingle among the first n - ceil(s * n) + 1 of each (prefix filter); so the texts of one prefix shingle are all that
need comparing. The order puts shingles that a bounded sample knows as common last; it decides how large groups get, never
what is found. Sizes, and the parities of counts per hash slot, bound the similarity of a pair from above: pairs that they rule out go first (1024 slots at
first, then four a shingle), the rest is compared in full.

Pairs that the caller suggests (fingerprints within a few bits) are checked first, and each group links its texts with the one that has most
shared shingles; after that only pairs that no link connects yet are compared, so thousands of copies of one text do not produce all their
pairs. Equal sets count once. The rest of a group is judged as if its shingle were the first that a pair shares: then all shingles before it are different, and
the parities need to bound those from it on alone. A pair that shares many shingles so comes up under its first ones only.

Results: one row per document; the component is the smallest doc_id reachable over links. Texts with fewer words than a shingle are one
shingle, texts without words are all equal. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import dropped, records, written
from evidara.llm.components import components
from evidara.llm.textarrays import LOWER, buffers, leaves_nothing, mix, slices, word_hashes, word_spans

SHINGLE = 5
SIMILARITY = 0.8
#: Texts of the sample that orders the shingles, and shingles that it names at most.
SAMPLE, COMMON = 10000, 1 << 18
WORDS = 16
#: Bytes of text that a task works on at a time.
SLICE = 1 << 20


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    data, offsets = buffers(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)

    def together(parts) -> np.ndarray:
        h = np.full(len(parts[0]), len(parts), dtype=np.uint64)
        for x in parts:
            h = h * np.uint64(0x9DDFEA08EB382D69) + x
        return mix(h)

    n = max(0, len(words) - shingle + 1)
    whole = together([words[i : i + n] for i in range(shingle)])
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= shingle:
            out.append(np.unique(whole[a : b - shingle + 1]))
        else:
            out.append(together([words[i : i + 1] for i in range(a, b)]) if b > a else np.zeros(1, np.uint64))
    return out


def prefix(found: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the order of all: those of ``common`` (rarest first) come last, the others by hash."""
    n = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1
    if len(common):
        by_hash, rank = common
        at = np.minimum(np.searchsorted(by_hash, found), len(by_hash) - 1)
        late = np.where(by_hash[at] == found, rank[at], 0)
        if late.any():
            found = found[np.argsort(late, kind="stable")]
    return found[:n]


def parities(found: np.ndarray) -> np.ndarray:
    """Parities of the set's counts in its slots (by low bits of the hash), as 64-bit words: four slots a shingle, 64 * WORDS at least,
    a power of two. Halves fold onto each other by exclusive or."""
    slots = max(64 * WORDS, 1 << (4 * len(found) - 1).bit_length())
    return np.packbits((np.bincount((found & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1).astype(np.uint8)).view(np.int64)


def later(parity: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One row for each shingle of a prefix: the set's parities (64 * WORDS slots) without the shingles before it."""
    slot = order.view(np.uint64) & np.uint64(64 * WORDS - 1)
    gone = np.zeros((len(order), 8 * WORDS), dtype=np.uint8)
    gone[np.arange(1, len(order)), (slot[:-1] >> np.uint64(3)).astype(np.int64)] = 0x80 >> (slot[:-1] & np.uint64(7)).astype(np.int64)
    return np.bitwise_xor.accumulate(gone.view(np.int64), axis=0) ^ parity


def near_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, suggest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, component_id): components of documents whose shingle sets have the given Jaccard similarity or more.

    ``suggest`` makes pairs (a, b) of likely near copies from rows of doc_id and text; they are checked before all others, so the fewer pairs are left."""
    rows = records(docs, key, text).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield pa.record_batch({"h": pa.array(np.concatenate(shingle_sets(part.column(1), shingle)).view(np.int64))})

    every = max(1, rows.count() // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).mapInArrow(hashes, "h bigint")
    known = sample.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()  # at most COMMON rows
    by_hash = known.column(0).to_numpy().view(np.uint64)
    order = np.argsort(by_hash)
    # the most common come first in known and so get the last ranks
    shared_order = rows.sparkSession.sparkContext.broadcast((by_hash[order], (len(by_hash) - np.arange(len(by_hash)))[order]) if len(by_hash) else ())

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared_order.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = shingle_sets(part.column(1), shingle)
                fine = [parities(x) for x in found]
                parity = [np.bitwise_xor.reduce(x.reshape(-1, WORDS), axis=0) for x in fine]
                yield pa.record_batch(
                    {
                        "doc_id": part.column(0),
                        "n": pa.array([len(x) for x in found], pa.int32()),
                        "same": pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary()),
                        "parity": pa.array(parity, pa.list_(pa.int64())),
                        "fine": pa.array(fine, pa.list_(pa.int64())),
                        "prefix": pa.array([prefix(x, common, similarity).view(np.int64) for x in found], pa.list_(pa.int64())),
                    }
                )

    made = written(rows.mapInArrow(leaves_nothing(sketches), "doc_id bigint, n int, same binary, parity array<bigint>, fine array<bigint>, prefix array<bigint>"))
    classes = written(made.groupBy("same").agg(F.min("doc_id").alias("first_doc")))
    sketch = made.select("doc_id", "n", "parity")
    entries = made.join(classes.select(F.col("first_doc").alias("doc_id")), "doc_id", "left_semi").select(F.explode("prefix").alias("h"), "doc_id")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of shingles that several texts hold; rows come sorted."""
        last = low = None
        held = 0  # the last row of the batch before, if nothing followed it yet
        for batch in batches:
            h, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(h):
                continue
            if last is not None:
                h, d = np.concatenate([[last], h]), np.concatenate([[low], d])
            start = np.concatenate([[True], h[1:] != h[:-1]])
            at = np.flatnonzero(start)
            lows = np.repeat(d[at], np.diff([*at, len(h)]))
            # the carried row goes out only if it did not before
            keep = d != lows
            first = np.flatnonzero(start[:-1] & ~start[1:])
            if last is not None and len(first) and first[0] == 0 and held:
                first = first[1:]
            keep[first] = True
            held = (held if len(at) == 1 and last is not None else 0) or int(len(h) > at[-1] + 1)
            last, low = h[-1], lows[-1]
            yield pa.record_batch({"h": pa.array(h[keep]), "doc_id": pa.array(d[keep])})

    shared = written(entries.repartition("h").sortWithinPartitions("h", "doc_id").mapInArrow(leaves_nothing(groups), "h bigint, doc_id bigint"))
    side = lambda name: sketch.select(*[F.col(c).alias(f"{c}_{name}") for c in sketch.columns])
    apart = sum((F.bit_count(F.get("parity_a", F.lit(i)).bitwiseXOR(F.get("parity_b", F.lit(i)))) for i in range(WORDS)), F.lit(0))
    may = (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6) & (apart <= (F.col("n_a") + F.col("n_b")) * (1 - similarity) / (1 + similarity) + 1e-6)

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs that are similar enough."""
        fine = lambda name: made.select(F.col("doc_id").alias(name), F.col("n").alias(f"n_{name}"), F.col("fine").alias(f"f_{name}"))
        least = F.least(F.size("f_a"), F.size("f_b"))
        fold = lambda x: F.when(F.size(x) > least, F.zip_with(F.slice(x, 1, least), F.slice(x, least + 1, least), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))
        different = F.aggregate(F.zip_with(fold("f_a"), fold("f_b"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
        pairs = written(pairs.join(fine("a"), "a").join(fine("b"), "b").where(different <= (F.col("n_a") + F.col("n_b")) * (1 - similarity) / (1 + similarity) + 1e-6).select("a", "b"))
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        # a bit table of the ids (up to 2**30 bits) keeps the other texts out; it drops none of these
        bits = min(30, max(16, (16 * ids.count()).bit_length()))
        slot = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits)
        bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(doc_id), {64 - bits}) & 63 as int))")
        table = np.zeros(1 << (bits - 6), dtype=np.uint64)
        for w, x in ids.select(F.shiftrightunsigned(slot, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect():  # at most 2**(bits - 6) rows
            table[w] = np.uint64(x & 0xFFFFFFFFFFFFFFFF)
        shared_table = rows.sparkSession.sparkContext.broadcast(table)

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared_table.value
            for batch in batches:
                at = batch.column(2).to_numpy()
                batch = batch.filter(pa.array((table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
                for part in slices(batch, "text", SLICE):
                    found = shingle_sets(part.column(1), shingle)
                    yield pa.record_batch({"doc_id": part.column(0), "shingles": pa.array([x.tobytes() for x in found], pa.binary())})

        full = written(rows.withColumn("slot", slot).mapInArrow(leaves_nothing(sets), "doc_id bigint, shingles binary"))

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
                yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

        of = lambda name: full.select(F.col("doc_id").alias(name), F.col("shingles").alias(f"s_{name}"))
        checked = written(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(leaves_nothing(check), "a bigint, b bigint"))
        dropped(full)
        dropped(pairs)
        return checked

    # the text of a group with most shared shingles has the fewest of its own, and so is near most of the others
    central = shared.join(shared.groupBy("doc_id").agg(F.count("*").alias("k")), "doc_id").groupBy("h").agg(F.max(F.struct("k", (-F.col("doc_id")).alias("d"))).alias("top")).select("h", (-F.col("top.d")).alias("low"))
    stars = shared.join(central, "h").where("doc_id <> low").select(F.least("low", "doc_id").alias("doc_id_a"), F.greatest("low", "doc_id").alias("doc_id_b"))
    if suggest:
        first = made.select("doc_id", "same").join(classes, "same")
        of = lambda name: first.select(F.col("doc_id").alias(name), F.col("first_doc").alias(f"first_{name}"))
        told = suggest(rows).join(of("a"), "a").join(of("b"), "b").where("first_a <> first_b")
        stars = stars.union(told.select(F.least("first_a", "first_b"), F.greatest("first_a", "first_b")))
    stars = stars.distinct()
    links = verified(stars.join(side("a"), "doc_id_a").join(side("b"), "doc_id_b").where(may).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")))
    found = written(components(links))
    member = shared.select("h", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    member = written(member)
    # groups that are one component already have nothing left to compare
    mixed = member.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("h")
    held = member.join(mixed, "h", "left_semi").groupBy("doc_id").agg(F.first("component").alias("component"), F.collect_list("h").alias("own"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each of a text's shingles in mixed groups: its place in the prefix, and the parities from it on."""
        for batch in batches:
            for row in batch.to_pylist():
                order = np.array(row["prefix"], dtype=np.int64)
                at = np.flatnonzero(np.isin(order, row["own"]))
                same = lambda name: pa.array(np.full(len(at), row[name]))  # noqa: E731, B023
                yield pa.record_batch({"h": pa.array(order[at]), "doc_id": same("doc_id"), "component": same("component"), "n": pa.array(np.full(len(at), row["n"], np.int32)), "at": pa.array(at.astype(np.int32)), "parity": pa.array(list(later(np.array(row["parity"], dtype=np.int64), order)[at]), pa.list_(pa.int64()))})

    kept = made.select("doc_id", "n", "parity", "prefix").join(held, "doc_id")
    rest = written(kept.mapInArrow(leaves_nothing(placed), "h bigint, doc_id bigint, component bigint, n int, at int, parity array<bigint>"))
    end = lambda name: rest.select("h", *[F.col(c).alias(f"{c}_{name}") for c in ("doc_id", "component", "n", "at", "parity")])
    # a is the smaller set; from the first shared shingle on it must still hold as many shingles as the pair needs to share
    small = end("a").where(F.col("n_a") - F.col("at_a") >= 2 * similarity / (1 + similarity) * F.col("n_a") - 1e-6)
    longer = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("doc_id_a") < F.col("doc_id_b")))
    bound = may & (apart + F.col("at_a") + F.col("at_b") <= (F.col("n_a") + F.col("n_b")) * (1 - similarity) / (1 + similarity) + 1e-6)
    more = small.join(end("b"), "h").where(longer & (F.col("component_a") != F.col("component_b")) & bound)
    more = verified(more.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct())
    for table in (shared, member, found, rest):
        dropped(table)
    found = components(links.union(more)).withColumnRenamed("node", "first_doc")
    # components are of the smallest documents of equal sets, and so is the smallest document of each
    named = classes.join(found, "first_doc", "left").select("same", F.coalesce("component", "first_doc").alias("component_id"))
    return made.select("doc_id", "same").join(named, "same").select("doc_id", "component_id")
