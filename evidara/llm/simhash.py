"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits; texts link if theirs differ in at most two. The fingerprint is cut into two 32-bit
segments. Of two linked fingerprints either the upper segments differ in at most one bit, or the lower ones are equal:
so each fingerprint is stored under both its segments, and looks up the Hamming ball of radius one around its upper
segment (33 keys) and its lower segment itself (one key). What meets under a key is compared in full. Copies share a
fingerprint and count once, and what meets under a key is linked by a spanning forest, so neither thousands of copies nor
thousands of near copies produce all their pairs.

Results: a null or word-less text has fingerprint zero, which links like any other. Texts with fewer words than a
shingle are one shingle. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import records, written
from evidara.llm.components import components
from evidara.llm.near_copies import near_copies
from evidara.plans.registry import texts

DISTANCE = 2
SHINGLE = 3
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) > shingle:
        h = [xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)), strict=False)]
    else:
        h = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    bits = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(h)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as signed bigint."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], dtype=np.uint64)
            yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))})

    rows = records(docs, key, text).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(compute, "doc_id bigint, fp bigint")


def bucket_edges(fps: np.ndarray, home: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the links between stored (home) fingerprints and all that meet them under one key.

    A search from each fingerprint in turn compares it with those not reached yet, and so keeps one link for each."""
    edges = []
    waiting, stored = fps, home
    while len(waiting) > 1:
        frontier = [(waiting[0], stored[0])]
        waiting, stored = waiting[1:], stored[1:]
        while frontier and len(waiting):
            x, at_home = frontier.pop()
            near = np.bitwise_count(waiting ^ x) <= distance
            if not at_home:
                near &= stored
            if near.any():
                edges += [(int(x), int(y)) for y in waiting[near]]
                frontier += zip(waiting[near], stored[near], strict=True)
                waiting, stored = waiting[~near], stored[~near]
    return edges


def links(distinct: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """distinct(fp) -> edges (a, b) that connect all fingerprints within two bits of each other."""
    fp = F.col("fp")
    upper, lower = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    entry = lambda tag, value, home: F.struct(value.bitwiseOR(F.lit(tag << 32).cast("bigint")).alias("bucket"), F.lit(home).alias("home"))
    ball = [entry(0, upper.bitwiseXOR(F.lit(1 << i).cast("bigint")), False) for i in range(32)]
    entries = distinct.select("fp", F.explode(F.array(entry(0, upper, True), entry(1, lower, True), *ball)).alias("e")).select("e.bucket", "fp", "e.home")

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def solve(bucket, fps, home):
            cut = np.flatnonzero(np.diff(bucket)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(bucket)]])
            stored = np.add.reduceat(home.astype(np.int64), starts)
            out = []
            for k in np.flatnonzero((ends - starts > 1) & (stored > 0)):
                out += bucket_edges(fps[starts[k] : ends[k]].view(np.uint64), home[starts[k] : ends[k]])
            pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

        for batch in batches:
            arrays = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if rest is not None:
                arrays = [np.concatenate(x) for x in zip(rest, arrays, strict=True)]
            if not len(arrays[0]):
                continue
            last = np.searchsorted(arrays[0], arrays[0][-1])
            rest = [x[last:] for x in arrays]
            if last:
                yield solve(*(x[:last] for x in arrays))
        if rest is not None:
            yield solve(*rest)

    parts = entries.repartition(partitions, "bucket") if partitions else entries.repartition("bucket")
    return parts.sortWithinPartitions("bucket").mapInArrow(connect, "a bigint, b bigint").distinct()


def meetings(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """(a, b): pairs of documents that connect all whose fingerprints are within two bits of each other, found by multi-index hashing."""
    prints = written(fingerprints(docs, shingle=shingle))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    end = lambda name: first.select(F.col("fp").alias(name), F.col("first_doc").alias(f"first_{name}"))
    apart = links(first.select("fp")).join(end("a"), "a").join(end("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return apart.union(prints.join(first, "fp").where("doc_id <> first_doc").select("first_doc", "doc_id"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id): the component is the smallest doc_id reachable over links, the document's own included.

    With ``similarity`` texts link whose shingle sets have that Jaccard similarity (and there is no fp): multi-index hashing gives the first pairs to check. Most such
    pairs have fingerprints too far apart for Hamming balls, so ``near_copies`` then takes those that it leaves unconnected, and misses none."""
    if similarity is not None:
        return near_copies(docs, key=key, text=text, shingle=shingle, similarity=similarity, suggest=lambda rows: meetings(rows, shingle=shingle))
    prints = written(fingerprints(docs, key=key, text=text, shingle=shingle))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    found = components(links(classes.select("fp")))
    # components are of fingerprints; the smallest doc_id of the whole component names it
    of = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = of.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    return prints.join(of.select("fp", "component").join(named, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(texts(spark, sf_dir))
    return found.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
