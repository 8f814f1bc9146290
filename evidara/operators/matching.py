"""Many patterns at once: one automaton of all terms, one pass over a text, every hit with its place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.functions import text as T

#: Characters of the terms in one broadcast automaton; more terms are dealt into several, each with a pass of its own.
LIMIT = 4_000_000


def hits(texts: DataFrame, terms: DataFrame, *, key: tuple[str, ...] = ("document_id", "page_number"), text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, term_id, start) of every place where a text holds a term, overlapping ones too; start from 0, in characters. terms(term_id bigint, term): null and
    empty ones are nowhere; equal terms are each found. A null text holds nothing."""
    spark = texts.sparkSession
    asked = terms.select(F.col("term_id").cast("bigint").alias("term_id"), "term").where(F.col("term") != "")
    size = asked.agg(F.sum(F.length("term"))).first()[0] or 0
    groups = -(-size // limit) or 1
    out = None
    for g in range(groups):
        part = asked.where(F.pmod(F.xxhash64("term"), F.lit(groups)) == g)
        names: dict[str, list[int]] = {}
        for r in part.toLocalIterator():  # bounded by the limit
            names.setdefault(r["term"], []).append(r["term_id"])
        found = _pass(texts.select(*key, text), spark.sparkContext.broadcast(names), key)
        out = found if out is None else out.unionByName(found)
    return out


def _pass(texts: DataFrame, names, key: tuple[str, ...]) -> DataFrame:
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, ids in names.value.items():
            automaton.add_word(term, (len(term), ids))
        if names.value:
            automaton.make_automaton()
        for batch in batches:
            row, ids, starts = [], [], []
            for i, value in enumerate(batch.column(n).to_pylist()):
                for end, (size, found) in automaton.iter(value) if value and names.value else ():
                    row += [i] * len(found)
                    ids += found
                    starts += [end - size + 1] * len(found)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(n)), pa.array(ids, pa.int64()), pa.array(starts, pa.int32())], names=[*key, "term_id", "start"])

    shape = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in key)
    return texts.mapInArrow(run, f"{shape}, term_id bigint, start int")


def anchors(expected: DataFrame, pages: DataFrame, *, document: str = "document_id") -> DataFrame:
    """(document, anchor, pages): on how many of its document's pages each expected anchor stands, in normalised text; 0 for lost ones. expected(document, anchors array),
    pages(document, page_number, text). Texts and anchors are normalised once, and no anchor is tried on a page by itself."""
    wanted = expected.select(document, F.explode("anchors").alias("anchor")).distinct()
    terms = wanted.select(T.normalize_text(F.col("anchor")).alias("term")).where("term <> ''").distinct().withColumn("term_id", F.xxhash64("term"))
    found = hits(pages.select(document, "page_number", T.normalize_text(F.col("text")).alias("text")), terms, key=(document, "page_number")).select(document, "page_number", "term_id").distinct()
    told = found.groupBy(document, "term_id").agg(F.count("*").alias("pages"))
    named = wanted.withColumn("term_id", F.xxhash64(T.normalize_text(F.col("anchor"))))
    return named.join(told, [document, "term_id"], "left").select(document, "anchor", F.coalesce("pages", F.lit(0)).alias("pages"))
