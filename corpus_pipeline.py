"""A corpus pipeline of five stages over ``documents``: each reads all that its predecessor kept.

1. language: every document gets its language mixture; documents without any letters (``und``) go.
2. near_dedup: of each group of near copies (Jaccard similarity of 5-word shingles 0.8 or more), the document with the smallest id stays.
3. decontaminate: documents that overlap a benchmark item go.
4. secrets: what the forest judges a secret is replaced in the text; every document stays.
5. packing: token sequences; the sources' target proportions are their token counts to the power 0.7.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import decontamination, language_id, packing, secrets, simhash
from evidara.llm.common import written

#: SQL cannot express components of near copies over a tokenizer's ids; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.identify(docs, model, keep=docs.columns).where("lang_pred <> 'und'").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = simhash.near_duplicates(docs, shingle=5, similarity=0.8).where("doc_id <> component_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scanner = secrets.fit(secrets.labelled_findings(spark), secrets.learn(docs))
    return secrets.redact(docs, secrets.scan(docs, scanner))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), power=packing.POWER, keep=12 << 20, release_after=True, limit=1 << 19).drop("ids")


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", scan_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
