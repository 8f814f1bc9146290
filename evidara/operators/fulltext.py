"""Full-text search over an inverted index.

The index is two tables. ``postings`` has one row for each stem and document, in folders by a hash of the stem and sorted by stem and document, so a probe reads one folder
a query word and in it the row groups of that word; folders of common words are spread over several files. ``stems`` has the number of documents of each stem, in
the same folders. Words are runs of letters and digits in lower case; stop words go, the others are stemmed, each distinct word once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import spanish

BUCKETS = 64


def _bucket(stem: str = "stem") -> F.Column:
    return F.pmod(F.xxhash64(stem), F.lit(BUCKETS)).cast("int")


def terms(docs: DataFrame, *, key: str = "node_id", text: str = "text") -> DataFrame:
    """(key, stem, tf, n_words): how often a document has each stem, and how many words it has."""
    lower = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    words = docs.select(key, F.explode(F.split(F.trim(lower), " ")).alias("word")).where("word <> ''").groupBy(key, "word").agg(F.count("*").alias("n"))
    sizes = words.groupBy(key).agg(F.sum("n").alias("n_words"))
    kept = words.where(~F.col("word").isin(*sorted(spanish.STOP)))
    stems = spanish.with_stems(kept.select("word").distinct())
    return kept.join(stems, "word").groupBy(key, "stem").agg(F.sum("n").alias("tf")).join(sizes, key)


def build(docs: DataFrame, path: str, *, key: str = "node_id", text: str = "text") -> None:
    """Write the index of docs(key, text) at path."""
    rows = terms(docs, key=key, text=text).withColumn("bucket", _bucket())
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "stem", key).write.partitionBy("bucket").parquet(f"{path}/postings")
    counts = docs.sparkSession.read.parquet(f"{path}/postings").groupBy("bucket", "stem").agg(F.count("*").alias("df"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "stem").write.partitionBy("bucket").parquet(f"{path}/stems")


def asked(spark: SparkSession, question: str) -> list[tuple[str, int]]:
    """Distinct stems of a question and their buckets, at most one a word."""
    words = sorted({w for w in re.split(r"[\W_]+", question.lower()) if w} - spanish.STOP)
    if not words:
        return []
    rows = spanish.with_stems(spark.createDataFrame([(w,) for w in words], "word string")).select("stem", _bucket().alias("bucket")).distinct().collect()
    return sorted((r["stem"], r["bucket"]) for r in rows)


def search(spark: SparkSession, path: str, question: str, k: int, *, key: str = "node_id") -> DataFrame:
    """(key, score): the k best documents that have every word of the question; the sum of its stems' counts over 1 + ln(words), ties to the smaller key.

    The postings of the rarest stem come first, and those of the others are joined to them; the texts are not read."""
    wanted = asked(spark, question)
    postings = spark.read.parquet(f"{path}/postings")
    if not wanted:
        return postings.where("false").select(key, F.lit(0.0).alias("score"))
    one = lambda df, stem, bucket: df.where((F.col("bucket") == bucket) & (F.col("stem") == stem))
    counts = spark.read.parquet(f"{path}/stems")
    df = {r["stem"]: r["df"] for s, b in wanted for r in one(counts, s, b).collect()}  # one row a word of the question
    wanted.sort(key=lambda x: (df.get(x[0], 0), x[0]))
    first, *others = wanted
    found = one(postings, *first).select(key, F.col("tf").alias("total"), "n_words")
    for stem, bucket in others:
        found = found.join(one(postings, stem, bucket).select(key, "tf"), key).select(key, (F.col("total") + F.col("tf")).alias("total"), "n_words")
    return found.select(key, F.round(F.col("total") / (1 + F.log(F.col("n_words").cast("double"))), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def scan(docs: DataFrame, question: str, k: int, *, key: str = "node_id", text: str = "text") -> DataFrame:
    """What ``search`` gives, from the texts alone; to check an index with."""
    stems = [s for s, _ in asked(docs.sparkSession, question)]
    hits = terms(docs, key=key, text=text).where(F.col("stem").isin(*stems))
    found = hits.groupBy(key).agg(F.count("*").alias("n"), F.sum("tf").alias("total"), F.first("n_words").alias("n_words")).where(F.col("n") == len(stems))
    return found.select(key, F.round(F.col("total") / (1 + F.log(F.col("n_words").cast("double"))), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)
