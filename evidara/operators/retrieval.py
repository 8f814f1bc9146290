"""Retrieval: exact vector and lexical search, fusion, parent expansion, evidence rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import text as T
from evidara.functions import vectors as V


def lane(vectors: DataFrame, **scope: object) -> DataFrame:
    """Rows of one lane; filters on partition columns reach the scan."""
    for column, value in scope.items():
        vectors = vectors.where(F.col(column) == F.lit(value))
    return vectors


def with_metadata(nodes: DataFrame, filters: dict[str, str], column: str = "metadata") -> DataFrame:
    """Equality on every listed key; a missing key differs from any value."""
    for key, value in filters.items():
        nodes = nodes.where(F.col(column)[key] == F.lit(value))
    return nodes


def vector_topk(vectors: DataFrame, query: list[float] | Column, k: int, *, metric: str = "cosine", vector: str = "embedding", key: str = "node_id") -> DataFrame:
    """The k best rows by score, ties to the smaller key."""
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", F.round(V.score(F.col(vector), q, metric), 6)).orderBy(F.desc("score"), key).limit(k)


#: Rows of a block of queries and of data, and queries whose scores a task holds at a time.
QUERY_BLOCK, DATA_BLOCK, TILE = 2048, 16384, 128


def _block_best(queries: pa.Table, rows: pa.Table, k: int, metric: str, key: str) -> pa.Table:
    """The k best rows of a block for each of its queries: one matrix product a tile."""
    matrix = lambda x: np.stack(x.to_numpy()).astype(np.float64) if len(x) else np.zeros((0, 0))
    ids, q, keys, v = queries["query_id"].to_numpy(), matrix(queries["query"]), rows[key].to_numpy(), matrix(rows["_v"])
    order = np.argsort(keys, kind="stable")
    keys, v = keys[order], v[order]
    out: list[tuple] = []
    size = np.sqrt((v * v).sum(axis=1)) if len(v) else np.zeros(0)
    for a in range(0, len(ids) if len(keys) else 0, TILE):
        part = q[a : a + TILE]
        dots = part @ v.T
        if metric == "cosine":
            both = np.sqrt((part * part).sum(axis=1))[:, None] * size[None, :]
            scores = np.divide(dots, both, out=np.zeros_like(dots), where=both > 0)
        elif metric == "l2":
            apart = np.zeros_like(dots)
            for x, y in zip(part.T, v.T, strict=True):
                apart += (x[:, None] - y[None, :]) ** 2
            scores = 1 - np.sqrt(apart)
        else:
            scores = 1 + dots
        scores = np.where(keys[None, :] == ids[a : a + TILE, None], -np.inf, np.round(scores, 6))
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # keys ascend, so ties go to the smaller one
        best = np.take_along_axis(scores, top, axis=1)
        out.append((np.repeat(ids[a : a + TILE], top.shape[1]), keys[top.ravel()], best.ravel()))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [ids[:0], keys[:0], np.zeros(0)]
    real = columns[2] > -np.inf
    return pa.table({"query_id": columns[0][real], key: columns[1][real], "score": columns[2][real]})


def batch_topk(queries: DataFrame, vectors: DataFrame, k: int, *, metric: str = "cosine", key: str = "node_id", vector: str = "embedding") -> DataFrame:
    """Top-k of every query(query_id, query) over one set of vectors but the query's own row: rows (query_id, key, score, rank), ties to the smaller key. Keys and query ids are
    of one type; null vectors take no part.

    Queries and vectors are dealt into blocks. Each pair of blocks meets in one task, which multiplies two matrices and keeps k rows a query; so a task holds two blocks, and
    k rows for each query and block of data are shuffled, whatever the tables' sizes."""
    asked, rows = queries.select("query_id", "query").dropna(), vectors.select(F.col(key), F.col(vector).alias("_v")).dropna()
    n_queries, n_rows = -(-asked.count() // QUERY_BLOCK), -(-rows.count() // DATA_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0))))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(max(n, 1))).cast("int")
    a = asked.withColumn("_q", deal("query_id", n_queries)).select("*", every(n_rows).alias("_d"))
    b = rows.withColumn("_d", deal(key, n_rows)).select("*", every(n_queries).alias("_q"))
    shape = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double"
    met = a.groupBy("_q", "_d").cogroup(b.groupBy("_q", "_d")).applyInArrow(lambda x, y: _block_best(x, y, k, metric, key), shape)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", key, "score", "rank")


def lexical_overlap(nodes: DataFrame, terms: list[str], k: int, *, text: str = "text", key: str = "node_id") -> DataFrame:
    """(key, score): distinct query terms in the text over distinct query terms."""
    asked = sorted(set(terms))
    hits = F.size(F.array_intersect(T.words(F.col(text)), F.array(*[F.lit(x) for x in asked])))
    # a generated column: the words are made once a text, however often the score is used
    scored = nodes.select(key, F.explode(F.array(F.round(hits / len(asked), 6))).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), key).limit(k)


def lexical_all_terms(nodes: DataFrame, terms: list[str], k: int, *, text: str = "text", key: str = "node_id") -> DataFrame:
    """(key, score) of texts with every term; rank: term frequency over 1 + ln(words)."""
    asked = sorted(set(terms))
    # one pass over the words: how many there are, and how many are each term
    start = F.struct(F.lit(0).alias("n"), *[F.lit(0).alias(f"t{i}") for i in range(len(asked))])
    step = lambda a, w: F.struct((a["n"] + 1).alias("n"), *[(a[f"t{i}"] + (w == F.lit(t)).cast("int")).alias(f"t{i}") for i, t in enumerate(asked)])
    counted = nodes.select(key, F.inline(F.array(F.aggregate(T.words(F.col(text)), start, step))))
    total = sum((F.col(f"t{i}") for i in range(1, len(asked))), F.col("t0"))
    found = counted.where(" and ".join(f"t{i} > 0" for i in range(len(asked))))
    return found.select(key, F.round(total / (1 + F.log(F.col("n").cast("double"))), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def rrf(lists: DataFrame, *, k: int = 60, by: tuple[str, ...] = (), key: str = "node_id") -> DataFrame:
    """Reciprocal rank fusion of rows (source, rank, key): sum of 1 / (k + rank), and the sources in order."""
    return lists.groupBy(*by, key).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def expand_parents(hits: DataFrame, parents: DataFrame, *, keep_orphans: bool = True) -> DataFrame:
    """hits(node_id, parent_node_id, page_number, section, score) with the parent's text; empty sections fall through to the parent's.

    keep_orphans False: a parent takes its leaf's place and a leaf without parent goes."""
    p = parents.select(F.col("node_id").alias("parent_node_id"), F.col("text").alias("parent_text"), F.col("page_number").alias("parent_page"), F.col("section").alias("parent_section"))
    joined = hits.join(p, "parent_node_id", "left" if keep_orphans else "inner")
    return joined.withColumn("page_number", F.coalesce("page_number", "parent_page")).withColumn("section", F.coalesce(F.nullif("section", F.lit("")), "parent_section")).drop("parent_page", "parent_section")


def evidence(hits: DataFrame) -> DataFrame:
    """Evidence flags: page range, low confidence under 0.5, review if the document is not processed."""
    return hits.withColumns({"page_start": F.col("page_number"), "page_end": F.col("page_number"), "low_confidence": F.col("score") < 0.5, "needs_review": F.col("processing_status") != "processed"})


def policy(profiles: DataFrame) -> DataFrame:
    """Which search a profile runs: vector, lexical after a failed embedding unless its policy is never, or blocked."""
    usable = F.col("active") & F.col("query_enabled") & (F.col("compatibility_status") == "compatible")
    mode = F.when(~usable, "blocked").when(F.col("embedding_ok"), "vector").when(F.col("fallback_policy") == "never", "blocked").otherwise("lexical")
    return profiles.withColumn("mode", mode).withColumn("runtime_status", F.when(F.col("mode") == "vector", "ready").otherwise("failed"))


def hit_rates(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """ranked(query_id, rank, node_id), relevant(query_id, relevant_id): recall at k (any hit) and mean reciprocal rank over ranked queries."""
    wanted = relevant.select(F.col("query_id"), F.col("relevant_id").alias("node_id"), F.lit(True).alias("_hit")).distinct()
    first = ranked.select("query_id", "rank", "node_id").join(wanted, ["query_id", "node_id"], "left").groupBy("query_id").agg(F.min(F.when(F.col("_hit"), F.col("rank"))).alias("first"))
    return first.agg(F.round(F.avg((F.coalesce("first", F.lit(1 << 30)) <= k).cast("double")), 6).alias("recall_at_k"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
