"""Exact top-k inner products as a Voronoi kNN join.

Pivots are a bounded sample of the vectors. Every vector belongs to the cell of its nearest pivot; a cell's summary is its count and
radius. With q a query, p a cell's pivot and r the distance of a vector from it, q.p - |q| r <= q.x <= q.p + |q| r. So the summaries
give each query a score that its k-th best reaches at least (as does its k-th best among the sampled vectors), and each group of
queries, which are grouped by pivots too, the least radius that a vector of each cell must have to matter. Only those vectors are replicated to the
group, and a query is sent only to blocks that reach out far enough for it. Cells are dealt into rings and groups into blocks of bounded size, so a vector that a
third of all rows repeat is many blocks; each block pair is solved by one matrix product, and the block winners are merged.

Results: per query the k highest scores, ties to the smaller id, all if there are fewer; a query is not its own candidate.
Vectors that are null or hold a null or non-finite component take no part; shorter vectors count as filled up with zeros. A
score beyond the range of long counts as the nearest long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.common import records, written

SCALE = 1024
#: Sampled vectors, of which the first are pivots: one for PER_CELL vectors, PIVOTS at most.
SAMPLE, PIVOTS, PER_CELL = 1024, 512, 1500
#: Rows of data, and of queries, that one block pair holds about.
BLOCK, QUERIES = 4096, 4096
#: Queries whose scores with a block are held at a time.
AT_ONCE = 256
RINGS = 32
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
FOUND = "query_id bigint, vec_id bigint, score bigint"


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Scaled and floored vectors as doubles, short ones filled with zeros."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    n = np.diff(offsets)
    out = np.zeros((len(n), dim))
    at = np.arange(dim) < n[:, None]
    out[at] = np.floor(SCALE * values[offsets[0] : offsets[-1]])
    return out


def top(queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a block for every query, of those that reach its least score. ids ascend."""
    bound = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * data.shape[1]
    if bound < EXACT:
        scores = queries @ data.T
    else:  # beyond what doubles hold exactly
        whole = [[int(x) for x in row] for row in data]
        scores = np.array([[max(LEAST, min(MOST, sum(int(a) * b for a, b in zip(q, row, strict=True)))) for row in whole] for q in queries], dtype=object)
    out: list[tuple] = []
    for i in range(len(queries)):
        own = scores[i]
        at = np.flatnonzero((own >= least[i]) & (ids != query_ids[i]))
        if len(at) > k and bound < EXACT:
            edge = np.partition(own[at], len(at) - k)[len(at) - k]
            at = at[own[at] >= edge]
        at = at[np.argsort([-x for x in own[at]] if bound >= EXACT else -own[at], kind="stable")[:k]]
        out.append((np.full(len(at), query_ids[i]), ids[at], np.array([int(x) for x in own[at]], dtype=np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row of ``vectors`` where ``is_query`` (an expression over vec_id)."""
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # single-precision components stay so; everything else is read as double
    real = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = records(vectors, key, vector).select(F.col(key).alias("vec_id"), F.col(vector).cast(f"array<{real}>").alias("v")).where(usable)
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.count_if(is_query).alias("q")).first()
    n, dim, n_queries = shape["n"], max(shape["dim"] or 1, 1), shape["q"]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas() if n else rows.limit(0).toPandas()
    marks = matrix(pa.array(list(sample["v"]), pa.list_(pa.float32() if real == "float" else pa.float64())), dim) if len(sample) else np.zeros((1, dim))
    mark_ids = sample["vec_id"].to_numpy() if len(sample) else np.array([-1])
    distinct = np.sort(np.unique(marks, axis=0, return_index=True)[1])
    pivots = marks[distinct[: min(PIVOTS, max(1, n // PER_CELL))]]
    centres = pivots[: min(len(pivots), max(1, math.ceil(n_queries / QUERIES)))]

    def nearest(x: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        square = (x**2).sum(axis=1)[:, None] - 2 * x @ to.T + (to**2).sum(axis=1)
        cell = square.argmin(axis=1)
        return cell, np.linalg.norm(x - to[cell], axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, radius = nearest(matrix(batch.column(1), dim), pivots)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(radius)], names=["vec_id", "v", "cell", "radius"])

    data = written(rows.mapInArrow(assign, f"vec_id bigint, v array<{real}>, cell int, radius double"))
    summary = {x["cell"]: x for x in data.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).collect()}  # PIVOTS rows at most
    cells = np.array(sorted(summary), dtype=np.int64)
    counts = np.array([summary[c]["n"] for c in cells])
    radii = np.array([summary[c]["radius"] for c in cells])
    safe = 1 + 1e-9

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix(batch.column(1), dim)
            ids = batch.column(0).to_numpy()
            size = np.linalg.norm(q, axis=1)
            middle = q @ pivots[cells].T
            low = middle - size[:, None] * radii * safe
            order = np.argsort(-low, axis=1)
            enough = (np.cumsum(counts[order], axis=1) >= k + 1).argmax(axis=1)  # one more, for the query itself
            least = np.take_along_axis(np.take_along_axis(low, order, axis=1), enough[:, None], axis=1)[:, 0] if counts.sum() > k else np.full(len(q), -np.inf)
            seen = q @ marks.T
            seen[ids[:, None] == mark_ids] = -np.inf
            if seen.shape[1] > k:
                least = np.maximum(least, np.partition(seen, -k, axis=1)[:, -k])
            least = np.minimum(least, MOST)
            least = least - 1e-9 * (np.abs(least) + 1)
            group, _ = nearest(q, centres)
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(size[:, None] > 0, (least[:, None] - middle) / size[:, None] / safe, np.where(least[:, None] <= 0, 0, np.inf))
            need = np.where(np.isnan(need), 0, np.maximum(need, 0))
            yield pa.record_batch(
                {
                    "query_id": batch.column(0), "v": batch.column(1), "least": pa.array(np.where(np.isfinite(least), least, -1.7e308)),
                    "group": pa.array(group.astype(np.int32)), "need": pa.array(list(need), pa.list_(pa.float64())),
                }
            )

    asked = written(data.where(is_query).select("vec_id", "v").mapInArrow(bounds, f"query_id bigint, v array<{real}>, least double, group int, need array<double>"))
    # blocks of queries, and for each the least radius in every cell
    share = asked.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
    asked = asked.join(share, "group").withColumn("qblock", F.concat_ws("-", "group", F.pmod(F.xxhash64("query_id"), "parts")))
    reach = asked.select("qblock", F.posexplode("need").alias("c", "need")).groupBy("qblock", "c").agg(F.min("need").alias("need"))
    # a block of queries meets only cells that reach out as far as it needs
    of_cell = lambda values: F.element_at(F.array(*[F.lit(x) for x in values] or [F.lit(0)]), F.col("c") + 1)
    met = F.col("need") * (1 - 1e-9) - 1e-9
    reach = reach.where(met <= of_cell(float(x) for x in radii)).select("qblock", of_cell(int(c) for c in cells).alias("cell"), "need")
    # blocks of a cell are rings about its pivot, cut further by id if there are more than RINGS
    cuts = [i / RINGS for i in range(1, RINGS)]
    parts = data.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"), F.percentile_approx("radius", cuts).alias("cuts"))
    ring = F.floor(F.size(F.filter("cuts", lambda x: x < F.col("radius"))) * F.least("parts", F.lit(RINGS)) / RINGS)
    dealt = data.join(F.broadcast(parts), "cell")  # PIVOTS rows at most
    dealt = dealt.withColumn("dblock", ring * F.ceil(F.col("parts") / RINGS) + F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("parts") / RINGS)))
    blocks = dealt.groupBy("cell", "dblock").agg(F.max("radius").alias("far"))
    sent = dealt.join(reach, "cell").where(F.col("radius") >= met).select("qblock", "cell", "dblock", "vec_id", "v")
    # a query goes to the blocks that reach out as far as it needs
    each = asked.select("qblock", "query_id", "v", "least", F.posexplode("need").alias("c", "need")).where(met <= of_cell(float(x) for x in radii))
    each = each.withColumn("cell", of_cell(int(c) for c in cells))
    posed = each.join(blocks, "cell").where(F.col("far") >= met).select("qblock", "cell", "dblock", "query_id", "v", "least")
    posed = posed.select(*[F.col(c).alias(c) for c in posed.columns])  # columns of its own beside those of sent

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        left = left.sort_by("vec_id").combine_chunks()
        right = right.combine_chunks()
        flat = lambda t, c: t.column(c).combine_chunks()
        asked, ids, least = matrix(flat(right, "v"), dim), right.column("query_id").to_numpy(), right.column("least").to_numpy()
        data, data_ids = matrix(flat(left, "v"), dim), left.column("vec_id").to_numpy()
        parts = [top(asked[i : i + AT_ONCE], ids[i : i + AT_ONCE], least[i : i + AT_ONCE], data, data_ids, k) for i in range(0, len(ids), AT_ONCE)]
        got = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in got], schema=kinds)

    on = ("qblock", "cell", "dblock")
    local = sent.groupBy(*on).cogroup(posed.groupBy(*on)).applyInArrow(solve, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH usable AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""
