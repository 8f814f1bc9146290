"""Boxes made from line items and orders: nearest labels, headers and footers by consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.operators import geometry as G
from evidara.plans.registry import query, table

_BOXES = """SELECT DISTINCT (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS id, l_suppkey % 7 AS page, l_linenumber % 2 = 0 AS control,
  CAST(l_partkey * 37 % 5000 AS DOUBLE) AS x0, CAST(l_orderkey * 53 % 7000 AS DOUBLE) AS top, l_partkey * 37 % 5000 + 10.0 + l_linenumber AS x1, l_orderkey * 53 % 7000 + 6.0 + l_linenumber % 3 AS bottom FROM lineitem"""


@query(f"""
WITH b AS ({_BOXES}), c AS (SELECT id AS control_id, page, x0, top, (top + bottom) / 2 AS m FROM b WHERE control), l AS (SELECT id AS label_id, page, x1, bottom, (top + bottom) / 2 AS m FROM b WHERE NOT control),
p AS (SELECT c.page, control_id, label_id, abs(l.m - c.m) <= 12 AND l.x1 <= c.x0 AS same_line, abs(l.bottom - c.top) + abs(l.x1 - c.x0) AS cost FROM c JOIN l ON c.page = l.page),
r AS (SELECT *, row_number() OVER (PARTITION BY page, control_id ORDER BY same_line DESC, cost, label_id) AS k FROM p)
SELECT page, control_id, label_id, same_line FROM r WHERE k = 1
""")
def nearest_label_2d(spark, sf_dir):
    li, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    x, y = F.col("l_partkey") * 37 % 5000, F.col("l_orderkey") * 53 % 7000
    boxes = li.select(((F.col("l_orderkey") * 8 + n) * 1000000 + F.col("l_partkey")).alias("id"), (F.col("l_suppkey") % 7).alias("page"), (n % 2 == 0).alias("control"), x.cast("double").alias("x0"), y.cast("double").alias("top"), (x + 10.0 + n).alias("x1"), (y + 6.0 + n % 3).alias("bottom")).distinct()
    return G.nearest_labels(boxes.where("control").withColumnRenamed("id", "control_id"), boxes.where("not control").withColumnRenamed("id", "label_id"))


_PLACED = """SELECT o_custkey AS document_id, o_orderkey AS page, k, 'b' || k AS block_id, CASE k WHEN 0 THEN 'Encabezado ' || o_custkey % 5 WHEN 1 THEN 'Cuerpo ' || o_orderkey WHEN 2 THEN 'Página común' ELSE 'COPIA' END AS text,
  CASE k WHEN 0 THEN 20.0 + o_orderkey % CASE WHEN o_custkey % 2 = 0 THEN 6 ELSE 40 END WHEN 1 THEN 300.0 WHEN 2 THEN 760.0 ELSE 30.0 END AS top, CASE k WHEN 0 THEN 38.0 WHEN 1 THEN 330.0 WHEN 2 THEN 775.0 - o_orderkey % 3 ELSE 60.0 END AS bottom
  FROM orders, unnest(range(0, 4)) AS u(k)"""


@query(f"""
WITH b AS ({_PLACED}), g AS (SELECT document_id, k, text, quantile_cont(top, 0.5) AS mt, quantile_cont(bottom, 0.5) AS mb, min(top) AS lt, max(top) AS ht, min(bottom) AS lb, max(bottom) AS hb, count(DISTINCT page) AS pages FROM b WHERE k IN (0, 2) GROUP BY document_id, k, text),
x AS (SELECT document_id, k, text FROM g WHERE pages >= 2 AND ht - mt <= 8 AND mt - lt <= 8 AND hb - mb <= 8 AND mb - lb <= 8)
SELECT b.document_id, b.page, string_agg(b.text, chr(10) ORDER BY b.k) AS text, count(*) AS n_blocks FROM b LEFT JOIN x ON x.document_id = b.document_id AND x.k = b.k AND x.text = b.text WHERE x.k IS NULL GROUP BY b.document_id, b.page
""")
def boilerplate_consensus(spark, sf_dir):
    """Pages of orders with a header that agrees in every second document only, a body, a footer, and a watermark in the header's band."""
    c, k, o = F.col("o_custkey"), F.col("k"), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(c, o, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    text = F.when(k == 0, F.concat(F.lit("Encabezado "), (c % 5).cast("string"))).when(k == 1, F.concat(F.lit("Cuerpo "), o.cast("string"))).when(k == 2, "Página común").otherwise("COPIA")
    top = F.when(k == 0, 20.0 + o % F.when(c % 2 == 0, 6).otherwise(40)).when(k == 1, 300.0).when(k == 2, 760.0).otherwise(30.0)
    bottom = F.when(k == 0, 38.0).when(k == 1, 330.0).when(k == 2, 775.0 - o % 3).otherwise(60.0)
    blocks = rows.select(
        c.alias("document_id"), o.alias("page"), k.alias("ordinal"), F.concat(F.lit("b"), k.cast("string")).alias("block_id"), text.alias("text"), top.alias("top"), bottom.alias("bottom"), F.lit(792.0).alias("page_height"),
        F.lit(None).cast("string").alias("region"), F.when(k == 3, "watermark").alias("role"),
    )
    gone = G.removed(blocks)
    lost = gone.groupBy("document_id", "page").agg(F.count("*").alias("n"))
    return G.body(blocks, gone).join(lost, ["document_id", "page"], "left").select("document_id", "page", "text", (4 - F.coalesce("n", F.lit(0))).alias("n_blocks"))
