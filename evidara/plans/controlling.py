"""Queries of classification and control fields over lines that the driver's rows stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.operators import classify as C
from evidara.operators import control as D
from evidara.plans.registry import query, table, texts

_TITLES = ("Reglamento interno de higiene", "Política de seguridad vial", "Objetivos y metas", "Acta del comité paritario", "Pausas activas y fatiga", "Notas", "Manual de convivencia laboral", "Presunto acoso: interponer queja", "Anexo SG-SST", "Guía de auditoría", "")
_MORE = ("", " formato de capacitación", " prevención de alcohol", " miembros de la ARL")
_ROUTES = ("programa/a", "drogas/b", "x/c", "matriz/mejora")


def _sql_rules(rules):
    return ", ".join(f"({i}, '{v}', '{C.folded(t)}')" for i, (v, terms) in enumerate(rules) for t in terms)


def _sql_list(values):
    return "['" + "', '".join(values) + "']"


_FOLDED = "trim(regexp_replace(translate(replace(lower(translate(%s, 'áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ', 'aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC')), 'ß', 'ss'), '_-', '  '), '\\s+', ' ', 'g'))"
_BEST = "(SELECT doc_id, v, source, a FROM (SELECT e.doc_id, r.v, e.source, e.a, row_number() OVER (PARTITION BY e.doc_id ORDER BY e.a DESC, r.i) AS k FROM e JOIN (VALUES %s) AS r(i, v, t) ON contains(e.t, r.t) WHERE %s) WHERE k = 1)"


@query(f"""
WITH raw AS (
  SELECT doc_id, 'title_control' AS source, {_sql_list(_TITLES)}[doc_id % {len(_TITLES)} + 1] AS text, 0.95::DOUBLE AS a FROM documents
  UNION ALL SELECT doc_id, 'content', coalesce(text, '') || {_sql_list(_MORE)}[doc_id // 7 % {len(_MORE)} + 1], 0.78 FROM documents
  UNION ALL SELECT doc_id, 'route', {_sql_list(_ROUTES)}[doc_id // 5 % {len(_ROUTES)} + 1], 0.45 FROM documents),
e AS (SELECT doc_id, source, a, {_FOLDED % 'text'} AS t FROM raw)
SELECT d.doc_id, coalesce(x.v, 'otro') AS document_type, x.source AS type_source, coalesce(x.a, 0.35::DOUBLE) AS type_confidence, coalesce(y.v, 'SST') AS topic, y.source AS topic_source, coalesce(y.a, 0.35::DOUBLE) AS topic_confidence,
  z.v AS subtopic, p.v AS route_prior, q.v AS content_prediction, CASE WHEN x.source = 'route' OR y.source = 'route' THEN 'route_only_low_confidence' ELSE '' END AS warnings
FROM documents d LEFT JOIN {_BEST % (_sql_rules(C.TYPE_RULES), 'TRUE')} x ON x.doc_id = d.doc_id LEFT JOIN {_BEST % (_sql_rules(C.TOPIC_RULES), 'TRUE')} y ON y.doc_id = d.doc_id
LEFT JOIN {_BEST % (_sql_rules(C.SUBTOPIC_RULES), "e.source = 'title_control'")} z ON z.doc_id = d.doc_id
LEFT JOIN {_BEST % (_sql_rules(C.TYPE_RULES), "e.source = 'route'")} p ON p.doc_id = d.doc_id LEFT JOIN {_BEST % (_sql_rules(C.TYPE_RULES), "e.source = 'content'")} q ON q.doc_id = d.doc_id
""")
def document_classes(spark, sf_dir):
    d = F.col("doc_id")
    pick = lambda values, i: F.get(F.array(*[F.lit(x) for x in values]), (i % len(values)).cast("int"))
    docs = texts(spark, sf_dir)
    source = lambda name, text: F.struct(F.lit(name).alias("source"), text.alias("text"))
    content = F.concat(F.coalesce("text", F.lit("")), pick(_MORE, F.floor(d / 7)))
    evidence = docs.select("doc_id", F.inline(F.array(source("title_control", pick(_TITLES, d)), source("content", content), source("route", pick(_ROUTES, F.floor(d / 5))))))
    return C.classify(evidence, key="doc_id")


_LINE = """SELECT l_orderkey AS document_id, l_linenumber AS n, CASE WHEN l_linenumber <= 4 THEN 1 ELSE 2 END AS page, l_suppkey % 3 AS s, l_partkey % 4 = 0 AS odd, l_partkey % 3 = 0 AS lab FROM lineitem"""


@query(f"""
WITH l AS ({_LINE}),
c AS (SELECT document_id, 'code' AS field, CASE n WHEN 1 THEN 1 ELSE 2 END AS r, CASE n WHEN 1 THEN 'GH-PS-0' || s ELSE 'GT.XX-1' || s END AS v FROM l WHERE (n = 1 AND lab) OR n = 2
  UNION ALL SELECT document_id, 'version', 0, '0' || s || '.1' FROM l WHERE n = 3 UNION ALL SELECT document_id, 'version', 0, '0.' || s FROM l WHERE n = 3 AND odd UNION ALL SELECT document_id, 'version', 1, '9.9' FROM l WHERE n = 5
  UNION ALL SELECT document_id, 'publication_date', 0, '2024-03-1' || s FROM l WHERE n = 4 AND lab UNION ALL SELECT document_id, 'publication_date', 1, '2023-04-05' FROM l WHERE n = 6
  UNION ALL SELECT document_id, 'publication_date', 2, '2022-05' FROM l WHERE n = 4 AND NOT lab UNION ALL SELECT document_id, 'effective_date', 0, '2025-01-01' FROM l WHERE n = 7),
b AS (SELECT document_id, field, r, list_sort(list_distinct(list(v))) AS vs FROM c WHERE (document_id, field, r) IN (SELECT (document_id, field, min(r)) FROM c GROUP BY document_id, field) GROUP BY document_id, field, r),
s AS (SELECT DISTINCT document_id FROM l WHERE n = 1 AND NOT lab),
w AS (SELECT b.document_id, field, CASE WHEN field = 'code' AND r = 2 AND len(vs) = 1 AND s.document_id IS NOT NULL THEN [vs[1] || ' SST'] ELSE vs END AS vs FROM b LEFT JOIN s ON s.document_id = b.document_id),
f AS (SELECT DISTINCT document_id, u.field FROM l CROSS JOIN (VALUES ('title'), ('code'), ('version'), ('publication_date'), ('effective_date')) AS u(field)),
t AS (SELECT document_id, 'Manual D''' || 'Obra ' || min(n) AS v FROM l WHERE n > 4 AND odd GROUP BY document_id)
SELECT f.document_id, f.field, CASE WHEN t.v IS NOT NULL THEN 'extracted' WHEN w.vs IS NULL THEN 'not_found' WHEN len(w.vs) = 1 THEN 'extracted' ELSE 'conflicting' END AS status, coalesce(replace(t.v, '''', ' '), array_to_string(w.vs, '|'), '') AS "values"
FROM f LEFT JOIN w ON w.document_id = f.document_id AND w.field = f.field LEFT JOIN t ON t.document_id = f.document_id AND f.field = 'title'
""")
def control_fields(spark, sf_dir):
    """Lines of every kind, made from line items: SQL knows the values that they were made from."""
    n, s = F.col("l_linenumber"), (F.col("l_suppkey") % 3).cast("string")
    odd, some = F.col("l_partkey") % 4 == 0, F.col("l_partkey") % 3 == 0
    lit = F.lit
    line = (
        F.when((n == 1) & some, F.concat(lit("Código: gh - ps - 0"), s))
        .when(n == 1, lit(" sst "))
        .when(n == 2, F.concat(lit("ref "), lit("gt.xx - 1"), s))
        .when((n == 3) & odd, F.concat(lit("Versión: 0"), s, lit(",1 | ver o"), s))
        .when(n == 3, F.concat(lit("versión 0"), s, lit(".1")))
        .when((n == 4) & some, F.concat(lit("Fecha de publicación: 1"), s, lit("/03/2024")))
        .when(n == 4, lit("hecho en Mayo, 2022 aquí"))
        .when(odd, F.concat(lit("# Manual D'Obra "), n.cast("string")))
        .otherwise(lit(""))
    )
    tail = F.when(n == 5, lit("versión 9.9")).when(n == 6, lit("firmado el 5-4-23")).when(n == 7, lit("entrada en vigencia: 1 de enero de 2025")).otherwise(lit(""))
    page = F.when(n <= 4, 1).otherwise(2)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), page.alias("page"), F.posexplode(F.array(line, tail)).alias("half", "line"), n.alias("n"))
    return D.fields(rows.select("document_id", "page", (F.col("n") * 2 + F.col("half")).alias("line_no"), "line"))


_HEADS = "SELECT o_custkey AS document_id, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'SG-SST  GENERAL' WHEN o_orderkey % 4 = 1 THEN 'Notas ' || o_orderkey % 3 WHEN o_orderkey % 4 = 2 THEN 'Un encabezado bastante largo' ELSE 'Única ' || o_orderkey END AS text, o_orderkey % 30 AS away FROM orders"


@query(f"""
WITH h AS (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS f FROM ({_HEADS})), c AS (SELECT *, count(*) OVER (PARTITION BY document_id, f) AS n_same FROM h)
SELECT document_id, o_orderkey, n_same, n_same > 1 AND away <= 20 AND (len(f) <= 16 OR o_orderkey % 4 = 0) AS running FROM c
""")
def running_headings(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, "SG-SST  GENERAL").when(k % 4 == 1, F.concat(F.lit("Notas "), (k % 3).cast("string"))).when(k % 4 == 2, "Un encabezado bastante largo").otherwise(F.concat(F.lit("Única "), k.cast("string")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), "o_orderkey", text.alias("text"), (100 + k % 30).alias("char_start"), F.lit(100).alias("page_char_start"))
    return D.running_headings(rows).select("document_id", "o_orderkey", "n_same", "running")


@query("""
SELECT o_orderkey, o_orderkey % 25 <= 20 AND o_custkey % 3 <> 0 AND (CASE o_custkey % 3 WHEN 1 THEN TRUE ELSE o_custkey % 2 = 0 END) AS running FROM orders
""")
def running_tables(spark, sf_dir):
    """Tables with two cues, one or none."""
    c = F.col("o_custkey")
    text = F.when(c % 3 == 1, "<td>Código</td><td>**Página**</td>").when((c % 3 == 2) & (c % 2 == 0), "| Versión | fecha |").when(c % 3 == 2, "| fecha | página |").otherwise("| versión |")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), (F.col("o_orderkey") % 25).alias("char_start"), F.lit(0).alias("page_char_start"))
    return D.running_tables(rows, ("codigo", "version", "pagina", "fecha")).select("o_orderkey", "running")


_PARTS = ("OBJETIVOS Y METAS", "POLÍTICA DE", "SEGURIDAD VIAL", "texto corriente", "COPIA CONTROLADA", "MANUAL ANTE EL COMITÉ")


@query(f"""
WITH l AS (SELECT l_orderkey AS d, l_linenumber AS n, l_partkey % {len(_PARTS)} AS k, {_sql_list(_PARTS)}[l_partkey % {len(_PARTS)} + 1] AS t, CASE WHEN l_linenumber <= 4 THEN 1 ELSE 2 END AS page FROM lineitem),
x AS (SELECT *, lead(k) OVER w AS nk, lead(t) OVER w AS nt, lead(page) OVER w AS np FROM l WINDOW w AS (PARTITION BY d ORDER BY n, t)),
b AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY CASE WHEN k IN (0, 1, 5) THEN 0 ELSE 1 END, n, t) AS r FROM x WHERE page = 1 AND k <> 3)
SELECT d AS document_id, CASE WHEN k IN (0, 1, 5) AND np = 1 AND nk IN (2, 4) THEN t || CASE WHEN k = 0 AND nk = 2 THEN ' DE ' ELSE ' ' END || nt ELSE t END AS title, k IN (0, 1, 5) AND coalesce(np = 1 AND nk IN (2, 4), FALSE) AS goes_on FROM b WHERE r = 1
""")
def title_continuation(spark, sf_dir):
    """Titles of two lines, made from line items."""
    k = (F.col("l_partkey") % len(_PARTS)).cast("int")
    line = F.get(F.array(*[F.lit(x) for x in _PARTS]), k)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_linenumber") <= 4, 1).otherwise(2).alias("page"), F.col("l_linenumber").alias("line_no"), line.alias("line"))
    return D.titles(rows).select("document_id", F.col("value").alias("title"), (~F.col("value").isin(*_PARTS)).alias("goes_on"))
