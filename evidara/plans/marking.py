"""Markdown queries. The tables hold no markdown, so it is made from the pages: h1 as #, li as -, other tags left out."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.operators import markdown as M
from evidara.operators import structure as S
from evidara.plans.registry import query, table, texts
from evidara.plans.texts import chunk_sql

_STEPS = (("<h1[^>]*>", "\n\n# "), ("<li[^>]*>", "\n- "), ("<p[^>]*>", "\n\n"), ("<tr[^>]*>", "\n| "), ("</td>|</th>", " | "), ("<[^>]*>", ""))


def _markdown(spark, sf_dir):
    html = F.col("html")
    for pattern, new in _STEPS:
        html = F.regexp_replace(html, pattern, new)
    return texts(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), html.alias("markdown"))


def _sql_markdown() -> str:
    html = "html"
    for pattern, new in _STEPS:
        html = f"regexp_replace({html}, '{pattern}', '{new}', 'g')".replace("\n", "' || chr(10) || '")
    return f"SELECT page_id AS document_id, {html} AS markdown FROM pages"


_REGIONS = f"""
WITH md AS ({_sql_markdown()}),
r AS (SELECT document_id, unnest(range(0, len(l))) AS n, unnest(l) AS raw FROM (SELECT document_id, string_split(markdown, chr(10)) AS l FROM md WHERE len(markdown) > 0)),
l AS (SELECT document_id, n, regexp_replace(raw, '^[ \\t\\r\\f]+|[ \\t\\r\\f]+$', '', 'g') AS line, sum(len(raw) + 1) OVER (PARTITION BY document_id ORDER BY n) - len(raw) - 1 AS s, len(regexp_replace(raw, '\\r$', '')) AS k FROM r),
c AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '{M.HEADING}') THEN 'heading' WHEN regexp_matches(line, '{M.LIST}') THEN 'list' WHEN regexp_matches(line, '{M.ARTICLE}') THEN 'article' WHEN starts_with(line, '|') THEN 'table' ELSE 'paragraph' END AS kind FROM l),
a AS (SELECT *, CASE WHEN kind <> 'blank' AND (kind IN ('heading', 'article') OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY document_id ORDER BY n)) THEN 1 ELSE 0 END AS again FROM c),
o AS (SELECT *, sum(again) OVER (PARTITION BY document_id ORDER BY n) - 1 AS ordinal FROM a),
b AS (SELECT document_id, ordinal, CASE min(kind) WHEN 'article' THEN 'heading' ELSE min(kind) END AS kind, string_agg(CASE WHEN kind = 'heading' THEN regexp_replace(line, '^#+[ \\t]+', '') ELSE line END, chr(10) ORDER BY n) AS text, min(s) AS char_start, max(s + k) AS char_end FROM o WHERE kind <> 'blank' GROUP BY document_id, ordinal)
"""


@query(_REGIONS + "SELECT document_id, ordinal, kind, md5(text) AS text_md5, char_start, char_end FROM b")
def markdown_regions(spark, sf_dir):
    return M.regions(_markdown(spark, sf_dir)).select("document_id", "ordinal", "kind", F.md5("text").alias("text_md5"), "char_start", "char_end")


def _parents(limit: int) -> str:
    return _REGIONS + r""",
t AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS k, CASE WHEN kind = 'heading' AND lag(kind) OVER (PARTITION BY document_id ORDER BY ordinal) IS DISTINCT FROM 'heading' THEN 1 ELSE 0 END AS opens FROM b),
s AS (SELECT *, sum(opens) OVER (PARTITION BY document_id ORDER BY ordinal) AS section FROM t),
g AS (SELECT document_id, section, list(k ORDER BY ordinal) AS ks, bool_or(kind = 'table') AS tab FROM s GROUP BY document_id, section),
f AS (SELECT document_id, section, list_reduce(list_transform(ks, lambda x: {'g': 0, 'n': x, 'out': [0]}), lambda a, x: {'g': CASE WHEN NOT tab AND a.n + x.n > LIMIT THEN a.g + 1 ELSE a.g END, 'n': CASE WHEN NOT tab AND a.n + x.n > LIMIT THEN x.n ELSE a.n + x.n END, 'out': list_append(a.out, CASE WHEN NOT tab AND a.n + x.n > LIMIT THEN a.g + 1 ELSE a.g END)}).out AS gs FROM g),
u AS (SELECT s.*, f.gs[CAST(row_number() OVER (PARTITION BY s.document_id, s.section ORDER BY ordinal) AS BIGINT)] AS grp FROM s JOIN f ON f.document_id = s.document_id AND f.section = s.section),
p AS (SELECT document_id, section, grp, min(ordinal) AS first, sum(k) AS token_count, count(*) AS n_blocks, string_agg(text, chr(10) || chr(10) ORDER BY ordinal) AS text, min(char_start) AS char_start, max(char_end) AS char_end FROM u GROUP BY document_id, section, grp)
""".replace("LIMIT", str(limit))


@query(_parents(60) + "SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY first) - 1 AS ordinal, token_count, n_blocks, md5(text) AS text_md5, char_start, char_end FROM p")
def parent_chunks(spark, sf_dir):
    found = M.parents(M.regions(_markdown(spark, sf_dir)), 60)
    return found.select("document_id", "ordinal", "token_count", "n_blocks", F.md5("text").alias("text_md5"), "char_start", "char_end")


#: The pages hold no tables, so every parent is atomic or cut by sentences; tables have tests of their own.
_CHILDREN = f"""
WITH RECURSIVE par AS MATERIALIZED (SELECT 'par_' || left(sha256(document_id || chr(31) || ordinal || chr(31) || text), 32) AS parent_id, text, token_count FROM ({_parents(1500)} SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY first) - 1 AS ordinal, text, token_count FROM p)),
{chunk_sql('SELECT parent_id, text FROM par WHERE token_count > 60', 'parent_id', 22, 40, 52, 4, 8, 5)}
SELECT parent_id, 0 AS ordinal, 'atomic' AS kind, '' AS context_prefix, md5(text) AS text_md5, CAST(token_count AS INTEGER) AS token_count FROM par WHERE token_count <= 60
UNION ALL SELECT parent_id, ordinal, 'text', '', md5(text), token_count FROM c
"""


@query(_CHILDREN)
def parent_child_chunks(spark, sf_dir):
    found = M.children(M.parents(M.regions(_markdown(spark, sf_dir))), S.Profile(30, 45, 60, 0.12, 4, 8))
    return found.select("parent_id", "ordinal", "kind", "context_prefix", F.md5("text").alias("text_md5"), "token_count")


_ROWS = "SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Historial de cambios' WHEN o_orderkey % 11 = 0 THEN '# fin' ELSE '| v' || o_orderkey % 9 || ' | ' || CASE WHEN o_orderkey % 7 = 0 THEN 'pendiente' ELSE '0' || o_orderkey % 9 + 1 || '/12/2024' END || ' | texto ' || o_orderkey || ' |' END AS line FROM orders"


@query(f"""
WITH r AS ({_ROWS}),
m AS (SELECT *, line = 'Historial de cambios' AS header, contains(line, '/12/2024') AS dated, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, sum(CASE WHEN line = 'Historial de cambios' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM r),
x AS (SELECT *, (SELECT min(b.i) FROM m b WHERE b.o_custkey = m.o_custkey AND b.run = m.run AND b.dated) AS f FROM m WHERE dated AND run > 0)
SELECT o_custkey, o_orderkey, 'v' || o_orderkey % 9 AS version, '0' || o_orderkey % 9 + 1 || '/12/2024' AS date, 'texto ' || o_orderkey AS description FROM x
WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.o_custkey = x.o_custkey AND b.run = x.run AND b.i < x.i AND NOT b.header AND (starts_with(b.line, '#') OR (b.i > x.f AND NOT b.dated)))
""")
def history_state_machine(spark, sf_dir):
    k = F.col("o_orderkey")
    day = F.when(k % 7 == 0, "pendiente").otherwise(F.concat(F.lit("0"), (k % 9 + 1).cast("string"), F.lit("/12/2024")))
    row = F.concat(F.lit("| v"), (k % 9).cast("string"), F.lit(" | "), day, F.lit(" | texto "), k.cast("string"), F.lit(" |"))
    line = F.when(k % 5 == 0, "Historial de cambios").when(k % 11 == 0, "# fin").otherwise(row)
    return M.history_entries(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", line.alias("line")), ["o_custkey"], "o_orderkey")


@query("""
WITH t AS (SELECT o_custkey, o_orderkey, 'fila ' || o_orderkey || ' ' || o_orderstatus AS line FROM orders),
g AS (SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS ordinal, o_orderkey, line FROM t)
SELECT o_custkey, ordinal, CASE WHEN ordinal = 0 THEN '' ELSE '| a | b |' || chr(10) || '|---|---|' END AS context_prefix, count(*) AS n_rows FROM g GROUP BY o_custkey, ordinal
""")
def table_row_groups(spark, sf_dir):
    """Rows of three tokens each, at most 18 tokens with the six of the header: four rows a group."""
    lines = F.concat_ws(" ", F.lit("fila"), F.col("o_orderkey").cast("string"), "o_orderstatus")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", lines.alias("t")))), lambda x: x["t"])
    made = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat_ws("\n", F.lit("| a | b |\n|---|---|"), rows).alias("text"))
    found = M.table_groups(made, 18, key="o_custkey")
    n = F.size(F.split("text", "\n")) - F.when(F.col("ordinal") == 0, 2).otherwise(0)
    return found.select("o_custkey", "ordinal", "context_prefix", n.cast("bigint").alias("n_rows"))
