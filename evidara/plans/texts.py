"""Text and structure queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import ids
from evidara.functions import text as T
from evidara.operators import classify as C
from evidara.operators import structure as S
from evidara.plans.registry import query, table, texts

_FROM, _TO = T.ACCENTED, T.PLAIN
_FOLD = f"replace(lower(translate(%s, '{_FROM}', '{_TO}')), 'ß', 'ss')"


@query(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'),
  '\r\n?', chr(10), 'g'), '([A-Za-zÀ-ÖØ-öø-ÿ])-\n([A-Za-zÀ-ÖØ-öø-ÿ])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')) AS text_md5
FROM (SELECT doc_id, replace(replace(text, ', ', '-' || chr(10)), ' a', chr(13) || chr(10) || chr(9) || ' a') AS raw FROM documents)
""")
def normalize_text(spark, sf_dir):
    raw = F.replace(F.replace(F.col("text"), F.lit(", "), F.lit("-\n")), F.lit(" a"), F.lit("\r\n\t a"))
    return texts(spark, sf_dir).select("doc_id", F.md5(T.normalize_text(raw)).alias("text_md5"))


@query(f"SELECT doc_id, sha256({_FOLD % 'text'}) AS fold_hash FROM documents")
def accent_fold_hash(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("fold_hash"))


@query(r"""
SELECT doc_id, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, '|')) AS digest FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n\s*\n', chr(1), 'g'), chr(1)), lambda x: trim(x, chr(10) || chr(9) || chr(13) || ' ')), lambda x: x <> '') AS s FROM documents)
""")
def sentence_units(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return texts(spark, sf_dir).select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


@query(rf"""
WITH lines AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents),
keyed AS (SELECT source, doc_id, trim(regexp_replace(translate({_FOLD % 'raw'}, '_-', '  '), '\s+', ' ', 'g')) AS line FROM lines)
SELECT source, line, count(DISTINCT doc_id) AS pages FROM keyed WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT doc_id) >= 3
""")
def repeated_line_boilerplate(spark, sf_dir):
    return S.repeated_lines(texts(spark, sf_dir), 3, document="source", page="doc_id")


@query("""
SELECT source, lang, round(median(n_chars), 6) AS middle, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high,
  count(*) >= 2 AND max(n_chars) - median(n_chars) <= 900 AND median(n_chars) - min(n_chars) <= 900 AS agrees FROM documents GROUP BY source, lang
""")
def median_position_agreement(spark, sf_dir):
    return S.agreeing(table(spark, sf_dir, "documents"), ["source", "lang"], "n_chars", tolerance=900.0).withColumn("middle", F.round("middle", 6))


@query("""
WITH a AS (SELECT doc_id, text, left(text, 12) AS s1, right(text, 7) AS s2 FROM documents),
b AS (SELECT doc_id, s2, CASE WHEN s1 <> '' THEN left(text, instr(text, s1) - 1) || substr(text, instr(text, s1) + len(s1)) ELSE text END AS t FROM a)
SELECT doc_id, md5(CASE WHEN s2 <> '' AND instr(t, s2) > 0 THEN left(t, instr(t, s2) - 1) || substr(t, instr(t, s2) + len(s2)) ELSE t END) AS digest FROM b
""")
def indexable_text(spark, sf_dir):
    spans = F.array(F.left(F.col("text"), F.lit(12)), F.right(F.col("text"), F.lit(7)))
    return texts(spark, sf_dir).select("doc_id", F.md5(T.remove_spans(F.col("text"), spans)).alias("digest"))


@query("""
WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: len(x)) AS c FROM documents),
step AS (
  SELECT doc_id, c, 1 AS i, c[1] AS held, 0 AS g, '0' AS out FROM l
  UNION ALL
  SELECT doc_id, c, i + 1, CASE WHEN held + c[i + 1] > 600 THEN c[i + 1] ELSE held + c[i + 1] END, CASE WHEN held + c[i + 1] > 600 THEN g + 1 ELSE g END,
    out || ',' || CASE WHEN held + c[i + 1] > 600 THEN g + 1 ELSE g END FROM step WHERE i < len(c)
)
SELECT doc_id, out AS groups FROM step WHERE i = len(c)
""")
def greedy_token_packing(spark, sf_dir):
    groups = S.pack(F.split("text", "\n"), lambda x: F.length(x), 600)
    return texts(spark, sf_dir).select("doc_id", F.array_join(groups.cast("array<string>"), ",").alias("groups"))


def chunk_sql(rows: str, key: str, least: int, goal: int, most: int, low: int, high: int, overlap: int) -> str:
    """CTEs up to c(key, ordinal, n_sentences, n_overlap, token_count, text): sentence children of rows(key, text) by walking from start to start."""
    return rf"""
s AS (
  SELECT {key}, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n\s*\n', chr(1), 'g'), chr(1)), lambda x: trim(x, chr(10) || chr(9) || chr(13) || ' ')), lambda x: x <> '') AS s FROM ({rows})),
n AS (SELECT {key}, s, list_transform(s, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> ''))) AS n FROM s WHERE len(s) > 0),
p AS (SELECT {key}, s, len(s) AS m, list_transform(range(0, len(s) + 1), lambda i: CAST(coalesce(list_sum(n[1:i]), 0) AS BIGINT)) AS p FROM n),
walk AS (
  SELECT {key}, CAST(0 AS BIGINT) AS a FROM p
  UNION ALL SELECT {key}, c FROM (SELECT w.{key}, list_min(list_filter(range(w.a + 1, p.m), lambda i: p.p[i + 1] - p.p[w.a + 1] >= {least} AND (p.p[i + 1] - p.p[w.a + 1] >= {goal} OR p.p[i + 2] - p.p[w.a + 1] > {most}))) AS c FROM walk w JOIN p ON p.{key} = w.{key}) WHERE c IS NOT NULL),
r AS (SELECT w.{key}, a, lag(a) OVER o AS pa, lead(a) OVER o AS na, s, m, p FROM walk w JOIN p ON p.{key} = w.{key} WINDOW o AS (PARTITION BY w.{key} ORDER BY a)),
k AS (SELECT * FROM r WHERE NOT (na IS NULL AND pa IS NOT NULL AND p[m + 1] - p[a + 1] < {least} AND p[m + 1] - p[pa + 1] <= {most})),
f AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY a) - 1 AS ordinal, coalesce(lead(a) OVER (PARTITION BY {key} ORDER BY a), m) AS b,
  CASE WHEN pa IS NULL THEN a ELSE coalesce(-list_sort(list_transform(list_filter(range(pa, a), lambda j: p[a + 1] - p[j + 1] BETWEEN {low} AND {high}), lambda j: [abs(p[a + 1] - p[j + 1] - {overlap}), -j]))[1][2], a) END AS first FROM k),
c AS (SELECT {key}, CAST(ordinal AS INTEGER) AS ordinal, CAST(b - a AS INTEGER) AS n_sentences, CAST(a - first AS INTEGER) AS n_overlap, CAST(p[b + 1] - p[first + 1] AS INTEGER) AS token_count, array_to_string(s[first + 1:b], ' ') AS text FROM f)
"""


@query("WITH RECURSIVE " + chunk_sql("SELECT doc_id, text FROM documents", "doc_id", 44, 79, 104, 8, 16, 11) + "SELECT doc_id, ordinal, n_sentences, n_overlap, token_count, md5(text) AS text_md5 FROM c")
def sentence_chunking_overlap(spark, sf_dir):
    found = S.sentence_chunks(texts(spark, sf_dir).select("doc_id", "text"), S.Profile(60, 90, 120, 0.12, 8, 16))
    return found.select("doc_id", "ordinal", "n_sentences", "n_overlap", "token_count", F.md5("text").alias("text_md5"))


_MARKS = "SELECT doc_id, u.i AS page, u.i * 100 AS start, n_chars FROM documents, unnest(range(0, n_chars // 100 + 1)) AS u(i) WHERE n_chars > 0"


@query(f"SELECT doc_id, page, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n_chars) AS \"end\" FROM ({_MARKS})")
def page_marker_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("n_chars > 0")
    marks = docs.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n_chars") / 100))).alias("page")).withColumn("start", F.col("page") * 100)
    return S.page_spans(marks, document="doc_id", length="n_chars").select("doc_id", "page", "start", "end")


@query(f"""
WITH t AS (SELECT doc_id, page, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n_chars) AS e FROM ({_MARKS})),
r AS (SELECT doc_id, 0 AS region_id, n_chars // 3 AS s, n_chars // 2 AS e FROM documents WHERE n_chars > 0)
SELECT r.doc_id, r.region_id, min(page) AS page_start, max(page) AS page_end FROM r LEFT JOIN t ON t.doc_id = r.doc_id AND t.e > r.s AND t.start < r.e GROUP BY r.doc_id, r.region_id
""")
def interval_overlap_join(spark, sf_dir):
    spans = page_marker_spans(spark, sf_dir)
    regions = table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", F.lit(0).alias("region_id"), F.floor(F.col("n_chars") / 3).alias("start"), F.floor(F.col("n_chars") / 2).alias("end"))
    return S.overlap(regions, spans, "doc_id")


@query("""
WITH w AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN 0 ELSE 1 END AS c FROM conversations),
i AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS island FROM w)
SELECT conv_id, CAST(island AS BIGINT) AS island, role, min(turn) AS "first", max(turn) AS "last", count(*) AS n FROM i GROUP BY conv_id, island, role
""")
def role_islands(spark, sf_dir):
    return S.islands(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role")


_BLOCKS = r"""SELECT page_id AS document_id, CAST(i - 1 AS INTEGER) AS ordinal, b[i] AS block FROM (SELECT page_id, b, unnest(range(1, len(b) + 1)) AS i FROM (
  SELECT page_id, regexp_extract_all(html, '<(?:h1|p|li)[^>]*>[^<]*') AS b FROM pages))"""


def _blocks(spark, sf_dir):
    """Headings (h1), paragraphs and list items of the pages, in order."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), F.posexplode(F.regexp_extract_all("html", F.lit(r"<(?:h1|p|li)[^>]*>[^<]*"), F.lit(0))).alias("ordinal", "block"))
    level = F.when(F.col("block").startswith("<h1"), 1).when(F.col("block").startswith("<li"), 2)
    return rows.select("document_id", "ordinal", level.alias("level"), F.regexp_extract("block", "(?s)>(.*)", 1).alias("text"))


@query(f"""
SELECT document_id, ordinal, CAST(sum(CASE WHEN starts_with(block, '<h1') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY ordinal) AS BIGINT) AS section FROM ({_BLOCKS})
""")
def section_split(spark, sf_dir):
    return S.sections(_blocks(spark, sf_dir).withColumn("is_heading", F.coalesce(F.col("level") == 1, F.lit(False)))).select("document_id", "ordinal", "section")


@query(f"""
WITH b AS (SELECT document_id, ordinal, CASE WHEN starts_with(block, '<h1') THEN 1 WHEN starts_with(block, '<li') THEN 2 END AS level, regexp_extract(block, '(?s)>(.*)', 1) AS text FROM ({_BLOCKS})),
w AS (SELECT *, max(CASE WHEN level = 1 THEN ordinal END) OVER p AS a1, max(CASE WHEN level = 2 THEN ordinal END) OVER p AS a2 FROM b WINDOW p AS (PARTITION BY document_id ORDER BY ordinal))
SELECT w.document_id, w.ordinal, md5(concat_ws(' > ', h1.text, CASE WHEN a1 IS NULL OR a2 > a1 THEN h2.text END)) AS path_md5 FROM w
LEFT JOIN b h1 ON h1.document_id = w.document_id AND h1.ordinal = a1 LEFT JOIN b h2 ON h2.document_id = w.document_id AND h2.ordinal = a2
""")
def heading_paths(spark, sf_dir):
    return S.heading_path(_blocks(spark, sf_dir), 2).select("document_id", "ordinal", F.md5("heading_path").alias("path_md5"))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, 'href=.([^\"'' >]+)', 1)) AS INTEGER) AS links, regexp_extract(html, '<h1[^>]*>([^<]*)', 1) AS h1 FROM pages")
def html_links_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("href=.([^\"' >]+)"), F.lit(1))).alias("links"), F.regexp_extract("html", "<h1[^>]*>([^<]*)", 1).alias("h1")
    )


#: Rules that the invented words of the test documents meet.
_RULES = (("alpha", ("thing", "heing")), ("beta", ("tion",)), ("gamma", ("ción", "mente")), ("delta", ("src1", "src2")))
_RULES_SQL = ", ".join(f"({i}, '{v}', '{t.replace('ó', 'o')}')" for i, (v, ts) in enumerate(_RULES) for t in ts)


@query(rf"""
WITH e AS (SELECT doc_id, 'content' AS source, text, 0.78 AS a FROM documents UNION ALL SELECT doc_id, 'route', source, 0.45 FROM documents),
f AS (SELECT doc_id, source, a, trim(regexp_replace(translate({_FOLD % 'text'}, '_-', '  '), '\s+', ' ', 'g')) AS t FROM e),
h AS (SELECT f.*, r.* FROM f JOIN (VALUES {_RULES_SQL}) AS r(idx, value, term) ON contains(f.t, r.term)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC, idx) AS k, 1 AS one FROM h), n AS (SELECT doc_id, count(DISTINCT value) AS n_values FROM h GROUP BY doc_id)
SELECT d.doc_id, b.value, b.source, CAST(coalesce(b.a, 0.35) AS DOUBLE) AS authority, coalesce(n.n_values, 0) AS n_values FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND b.k = 1 LEFT JOIN n ON n.doc_id = d.doc_id
""")
def rule_classification(spark, sf_dir):
    docs = texts(spark, sf_dir)
    evidence = docs.select("doc_id", F.lit("content").alias("source"), "text").unionByName(docs.select("doc_id", F.lit("route").alias("source"), F.col("source").alias("text")))
    return C.choose(evidence, _RULES, key="doc_id")


@query(r"""
WITH c AS (SELECT doc_id, 'mail' AS field, unnest(list_distinct(regexp_extract_all(text, '[0-9]+@mail[0-9]+'))) AS value FROM documents
  UNION ALL SELECT doc_id, 'ip', unnest(list_distinct(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'))) FROM documents),
g AS (SELECT doc_id, field, count(DISTINCT value) AS n, string_agg(DISTINCT value, '|' ORDER BY value) AS v FROM c GROUP BY doc_id, field)
SELECT d.doc_id, f.field, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'extracted' ELSE 'conflicting' END AS status, coalesce(v, '') AS "values"
FROM documents d CROSS JOIN (VALUES ('mail'), ('ip')) AS f(field) LEFT JOIN g ON g.doc_id = d.doc_id AND g.field = f.field
""")
def control_fields_conflict(spark, sf_dir):
    docs = texts(spark, sf_dir)
    find = lambda name, p: docs.select("doc_id", F.lit(name).alias("field"), F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("value"))
    found = find("mail", "[0-9]+@mail[0-9]+").unionByName(find("ip", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"))
    keys = docs.select("doc_id", F.explode(F.array(F.lit("mail"), F.lit("ip"))).alias("field"))
    return C.merge_fields(found, keys, key="doc_id")


_MONTHS = ("enero", "Febrero", "marzo", "ABRIL", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


@query(f"""
SELECT o_orderkey, raw, CASE o_orderkey % 6 WHEN 3 THEN strftime(o_orderdate, '%Y-%m') WHEN 5 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 6 WHEN 0 THEN d || '/' || m || '/' || y WHEN 1 THEN y || '-' || m || '-' || d
  WHEN 2 THEN d || ' de ' || name || ' de ' || y WHEN 3 THEN name || ', ' || y WHEN 4 THEN d || ' días del mes de ' || name || ' de ' || y ELSE 'mañana ' || d END AS raw
  FROM (SELECT o_orderkey, o_orderdate, day(o_orderdate) AS d, month(o_orderdate) AS m, year(o_orderdate) AS y, {list(_MONTHS)}[month(o_orderdate)] AS name FROM orders))
""")
def spanish_dates(spark, sf_dir):
    """Order dates in every way of writing that is known, and one that is not."""
    text = lambda c: c(F.col("o_orderdate")).cast("string")
    d, m, y = text(F.dayofmonth), text(F.month), text(F.year)
    name = F.element_at(F.array(*[F.lit(x) for x in _MONTHS]), F.month("o_orderdate"))
    k = F.col("o_orderkey") % 6
    join = lambda sep, *parts: F.concat_ws(sep, *parts)
    raw = F.when(k == 0, join("/", d, m, y)).when(k == 1, join("-", y, m, d)).when(k == 2, join(" de ", d, name, y)).when(k == 3, join(", ", name, y)).when(k == 4, F.concat(d, F.lit(" días del mes de "), name, F.lit(" de "), y)).otherwise(join(" ", F.lit("mañana"), d))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", "raw", T.spanish_date(F.col("raw")).alias("iso"))


@query("""
SELECT doc_id, 'doc_' || left(sha1(source || '/' || doc_id), 16) AS document_id, 'srev_' || left(sha256(source || chr(31) || doc_id || chr(31) || sha256(text)), 32) AS revision_id FROM documents
""")
def inventory_ids(spark, sf_dir):
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", ids.document_id(path).alias("document_id"), ids.fenced("srev_", "source", "doc_id", F.sha2("text", 256)).alias("revision_id"))


@query(r"""
SELECT doc_id, CASE WHEN len(t) > 256 THEN left(t, 256) || '...' ELSE t END AS text FROM (
  SELECT doc_id, regexp_replace(text, '(token|password|secret|api_key)(\s*=\s*)(?:"[^"]*"?|[^\s"]+)', '\1\2[redacted]', 'g') AS t FROM documents)
""")
def redact_truncate(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.redact(F.col("text")).alias("text"))


@query("""
WITH v AS (SELECT doc_id, coalesce(source, '') || CASE WHEN doc_id % 5 = 0 THEN ' https://h/x?sig=1' ELSE '' END || coalesce(text, '') AS v, CASE doc_id % 4 WHEN 0 THEN 'raw_text' WHEN 1 THEN 'Token' ELSE 'note' END AS k FROM documents)
SELECT doc_id, CASE WHEN v <> '' AND (doc_id % 4 < 2 OR doc_id % 5 = 0) THEN '***redacted***' WHEN len(v) <= 256 THEN v ELSE left(v, 253) || '...' END AS shown, CASE WHEN doc_id % 12 > 8 THEN list_concat(list_transform(range(8), lambda i: 'i' || i), ['...(+' || doc_id % 12 - 8 || ' more)']) ELSE list_transform(range(doc_id % 12), lambda i: 'i' || i) END[-1] AS last FROM v
""")
def sanitized_values(spark, sf_dir):
    d = F.col("doc_id")
    value = F.concat(F.coalesce("source", F.lit("")), F.when(d % 5 == 0, " https://h/x?sig=1").otherwise(""), F.coalesce("text", F.lit("")))
    key = F.when(d % 4 == 0, "raw_text").when(d % 4 == 1, "Token").otherwise("note")
    items = F.transform(F.slice(F.sequence(F.lit(0), F.lit(11)), 1, (d % 12).cast("int")), lambda i: F.concat(F.lit("i"), i.cast("string")))
    return texts(spark, sf_dir).select("doc_id", T.sanitize(value, key).alias("shown"), F.try_element_at(T.preview(items, "note"), F.lit(-1)).alias("last"))


@query("""
SELECT event_id, '{"name":"' || event_type || '","token":"***redacted***","nested":{"api_key":"***redacted***","link":"***redacted***"},"n":' || event_id || '}' AS payload FROM events
""")
def redacted_payloads(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.to_json(F.struct(F.col("event_type").alias("name"), F.concat(F.lit('a"b'), "event_type").alias("token"), F.struct(F.col("event_id").alias("api_key"), F.lit("https://h/x").alias("link")).alias("nested"), F.col("event_id").alias("n")))
    return e.select("event_id", T.redact_json(raw).alias("payload"))


@query("""
SELECT c_custkey, c_custkey % 4 IN (0, 1) AS label, c_custkey % 3 = 0 AS signal FROM customer
""")
def form_signals(spark, sf_dir):
    k = F.col("c_custkey")
    line = F.when(k % 4 == 0, F.concat(F.lit("Nombre del "), "c_name", F.lit(":"))).when(k % 4 == 1, " Área:").when(k % 4 == 2, F.concat("c_name", F.lit(":"))).otherwise("Firma")
    line = F.when(k % 4 == 1, F.lit(" FECHA: ")).otherwise(line)
    page = F.when(k % 3 == 0, F.concat("c_name", F.lit(" Diligencie\n los DATOS"))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.is_label(line).alias("label"), T.has_form_signal(page).alias("signal"))
