"""Full-text search over an inverted index, on Spanish texts made from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.operators import fulltext, lineage
from evidara.plans.registry import query, table

#: Words that the texts are made of, and their stems (none: a stop word).
WORDS = {
    "trabajadores": "trabaj", "trabajador": "trabaj", "trabajando": "trabaj", "prevención": "prevencion", "prevenciones": "prevencion", "seguridad": "segur", "seguro": "segur", "riesgos": "riesg", "riesgo": "riesg",
    "capacitación": "capacit", "accidentes": "accident", "la": None, "de": None, "para": None, "laborales": "laboral", "vigilancia": "vigil", "rápidamente": "rapid", "comité": "comit", "los": None,
}
_LIST = "['" + "', '".join(WORDS) + "']"
_KNOWN = ", ".join(f"('{w}', '{s}')" for w, s in WORDS.items() if s)
_ASKED = "Los riesgos de un TRABAJADOR, para la seguridad"
_TOKENS = f"SELECT o_orderkey AS node_id, {_LIST}[(o_orderkey * (k + 3) + o_custkey * k * k) % {len(WORDS)} + 1] AS w FROM orders, unnest(range(0, 12)) AS u(k)"


def _texts(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in WORDS])
    pick = lambda k: F.get(words, ((F.col("o_orderkey") * (k + 3) + F.col("o_custkey") * k * k) % len(WORDS)).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), pick), ", ").alias("text"))


@query(f"""
WITH t AS ({_TOKENS}), n AS (SELECT node_id, count(*) AS n FROM t GROUP BY node_id), s AS (SELECT node_id, v.s FROM t JOIN (VALUES {_KNOWN}) AS v(w, s) ON v.w = t.w WHERE v.s IN ('riesg', 'trabaj', 'segur')),
f AS (SELECT node_id, count(*) AS total FROM s GROUP BY node_id HAVING count(DISTINCT s) = 3)
SELECT f.node_id, round(total / (1 + ln(CAST(n AS DOUBLE))), 6) AS score FROM f JOIN n ON n.node_id = f.node_id ORDER BY score DESC, f.node_id LIMIT 50
""")
def spanish_search(spark, sf_dir):
    path = lineage.new_path(spark, "index")
    fulltext.build(_texts(spark, sf_dir), path)
    return fulltext.search(spark, path, _ASKED, 50)


@query(f"WITH t AS ({_TOKENS}) SELECT node_id, v.s AS stem, count(*) AS tf FROM t JOIN (VALUES {_KNOWN}) AS v(w, s) ON v.w = t.w GROUP BY node_id, v.s")
def spanish_terms(spark, sf_dir):
    return fulltext.terms(_texts(spark, sf_dir)).select("node_id", "stem", "tf")
