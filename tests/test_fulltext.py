"""Stems by the published rules, and the index against a scan."""

import random

from evidara.functions import spanish
from evidara.operators import fulltext

STEMS = {
    "cheque": "chequ", "chequeo": "cheque", "cheques": "chequ", "cheviot": "cheviot", "chica": "chic", "chicago": "chicag", "chicas": "chic", "chicharrones": "chicharron", "chico": "chic", "chiapaneca": "chiapanec",
    "tórax": "torax", "torcer": "torc", "toreado": "tor", "toreándolo": "tor", "torear": "tor", "torearlo": "tor", "toreo": "tore", "torero": "torer", "toreros": "torer", "torio": "tori", "tormenta": "torment", "tornado": "torn",
    "tornen": "torn", "torneo": "torne", "tornillo": "tornill", "torniquete": "torniquet", "toro": "tor", "toronto": "toront", "torpedearon": "torped", "torpeza": "torpez", "trabajadores": "trabaj", "seguridad": "segur",
    "prevenciones": "prevencion", "tecnologías": "tecnolog", "soluciones": "solucion", "presencia": "presenci", "residencia": "resident", "contribución": "contribu", "relativamente": "relat", "rápidamente": "rapid", "amablemente": "amabl", "contribuyendo": "contribu", "llegué": "lleg", "paguen": "pag", "y": "y", "": "", "año": "año", "oír": "oir",
}


def test_stems(spark):
    got = {r.word: r.stem for r in spanish.with_stems(spark.createDataFrame([(w,) for w in STEMS], "word string")).collect()}
    assert got == STEMS


def test_search_is_the_scan_without_the_texts(spark, tmp_path):
    rng = random.Random(7)
    words = "el trabajo trabajos trabajando seguro seguros seguridad riesgo riesgos de la norma normas Normativa NIÑOS niño x1 y".split()
    docs = [(i, rng.choice((" ", ", ", "\n")).join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "--")]
    docs = spark.createDataFrame(docs, "node_id long, text string")
    path = f"file://{tmp_path}/index"
    fulltext.build(docs, path)
    for question in ("trabajos y seguridad", "NIÑO", "riesgo norma niños x1", "nada que no está", "de la", ""):
        found = fulltext.search(spark, path, question, 40)
        assert list(map(tuple, found.collect())) == (list(map(tuple, fulltext.scan(docs, question, 40).collect())) if fulltext.asked(spark, question) else [])
    plan = fulltext.search(spark, path, "riesgo norma", 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "ExistingRDD" not in plan and "CartesianProduct" not in plan
