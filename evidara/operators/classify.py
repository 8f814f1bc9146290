"""Keyword rules over several sources of evidence, and control fields with conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import text as T

#: How much each source of evidence counts, and what is assumed without any.
AUTHORITY = {"title_control": 0.95, "content": 0.78, "filename": 0.65, "route": 0.45}
DEFAULT_AUTHORITY = 0.35
#: Document types and the folded words that name them, in order of precedence.
TYPE_RULES = (
    ("formulario", ("formato", "formulario", "fr-sst")),
    ("programa", ("programa",)),
    ("matriz", ("matriz", "objetivos y metas")),
    ("procedimiento", ("procedimiento",)),
    ("reglamento", ("reglamento",)),
    ("politica", ("politica",)),
    ("manual", ("manual",)),
    ("anexo", ("anexo",)),
    ("instructivo", ("instructivo",)),
    ("capacitacion", ("capacitacion",)),
    ("acta", ("acta",)),
    ("norma", ("norma",)),
    ("guia", ("guia",)),
    ("informacion_general", ("comunicacion", "miembros", "valores", "introduccion", "aplicacion", "funciones", "objetivo")),
)


#: Topics and subtopics and the folded words that name them, in order of precedence.
TOPIC_RULES = (
    ("Sistema de Gestión de Seguridad y Salud en el Trabajo", ("seguridad y salud en el trabajo", "sistema de gestion de seguridad y salud", "sg-sst", "sgsst")),
    ("COPASST", ("copasst", "comite paritario")),
    ("Comité de Convivencia Laboral", ("comite de convivencia",)),
    ("Convivencia laboral", ("convivencia laboral", "convivencia", "desconexion laboral", "acoso laboral")),
    ("Política de seguridad", ("politica de seguridad",)),
    ("Seguridad vial", ("seguridad vial",)),
    ("Capacitaciones", ("capacitacion",)),
    ("Formularios", ("formulario", "formato", "fr-sst")),
    ("Reglamento interno de trabajo", ("reglamento interno",)),
    ("Pausas activas", ("pausas activas",)),
    ("Prevención de alcohol y drogas", ("alcohol", "drogas")),
    ("Auditoria", ("auditoria",)),
    ("Mejora", ("mejora",)),
    ("Planificacion", ("planificacion",)),
    ("Verificacion", ("verificacion",)),
    ("Organizacion", ("organizacion",)),
    ("ARL", ("arl",)),
)
SUBTOPIC_RULES = (
    ("Queja por presunto acoso laboral", ("interponer queja", "presunto acoso")),
    ("Funcionamiento del comité", ("reglamento comite", "reglamento del comite", "funcionamiento del comite")),
    ("Prevención de fatiga y desórdenes musculoesqueléticos", ("pausas activas", "fatiga", "musculoesquelet")),
    ("Objetivos, metas e indicadores", ("objetivos y metas", "metas e indicadores")),
    ("Desconexión laboral", ("desconexion laboral",)),
    ("Prevención del acoso laboral, sexual, violencia basada en género y discriminación", ("prevencion de acoso", "violencia basada en genero")),
    ("Política de SST", ("politica de seguridad y salud",)),
)
#: What a document without any match is.
DEFAULT_TYPE, DEFAULT_TOPIC = "otro", "SST"

Rules = tuple[tuple[str, tuple[str, ...]], ...]


def folded(term: str) -> str:
    """A rule's term as ``T.fold_key`` folds texts."""
    return " ".join(term.translate(str.maketrans(T.ACCENTED, T.PLAIN)).lower().replace("_", " ").replace("-", " ").split())


def matches(text: Column, rules: Rules) -> Column:
    """Numbers of the rules of which a term stands in the folded text, ascending."""
    of = lambda t: F.array_compact(F.array(*[F.when(reduce(Column.__or__, [F.contains(t, F.lit(folded(x))) for x in terms]), F.lit(i)) for i, (_, terms) in enumerate(rules)]))
    # bound once: the text is folded once for all terms
    return F.get(F.transform(F.array(T.fold_key(text)), of), 0)


def choose(evidence: DataFrame, rules: Rules = TYPE_RULES, *, key: str = "document_id") -> DataFrame:
    """evidence(key, source, text): the value of the best match (authority, then rule order), its source and authority (default without any) and how many
    values match. Every text is read once, whatever the number of terms; only matches are shuffled."""
    authority = F.coalesce(F.create_map(*[x for k, v in AUTHORITY.items() for x in (F.lit(k), F.lit(v))])[F.col("source")], F.lit(DEFAULT_AUTHORITY))
    hits = evidence.select(key, "source", authority.alias("_a"), F.explode_outer(matches(F.coalesce("text", F.lit("")), rules)).alias("_rule"))
    best = hits.groupBy(key).agg(
        F.min_by(F.struct("_rule", "source", "_a"), F.when(F.col("_rule").isNotNull(), F.struct(-F.col("_a"), "_rule"))).alias("b"), F.countDistinct("_rule").alias("n_values")
    )
    value = F.get(F.array(*[F.lit(v) for v, _ in rules]), F.col("b._rule"))
    return best.select(key, value.alias("value"), F.when(value.isNotNull(), F.col("b.source")).alias("source"), F.when(value.isNotNull(), F.col("b._a")).otherwise(DEFAULT_AUTHORITY).alias("authority"), "n_values")


def classify(evidence: DataFrame, *, key: str = "document_id") -> DataFrame:
    """(key, document_type, type_source, type_confidence, topic, topic_source, topic_confidence, subtopic, route_prior, content_prediction, warnings) of
    evidence(key, source, text), one row a source: subtopics are read from title and control fields alone; a type or topic that only the route
    names is a warning."""
    named = lambda rules, name, rows: choose(rows, rules, key=key).select(key, F.col("value").alias(name), F.col("source").alias(f"{name}_source"), F.col("authority").alias(f"{name}_confidence"))
    first = lambda source: F.get(F.array(*[F.lit(v) for v, _ in TYPE_RULES]), F.get(matches(F.max(F.when(F.col("source") == source, F.coalesce("text", F.lit("")))), TYPE_RULES), 0))
    single = evidence.groupBy(key).agg(first("route").alias("route_prior"), first("content").alias("content_prediction"))
    kinds = named(TYPE_RULES, "document_type", evidence)
    topics = named(TOPIC_RULES, "topic", evidence)
    subtopics = choose(evidence.where("source = 'title_control'"), SUBTOPIC_RULES, key=key).select(key, F.col("value").alias("subtopic"))
    route = F.coalesce(F.col("document_type_source") == "route", F.lit(False)) | F.coalesce(F.col("topic_source") == "route", F.lit(False))
    return single.join(kinds, key).join(topics, key).join(subtopics, key, "left").select(
        key, F.coalesce("document_type", F.lit(DEFAULT_TYPE)).alias("document_type"), F.col("document_type_source").alias("type_source"), F.col("document_type_confidence").alias("type_confidence"),
        F.coalesce("topic", F.lit(DEFAULT_TOPIC)).alias("topic"), "topic_source", "topic_confidence", "subtopic", "route_prior", "content_prediction", F.when(route, "route_only_low_confidence").otherwise("").alias("warnings"),
    )


def merge_fields(candidates: DataFrame, keys: DataFrame, *, key: str = "document_id") -> DataFrame:
    """candidates(key, field, value): extracted with one distinct value, conflicting with several, not_found with none."""
    found = candidates.where("value <> ''").groupBy(key, "field").agg(F.array_sort(F.collect_set("value")).alias("values"))
    n = F.size("values")
    return keys.join(found, [key, "field"], "left").select(
        key, "field", F.when(F.col("values").isNull(), "not_found").when(n == 1, "extracted").otherwise("conflicting").alias("status"), F.array_join(F.coalesce("values", F.array().cast("array<string>")), "|").alias("values")
    )
