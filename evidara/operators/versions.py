"""Stored artifacts of schema 1.0 and 2.0 as rows of 2.0, for every kind of artifact.

A payload is parsed once into a variant. Where a field stands is told by a table of paths for each version; what a version lacks is null. What cannot be read is a row
with a reason, never an error."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """paths: field -> (type, path in 1.0, path in 2.0), below the item if there are items; required: fields without which a payload is refused."""

    paths: dict[str, tuple[str, str | None, str | None]]
    required: tuple[str, ...] = ("document_id",)
    items: str | None = None
    top: tuple[str, ...] = field(default=("document_id",))


#: Where the fields of each kind stand, document types that 1.0 knew, and what adapted rows say of themselves.
KINDS = {
    "metadata": Kind(
        {
            "document_id": ("string", "$.document_id", "$.document_id"), "document_name": ("string", "$.document_name", "$.document_name"), "source": ("string", "$.source_path", "$.source_relpath"),
            "normalized": ("string", "$.normalized_path", "$.normalized_relpath"), "document_type": ("string", "$.document_type", "$.classification.document_type"), "topic": ("string", "$.topic", "$.classification.topic"),
            "version": ("string", "$.version", "$.document_control.version.value"), "title": ("string", None, "$.document_control.title.value"), "status": ("string", "$.processing_status", "$.processing_status"),
            "page_count": ("bigint", "$.page_count", "$.page_count"), "confidence": ("double", "$.classification_confidence", "$.classification.document_type_confidence.value"), "hash": ("string", "$.content_hash", "$.source_hash"),
        },
        ("document_id", "source", "status"),
    ),
    "pages": Kind(
        {
            "document_id": ("string", "$.document_id", "$.document_id"), "page_number": ("bigint", "$.page_number", "$.page_number"), "text_raw": ("string", "$.text_raw", "$.text_raw"), "method": ("string", "$.extraction_method", "$.extraction_method"),
            "confidence": ("double", "$.ocr_confidence", "$.ocr_confidence.value"), "handwriting": ("boolean", "$.has_handwriting_warning", None),
        },
        ("document_id", "page_number"), "$.pages",
    ),
    "ocr": Kind(
        {
            "document_id": ("string", "$.document_id", "$.document_id"), "engine": ("string", "$.engine", "$.engine"), "page_number": ("bigint", "$.page_number", "$.page_number"), "confidence": ("double", "$.confidence", "$.confidence.value"),
            "word_count": ("bigint", "$.word_count", "$.word_count"), "rotation": ("double", "$.rotation_detected_degrees", "$.rotation.value"), "rotation_status": ("string", None, "$.rotation.status"),
        },
        ("document_id", "page_number"), "$.pages", ("document_id", "engine"),
    ),
    "tables": Kind(
        {
            "document_id": ("string", "$.document_id", "$.document_id"), "table_id": ("string", "$.table_id", "$.table_id"), "page_number": ("bigint", "$.page_number", "$.page_number"), "headers": ("array<string>", "$.headers", "$.headers"),
            "rows": ("array<array<string>>", "$.rows", "$.rows"), "quality": ("double", "$.quality", "$.quality.value"), "extractor": ("string", None, "$.extractor"),
        },
        ("document_id", "table_id"), "$.tables",
    ),
    "inventory": Kind(
        {
            "document_id": ("string", "$.document_id", "$.document_id"), "document_name": ("string", "$.document_name", "$.document_name"), "source": ("string", "$.source_path", "$.source_relpath"), "hash": ("string", "$.content_hash", "$.content_hash"),
            "file_size": ("bigint", "$.file_size", "$.file_size"), "status": ("string", "$.processing_status", "$.processing_status"),
        },
        ("document_id", "source", "status"),
    ),
}
OLD, NEW = "1.0", "2.0"
OLD_TYPES = ("manual", "formulario", "politica", "reglamento", "programa", "matriz", "procedimiento", "anexo", "instructivo", "capacitacion", "acta", "norma", "guia", "informacion_general")
SKIPPED, OTHER_TYPE = "legacy_skipped_status_mapped_to_needs_review", "legacy_document_type_mapped_to_otro"
ABSOLUTE, UNSAFE = "legacy_absolute_path_not_relativized", "legacy_relative_path_unsafe"
HANDWRITING, ROTATION, GEOMETRY = "legacy_handwriting_warning_unverified", "legacy_rotation_not_measured", "legacy_geometry_unavailable"


def _got(variant: Column, kind: str, path: str | None) -> Column:
    return F.try_variant_get(variant, path, kind) if path else F.lit(None).cast(kind)


def _relative(path: Column, root: str | None, document: Column, fallback: Column) -> tuple[Column, Column]:
    """(relative path, warning): safe relative paths stay, absolute ones below the root lose it; all others stand in for themselves under legacy/; null stays null."""
    absolute = path.rlike(r"^/|^[A-Za-z]:[\\/]|^\\\\")
    slashed = F.translate(path, "\\", "/")
    safe = ~absolute & (path != "") & ~slashed.rlike(r"(^|/)(\.{0,2})(/|$)")
    below = absolute & F.lit(root is not None) & F.startswith(slashed, F.lit(f"{(root or '').rstrip('/')}/"))
    name = F.element_at(F.split(slashed, "/"), -1)
    stands = F.concat_ws("/", F.lit("legacy"), document, F.when(name.isin("", ".", ".."), fallback).otherwise(name))
    made = F.when(safe, slashed).when(below, F.substr(slashed, F.lit(len((root or "").rstrip("/")) + 2))).otherwise(stands)
    return F.when(path.isNotNull(), made), F.when(path.isNull() | safe | below, None).when(absolute, ABSOLUTE).otherwise(UNSAFE)


def adapted(payloads: DataFrame, kind: str, *, key: str = "artifact_id", body: str = "body", root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of 2.0 with schema_version as stored and warnings, refused payloads (key, reason)) of payloads(key, body) of one kind."""
    spec = KINDS[kind]
    # generated columns: a filter on plain ones would go below them, and the optimizer would parse once more for every use of a field
    parsed = payloads.select(key, F.col(body).isNull().alias("_none"), F.explode(F.array(F.try_parse_json(body))).alias("_v"))
    parsed = parsed.withColumn("_version", F.try_variant_get("_v", "$.schema_version", "string"))
    top = [name for name in spec.paths if not spec.items or name in spec.top]
    pick = lambda variant, name: F.when(F.col("_version") == NEW, _got(variant, spec.paths[name][0], spec.paths[name][2])).otherwise(_got(variant, spec.paths[name][0], spec.paths[name][1]))
    rows = parsed.select("*", F.inline(F.array(F.struct(*[pick(F.col("_v"), name).alias(name) for name in top]))))
    if spec.items:
        rows = rows.withColumn("_items", F.try_variant_get("_v", spec.items, "array<variant>"))
        reason_items = F.when(F.col("_items").isNull(), "no_items")
    else:
        reason_items = F.lit(None).cast("string")
    missing = [F.when(F.col(name).isNull(), f"missing_{name}") for name in spec.required if name in top]
    readable = F.when(F.col("_none") | F.col("_v").isNull(), "invalid_json").when(~F.coalesce(F.col("_version").isin(OLD, NEW), F.lit(False)), "unknown_version")
    rows = rows.withColumn("_reason", F.coalesce(readable, *missing, reason_items))
    refused = rows.where("_reason is not null").select(key, F.col("_reason").alias("reason"))
    good = rows.where("_reason is null")
    if spec.items:
        good = good.select(key, "_version", *top, F.explode("_items").alias("_item"))
        good = good.select("*", F.inline(F.array(F.struct(*[pick(F.col("_item"), name).alias(name) for name in spec.paths if name not in top]))))
        short = F.coalesce(*[F.when(F.col(name).isNull(), f"item_missing_{name}") for name in spec.required if name not in top])
        good = good.withColumn("_reason", short)
        refused = refused.unionByName(good.where("_reason is not null").select(key, F.col("_reason").alias("reason")).distinct())
        good = good.where("_reason is null")
    old = F.col("_version") == OLD
    warnings, made = [], {name: F.col(name) for name in spec.paths}
    if "status" in made:
        warnings.append(F.when(old & (F.col("status") == "skipped"), SKIPPED))
        made["status"] = F.when(old & (F.col("status") == "skipped"), "needs_review").otherwise(F.col("status"))
    if "document_type" in made:
        odd = old & ~F.coalesce(F.col("document_type").isin(*OLD_TYPES), F.lit(False))
        warnings.append(F.when(odd, OTHER_TYPE))
        made["document_type"] = F.when(odd, "otro").otherwise(F.col("document_type"))
    for name, fallback in (("source", F.col("document_name") if "document_name" in made else F.lit("source")), ("normalized", F.concat("document_id", F.lit(".md")))):
        if name in made:
            path, warning = _relative(F.col(name), root, F.col("document_id"), fallback)
            made[name] = F.when(old, path).otherwise(F.col(name))
            warnings.append(F.when(old, warning))
    if "handwriting" in made:
        warnings.append(F.when(old & F.col("handwriting"), HANDWRITING))
    if "rotation" in made:
        warnings.append(F.when(old & F.col("rotation").isNotNull(), ROTATION))
        made["rotation_status"] = F.when(old, F.when(F.col("rotation").isNull(), "unavailable").otherwise("estimated")).otherwise(F.col("rotation_status"))
    if "extractor" in made:
        warnings.append(F.when(old, GEOMETRY))
        made["extractor"] = F.when(old, "legacy_v1").otherwise(F.col("extractor"))
    noted = F.array_distinct(F.array_compact(F.array(*warnings))) if warnings else F.array().cast("array<string>")
    return good.select(key, F.col("_version").alias("schema_version"), *[c.alias(n) for n, c in made.items()], noted.alias("warnings")), refused
