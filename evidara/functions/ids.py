"""Content-addressed ids: a prefix and a hash of fenced fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "\u001f"


def fenced(prefix: str, *fields: Column | str, length: int = 32) -> Column:
    """Nulls count as empty, so two ids differ if any field does."""
    parts = [F.coalesce(F.col(x).cast("string") if isinstance(x, str) else x.cast("string"), F.lit("")) for x in fields]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(FENCE, *parts), 256), 1, length))


def document_id(path: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha1(path), 1, 16))


def project_document_id(project: Column | str, path: Column | str) -> Column:
    return fenced("sdoc_", project, path)


def revision_id(project: Column | str, path: Column | str, content_hash: Column | str) -> Column:
    return fenced("srev_", project, path, content_hash)


def node_id(project: Column | str, bundle: Column | str, chunk: Column | str) -> Column:
    """The id of a chunk's node in one bundle of one project."""
    return fenced("pnode_", project, bundle, chunk)


def normalized_document_id(project: Column | str, revision: Column | str, processing: Column | str) -> Column:
    return fenced("ndoc_", project, revision, processing)


def embedding_bundle_id(source: Column | str, profile: Column | str, *parts: Column | str) -> Column:
    return fenced("ebun_", source, profile, *parts, length=64)


def retrieval_profile_id(*parts: Column | str) -> Column:
    return fenced("rprof_", *parts, length=64)


def readiness_check_id(kind: Column | str, subject: Column | str, report: Column | str) -> Column:
    return fenced("rchk_", kind, subject, report, length=64)
