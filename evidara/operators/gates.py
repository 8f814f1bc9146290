"""Gates: why something may not proceed, as rows of reasons; precedence, reconciliation, ownership and comparison of snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reasons(**checks: Column) -> Column:
    """The sorted names whose condition is true (null: false), joined by commas; empty if nothing bars."""
    return F.concat_ws(",", F.array_sort(F.array(*[F.when(c, F.lit(name.upper())) for name, c in checks.items()])))


def violations(rows: DataFrame, key: str, **rules: Column) -> DataFrame:
    """(key, rule) for every row and rule that does not hold; as in a CHECK constraint, null holds."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.select(F.col(key), F.explode(broken).alias("rule"))


def active_counts(vectors: DataFrame, lane: list[str]) -> DataFrame:
    """Active rows, distinct documents and the bundle of each lane (null unless there is just one)."""
    active = vectors.where("is_active").groupBy(*lane).agg(F.count("*").alias("active_rows"), F.countDistinct("document_id").alias("active_documents"), F.min("bundle_id").alias("_low"), F.max("bundle_id").alias("_high"))
    return active.withColumn("bundle_id", F.when(F.col("_low") == F.col("_high"), F.col("_low"))).drop("_low", "_high")


def retrieval_readiness(retrieval: DataFrame, profiles: DataFrame, targets: DataFrame, vectors: DataFrame) -> DataFrame:
    """(retrieval_id, active_rows, active_documents, bundle_id, ready, blocking_reasons) of
    retrieval(retrieval_id, active, validation, profile_id, target_id), profiles(profile_id, vector_table, metric, queryable),
    targets(target_id, target_table, metrics array) and vectors(profile_id, target_id, document_id, bundle_id, is_active)."""
    counts = active_counts(vectors, ["profile_id", "target_id"])
    joined = retrieval.join(profiles, "profile_id", "left").join(targets, "target_id", "left").join(counts, ["profile_id", "target_id"], "left")
    fits = (F.col("target_table") == F.col("vector_table")) & F.array_contains("metrics", F.col("metric"))
    found = reasons(
        retrieval_profile_blocked=~F.col("active"), retrieval_profile_not_validated=~F.col("validation").eqNullSafe("passed"),
        embedding_profile_compatibility_not_proven=~F.coalesce("queryable", F.lit(False)), indexing_target_incompatible=~F.coalesce(fits, F.lit(False)),
        no_active_vector_rows=F.col("target_table").isNotNull() & F.col("active_rows").isNull(),
    )
    out = joined.withColumn("blocking_reasons", found)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("retrieval_id", zero("active_rows"), zero("active_documents"), "bundle_id", (F.col("blocking_reasons") == "").alias("ready"), "blocking_reasons")


def indexing_readiness(bundles: DataFrame, profiles: DataFrame, targets: DataFrame) -> DataFrame:
    """(bundle_id, ready, blocking_reasons): whether a bundle may be indexed. bundles(bundle_id, profile_id, status, configuration_fingerprint, metric),
    profiles(profile_id, proven, document_enabled, waived, expected_fingerprint, vector_table, target_id), targets(target_id, target_active, target_table, metrics array)."""
    rows = bundles.join(profiles, "profile_id", "left").join(targets, "target_id", "left")
    fits = F.col("target_active") & (F.col("target_table") == F.col("vector_table")) & F.array_contains("metrics", F.col("metric"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    found = reasons(
        embedding_bundle_invalid=~F.col("status").eqNullSafe("sealed"), embedding_profile_compatibility_not_proven=~yes(F.col("proven")), embedding_profile_documents_disabled=~yes(F.col("document_enabled")) & ~yes(F.col("waived")),
        embedding_engine_semantic_mismatch=~F.col("configuration_fingerprint").eqNullSafe(F.col("expected_fingerprint")), indexing_target_incompatible=~yes(fits),
    )
    return rows.withColumn("blocking_reasons", found).select("bundle_id", (F.col("blocking_reasons") == "").alias("ready"), "blocking_reasons")


def serving_readiness(runs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(run_id, active_vector_rows, ready, blocking_reasons): whether an indexing run can serve searches. runs(run_id, status, activation_status, bundle_id,
    target_id, corpus_version), vectors(bundle_id, target_id, corpus_version, is_active)."""
    lane = ["bundle_id", "target_id", "corpus_version"]
    counts = vectors.where("is_active").groupBy(*lane).agg(F.count("*").alias("active_vector_rows"))
    rows = runs.join(counts, lane, "left").withColumn("active_vector_rows", F.coalesce("active_vector_rows", F.lit(0)))
    placed = F.col("bundle_id").isNotNull() & F.col("target_id").isNotNull() & F.col("corpus_version").isNotNull()
    found = reasons(
        indexing_run_not_completed=~F.col("status").eqNullSafe("completed"), indexing_bundle_not_activated=~F.col("activation_status").eqNullSafe("active"),
        no_active_vector_rows=placed & (F.col("active_vector_rows") == 0), indexing_target_incompatible=~placed,
    )
    return rows.withColumn("blocking_reasons", found).select("run_id", "active_vector_rows", (F.col("blocking_reasons") == "").alias("ready"), "blocking_reasons")


def health(**families: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(family, issue, subject): every failing row of every check of every family, each given as (issue, frame of failing rows, column that names them)."""
    rows = [df.select(F.lit(family).alias("family"), F.lit(issue).alias("issue"), F.col(column).cast("string").alias("subject")) for family, checks in families.items() for issue, df, column in checks]
    return reduce(DataFrame.unionByName, rows)


def run_errors(runs: DataFrame, documents: DataFrame) -> DataFrame:
    """(run_id, document_id, status, error_code): failed and skipped documents; a failed run without any gets one row of its own code."""
    bad = documents.where(F.col("status").isin("failed", "skipped")).select("run_id", "document_id", "status", "error_code")
    own = runs.where("status = 'failed' and error_code <> ''").join(bad.select("run_id").distinct(), "run_id", "left_anti")
    return bad.unionByName(own.select("run_id", F.lit("").alias("document_id"), "status", "error_code"))


def first_measured(documents: DataFrame, pages: DataFrame, sources: list[str], *, key: str = "document_id") -> DataFrame:
    """(key, kind, value): the first of the sources that has a value, else the mean of the pages' confidences, else unavailable."""
    mean = pages.where("confidence is not null").groupBy(key).agg(F.avg("confidence").alias("_mean"))
    named = F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in sources], F.when(F.col("_mean").isNotNull(), F.lit("page_confidence_average")), F.lit("unavailable"))
    return documents.join(mean, key, "left").select(key, named.alias("kind"), F.coalesce(*sources, "_mean").alias("value"))


def reconcile(local: DataFrame, remote: DataFrame, *, keys: list[str]) -> DataFrame:
    """Remote values replace local ones where they are supported and evidenced; source says which counts."""
    other = remote.select(*keys, F.col("value").alias("_value"), (F.col("supported") & (F.col("evidence") != "")).alias("_ok"))
    won = F.coalesce(F.col("_ok") & F.col("_value").isNotNull(), F.lit(False))
    return local.join(other, keys, "left").select(*keys, F.when(won, F.col("_value")).otherwise(F.col("value")).alias("value"), F.when(won, "remote").otherwise("local").alias("source"))


def attach_identity(records: DataFrame, revisions: DataFrame, *, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(records with their revision and project, records without a revision): nothing may go on while the second has rows."""
    identity = revisions.select(key, "revision_id", "project_id")
    return records.join(identity, key), records.join(identity, key, "left_anti")


def issue_counts(**failures: DataFrame) -> DataFrame:
    """(issue, row_count) of the frames of failing rows that are not empty."""
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("issue"), "row_count") for name, df in failures.items()]
    return reduce(DataFrame.unionByName, counts).where("row_count > 0")


def ownership(records: DataFrame, group: str) -> DataFrame:
    """(group, ownership, project_id) of records(ordinal, readable, project_id): platform if any readable record has a project (the first in order
    counts), else unverifiable if any cannot be read, else legacy."""
    owned = F.col("readable") & (F.col("project_id") != "")
    per = records.groupBy(group).agg(F.min_by("project_id", F.when(owned, F.col("ordinal"))).alias("project_id"), F.bool_or(owned).alias("_owned"), F.bool_or(~F.coalesce("readable", F.lit(False))).alias("_unread"))
    return per.select(group, F.when(F.col("_owned"), "platform").when(F.col("_unread"), "unverifiable").otherwise("legacy").alias("ownership"), F.when(F.col("_owned"), F.col("project_id")).alias("project_id"))


def changes(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): what two snapshots of (path, hash) do not share: added, removed or changed."""
    a, b = before.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_in_a")), after.select(key, F.col(digest).alias("_b"), F.lit(True).alias("_in_b"))
    kind = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("change")).where("change is not null")


def call_order(calls: DataFrame, run: str) -> DataFrame:
    """(run, reason) of calls(run, position, stop): one parse, no repeats, extract after parse, classify before extract; the first broken rule, else
    empty."""
    at = lambda stop: F.min(F.when(F.col("stop") == stop, F.col("position")))
    per = calls.groupBy(run).agg(F.count_if(F.col("stop") == "parse").alias("n"), (F.countDistinct("stop") < F.count("stop")).alias("again"), at("parse").alias("p"), at("extract").alias("e"), at("classify").alias("c"))
    return per.select(run, F.when(F.col("n") != 1, "not_one_parse").when(F.col("again"), "repeated").when(F.col("e") < F.col("p"), "extract_before_parse").when(F.col("c") > F.col("e"), "classify_after_extract").otherwise("").alias("reason"))


def golden(expected: DataFrame, actual: DataFrame, key: str, fields: list[str], fold=lambda value, field: value) -> DataFrame:
    """(key, field, expected, actual) where they differ, as fold(value, field) shows them; a missing document differs in every field that is expected."""
    theirs = actual.select(key, *[F.col(f).cast("string").alias(f"_{f}") for f in fields])
    joined = expected.select(key, *fields).join(theirs, key, "left")
    differs = lambda f: ~fold(F.col(f).cast("string"), f).eqNullSafe(fold(F.col(f"_{f}"), f))
    pairs = [F.when(differs(f), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("expected"), F.col(f"_{f}").alias("actual"))) for f in fields]
    return joined.select(key, F.inline(F.array_compact(F.array(*pairs))))


def provision(profiles: DataFrame, targets: DataFrame) -> DataFrame:
    """(profile_id, target_id): the smallest target whose table and metric suit the profile; null if none does."""
    fitting = targets.select("target_id", F.col("target_table").alias("vector_table"), F.explode(F.array_distinct("metrics")).alias("metric"))
    # one row a table and metric, so no profile meets all the targets that suit it
    smallest = fitting.groupBy("vector_table", "metric").agg(F.min("target_id").alias("target_id"))
    return profiles.join(smallest, ["vector_table", "metric"], "left").groupBy("profile_id").agg(F.min("target_id").alias("target_id"))


def best_title(candidates: DataFrame, document: str, *, strong: int = 100) -> DataFrame:
    """(document, text, page, score) of candidates(position, page, score, text): of strong ones that of the earliest page, else the best of page one
    above zero; ties go to the first position, then the least text. Documents with neither keep all candidates and have no row here."""
    first = F.when(F.col("score") >= strong, F.struct(F.lit(0).alias("a"), F.coalesce("page", F.lit(9999)).cast("double").alias("b"), F.col("position").alias("c"), F.col("text").alias("d"))).when(
        (F.col("page") == 1) & (F.col("score") > 0), F.struct(F.lit(1).alias("a"), (-F.col("score")).cast("double").alias("b"), F.col("position").alias("c"), F.col("text").alias("d"))
    )
    best = candidates.withColumn("_rank", first).where("_rank is not null").groupBy(document).agg(F.min_by(F.struct("text", "page", "score"), "_rank").alias("x"))
    return best.select(document, "x.*")


def unsupported_fields(fields: DataFrame, texts: DataFrame, fold, *, key: str = "document_id") -> DataFrame:
    """(key, name) of critical fields(name, value, evidence array) of which neither the value nor any evidence stands in the folded text."""
    body = texts.select(key, fold(F.col("text")).alias("_text"))
    value = fold(F.col("value"))
    inside = lambda x: F.coalesce(F.col("_text").contains(x), F.lit(False))
    told = F.exists(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: (e != "") & inside(fold(e)))
    missing = F.col("value").isNotNull() & (value != "") & ~inside(value) & ~F.coalesce(told, F.lit(False))
    return fields.where("critical").join(body, key, "left").where(missing).select(key, "name")


def box(x0: Column, x1: Column, top: Column, bottom: Column, y0: Column, y1: Column, height: Column) -> Column:
    """A box from the top: coordinates from the bottom are turned if top or bottom is missing; boxes without extent grow by 0.01."""
    turn = top.isNull() | bottom.isNull()
    t, b = F.when(turn, height - y1).otherwise(top), F.when(turn, height - y0).otherwise(bottom)
    return F.struct(x0.alias("x0"), t.alias("top"), F.when(x1 <= x0, x0 + 0.01).otherwise(x1).alias("x1"), F.when(b <= t, t + 0.01).otherwise(b).alias("bottom"), ((x1 <= x0) | (b <= t)).alias("expanded"))


def around(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The box around each group's boxes; null if any has no page."""
    paged = F.count("page") == F.count("*")
    return boxes.groupBy(*keys).agg(*[F.when(paged, f(c)).alias(c) for c, f in (("x0", F.min), ("top", F.min), ("x1", F.max), ("bottom", F.max))], F.when(paged, F.min("page")).alias("page_start"), F.when(paged, F.max("page")).alias("page_end"))


def collisions(planned: DataFrame, path: str, source: str) -> DataFrame:
    """(path, n, sources) of output paths that several sources would write."""
    return planned.groupBy(path).agg(F.countDistinct(source).alias("n"), F.concat_ws(",", F.array_sort(F.collect_set(F.col(source).cast("string")))).alias("sources")).where("n > 1")


def same_rerun(first: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """(key, reason) of a rerun of runs(key, bundle_id, input_hash, reused) that is not the first run over again."""
    b = again.select(key, F.col("bundle_id").alias("_bundle"), F.col("input_hash").alias("_input"), F.col("reused").alias("_reused"), F.lit(True).alias("_ran"))
    reason = F.when(F.col("_ran").isNull(), "missing").when(~F.col("input_hash").eqNullSafe(F.col("_input")), "input_changed").when(~F.col("bundle_id").eqNullSafe(F.col("_bundle")), "other_id").when(~F.coalesce("_reused", F.lit(False)), "not_reused")
    return first.join(b, key, "left").select(key, reason.alias("reason")).where("reason is not null")


def chunk_summary(children: DataFrame, key: str = "document_id") -> DataFrame:
    """Per document of children(page_start, page_end, parent_id, token_count, reasons array): counts, tokens, whether any child spans pages, reasons."""
    per = children.groupBy(key).agg(
        F.countDistinct("parent_id").alias("parents"), F.count("*").alias("children"), F.sum("token_count").alias("tokens"),
        F.coalesce(F.bool_or(F.col("page_end") > F.col("page_start")), F.lit(False)).alias("cross_page"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"),
    )
    return per.withColumn("reasons", F.array_join("reasons", ","))


def aligned(children: DataFrame, vectors: DataFrame, key: str = "child_id") -> tuple[DataFrame, DataFrame]:
    """(vector records of the children, errors): every child needs a vector and every vector a child."""
    errors = children.select(key).join(vectors.select(key), key, "left_anti").withColumn("error", F.lit("child_without_vector")).unionByName(vectors.select(key).join(children.select(key), key, "left_anti").withColumn("error", F.lit("vector_without_child")))
    return children.join(vectors, key), errors


def ordered_unique(values: Column) -> Column:
    """Each value once, in the order of its first place; nulls and empty ones go."""
    return F.filter(F.array_distinct(values), lambda x: x.isNotNull() & (x != ""))
