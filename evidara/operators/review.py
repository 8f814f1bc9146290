"""Review and layout predicates: coverage candidates, reasons, ownership, table-of-contents runs, bundle checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def area_ratio(width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    return F.round(width * height / (page_width * page_height), 6)


def coverage_candidates(images: DataFrame, *, logo: float = 0.05, instruction: float = 0.15, sparse_words: int = 20) -> DataFrame:
    """images(page, width, height, page_width, page_height, top, words): logo (small, in the top eighth), instruction image (large, or any on a
    sparse page), else decoration."""
    ratio = area_ratio(F.col("width"), F.col("height"), F.col("page_width"), F.col("page_height"))
    kind = F.when((F.col("ratio") < logo) & (F.col("top") < F.col("page_height") / 8), "logo").when((F.col("ratio") >= instruction) | (F.col("words") < sparse_words), "instruction").otherwise("decoration")
    return images.withColumn("ratio", ratio).withColumn("kind", kind)


def reasons(*parts: Column) -> Column:
    """Reasons of several sources in order, each once, without empty ones."""
    return F.filter(F.array_distinct(F.concat(*parts)), lambda x: x.isNotNull() & (x != ""))


def sole_owner(rows: DataFrame, lane: str, owner: str) -> DataFrame:
    """The only owner of each lane, else why there is none."""
    found = rows.groupBy(lane).agg(F.array_sort(F.collect_set(owner)).alias("owners"))
    n = F.size("owners")
    return found.select(lane, F.when(n == 1, F.element_at("owners", 1)).alias("owner"), F.when(n == 0, "no_owner").when(n > 1, "several_owners").otherwise("").alias("reason"))


def contents_runs(lines: DataFrame, keys: list[str], order: str, *, label: Column, entry: Column) -> DataFrame:
    """in_contents: lines of a table of contents, which a label line starts and the first line that is no entry ends."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    started = F.max(F.when(label, F.col(order))).over(w)
    ended = F.max(F.when(~label & ~entry, F.col(order))).over(w)
    return lines.withColumn("in_contents", started.isNotNull() & (ended.isNull() | (ended < started)))


def bundle_checks(vectors: DataFrame, *, dimension: int, keys: str = "bundle_id") -> DataFrame:
    """(bundle, check, passed): dense offsets, equal dimension, finite values, non-zero norms, unique nodes."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    per = vectors.groupBy(keys).agg(
        ((F.min("offset") == 0) & (F.max("offset") == F.count("*") - 1) & (F.countDistinct("offset") == F.count("*"))).alias("dense_offsets"),
        F.bool_and(F.size("embedding") == dimension).alias("dimension"), F.bool_and(finite).alias("finite"),
        F.bool_and(F.exists("embedding", lambda x: x != 0)).alias("non_zero"), (F.countDistinct("node_id") == F.count("*")).alias("unique_nodes"),
    )
    return per.unpivot([keys], ["dense_offsets", "dimension", "finite", "non_zero", "unique_nodes"], "check", "passed")


def snapshot_gate(members: DataFrame) -> DataFrame:
    """members(snapshot_id, revision_id, project_id, owner_id, review_state, decision): the first reason that bars each snapshot, empty if none."""
    per = members.groupBy("snapshot_id").agg(
        F.count("revision_id").alias("n"), F.countDistinct("revision_id").alias("d"), F.bool_or(F.col("project_id") != F.col("owner_id")).alias("foreign"), F.bool_or(F.col("review_state") == "blocked").alias("blocked"),
        F.bool_or((F.col("review_state") == "needs_review") & F.col("decision").isNull()).alias("undecided"),
    )
    return per.select("snapshot_id", F.when(F.col("n") == 0, "empty").when(F.col("d") < F.col("n"), "duplicate").when(F.col("foreign"), "foreign_project").when(F.col("blocked"), "blocked").when(F.col("undecided"), "needs_decision").otherwise("").alias("reason"))


def article_level(label: Column) -> Column:
    """Depth of a numbered heading: dots and one, six at most; an article heads a level one."""
    return F.when(F.lower(label).rlike("^art[ií]culo"), 1).otherwise(F.least(F.lit(6), F.length(label) - F.length(F.replace(label, F.lit("."))) + 1))


def front_matter(pairs: list[tuple[str, Column]]) -> Column:
    return F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in pairs], F.lit("---"))
