"""What must hold before something is published or switched on, as rows (subject, check, passed). Nothing is raised; a caller stops on rows that did not pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcomes(rows: DataFrame, key: str, **checks: Column) -> DataFrame:
    """(key, check, passed): one row a check; a null outcome did not pass."""
    each = [F.struct(F.lit(name).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for name, c in checks.items()]
    return rows.select(key, F.inline(F.array(*each)))


def blocked(checks: DataFrame, key: str) -> DataFrame:
    """(key, status, failed): passed, or blocked with the names of what failed."""
    failed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check")))), ",")
    return checks.groupBy(key).agg(failed.alias("failed")).select(key, F.when(F.col("failed") == "", "passed").otherwise("blocked").alias("status"), "failed")


SEMANTICS = ("provider", "model", "model_revision", "dimension", "normalization", "distance_metric")


def bundle_report(bundles: DataFrame, profiles: DataFrame, sources: DataFrame, children: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The thirteen checks of an embedding bundle: bundles(bundle_id, chunk_bundle_id, profile_id, source_fingerprint, configuration_fingerprint, SEMANTICS,
    vector_count, has_checksums), profiles(profile_id, expected_fingerprint, can_embed, SEMANTICS), sources(chunk_bundle_id, content_fingerprint),
    children(chunk_bundle_id, child_id, content_hash), chunks(bundle_id, child_id, vector_offset, content_hash, vector_checksum), vectors(bundle_id, size).

    One shuffle by bundle and child, one by bundle: no bundle is gathered."""
    theirs = profiles.select("profile_id", "expected_fingerprint", "can_embed", *[F.col(c).alias(f"p_{c}") for c in SEMANTICS])
    known = bundles.join(theirs, "profile_id", "left").join(sources.withColumnRenamed("content_fingerprint", "now"), "chunk_bundle_id", "left")
    source = bundles.select("bundle_id", "chunk_bundle_id").join(children, "chunk_bundle_id").select("bundle_id", "child_id", F.col("content_hash").alias("h_source"))
    mapped = chunks.groupBy("bundle_id", "child_id").agg(F.count("*").alias("n"), F.min("content_hash").alias("h_low"), F.max("content_hash").alias("h_high"), F.sum(F.when(F.coalesce("vector_checksum", F.lit("")) == "", 1).otherwise(0)).alias("bare"))
    pairs = source.join(mapped, ["bundle_id", "child_id"], "full_outer").groupBy("bundle_id").agg(
        F.count("h_source").alias("n_source"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_mapped"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count_if(F.col("h_source").isNull()).alias("unknown"), F.count_if(F.col("n").isNull()).alias("missing"),
        F.count_if(F.col("n").isNotNull() & ~(F.col("h_source").eqNullSafe(F.col("h_low")) & F.col("h_source").eqNullSafe(F.col("h_high")))).alias("drifted"), F.coalesce(F.sum("bare"), F.lit(0)).alias("bare"),
    )
    places = chunks.groupBy("bundle_id").agg(F.min("vector_offset").alias("low"), F.max("vector_offset").alias("high"), F.countDistinct("vector_offset").alias("places"))
    sizes = vectors.groupBy("bundle_id").agg(F.count("*").alias("n_vectors"), F.min("size").alias("s_low"), F.max("size").alias("s_high"))
    rows = known.join(pairs, "bundle_id", "left").join(places, "bundle_id", "left").join(sizes, "bundle_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    same = F.lit(True)
    for c in SEMANTICS:
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    n = zero("n_source")
    return outcomes(
        rows, "bundle_id", source_chunk_bundle_registered=F.col("now").isNotNull(), source_content_fingerprint_matches=F.col("source_fingerprint") == F.col("now"), profile_verified=F.col("can_embed"),
        configuration_homogeneous=F.col("configuration_fingerprint") == F.col("expected_fingerprint"), engine_semantics_match_profile=same & F.col("can_embed").isNotNull(), child_chunk_count_matches=zero("n_mapped") == n,
        vector_count_matches=(zero("n_vectors") == n) & (F.col("vector_count") == n), dimension_matches=(zero("n_vectors") == 0) | ((F.col("s_low") == F.col("p_dimension")) & (F.col("s_high") == F.col("p_dimension"))),
        no_duplicate_children=zero("most") <= 1, no_missing_children=(zero("unknown") == 0) & (zero("missing") == 0),
        mapping_complete=((n == 0) & (zero("places") == 0)) | ((F.col("low") == 0) & (F.col("high") == n - 1) & (F.col("places") == n) & (zero("n_mapped") == n)),
        content_hashes_match=zero("drifted") == 0, checksums_present=F.col("has_checksums") & (zero("bare") == 0),
    )


def activation(bundles: DataFrame, runs: DataFrame, targets: DataFrame, profiles: DataFrame) -> DataFrame:
    """The five checks before a bundle is switched on: bundles(bundle_id, profile_id, target_id, status, vector_count, distance_metric, checksums_verified),
    runs(bundle_id, run_status, validation_status, vector_rows, child_nodes), targets(target_id, target_active, target_table, metrics array),
    profiles(profile_id, vector_table)."""
    rows = bundles.join(runs, "bundle_id", "left").join(targets, "target_id", "left").join(profiles, "profile_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    return outcomes(
        rows, "bundle_id", embedding_bundle_sealed=F.col("status") == "sealed", indexing_run_completed=(F.col("run_status") == "completed") & (F.col("validation_status") == "passed"),
        indexing_target_compatible=F.col("target_active") & (F.col("target_table") == F.col("vector_table")) & F.array_contains("metrics", F.col("distance_metric")),
        node_and_vector_counts_match=(count("vector_rows") == F.col("vector_count")) & (count("child_nodes") == F.col("vector_count")), artifact_checksums_match=F.col("checksums_verified"),
    )


ENGINE = ("provider", "model", "dimension", "normalization")


def mismatches(profiles: DataFrame, engines: DataFrame) -> DataFrame:
    """(profile_id, field, expected, observed): where the engine of a profile differs from it."""
    seen = engines.select("engine_id", *[F.col(c).alias(f"e_{c}") for c in ENGINE])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("expected"), F.col(f"e_{c}").cast("string").alias("observed")) for c in ENGINE])
    return profiles.join(seen, "engine_id").select("profile_id", F.inline(F.filter(pairs, lambda x: ~x["expected"].eqNullSafe(x["observed"]))))


def profile_report(profiles: DataFrame, engines: DataFrame, targets: DataFrame) -> DataFrame:
    """Checks of an embedding profile: profiles(profile_id, engine_id, target_id, ENGINE, model_revision, attested_revision, distance_metric, fingerprint,
    expected_fingerprint), engines(engine_id, ENGINE, revision), targets(target_id, metrics array).

    The revision holds if the engine tells the profile's, or tells none and somebody attested to it; a profile whose engine is unknown has no
    checks of the engine but that it is."""
    seen = engines.select("engine_id", F.lit(True).alias("found"), "revision", *[F.col(c).alias(f"e_{c}") for c in ENGINE])
    rows = profiles.join(seen, "engine_id", "left").join(targets, "target_id", "left")
    revision = F.when(F.col("revision").isNotNull(), F.col("revision") == F.col("model_revision")).otherwise(F.col("attested_revision") == F.col("model_revision"))
    checks = outcomes(
        rows.withColumn("found", F.coalesce("found", F.lit(False))), "profile_id", engine_resolved=F.col("found"), **{f"{c}_matches": F.col(c) == F.col(f"e_{c}") for c in ENGINE}, revision_matches=revision,
        target_metric_supported=F.array_contains("metrics", F.col("distance_metric")), fingerprint_matches=F.col("fingerprint") == F.col("expected_fingerprint"),
    )
    unknown = rows.where("found is null").select("profile_id", F.lit(True).alias("_unknown"))
    of_engine = F.col("check").isin(*[f"{c}_matches" for c in ENGINE], "revision_matches")
    return checks.join(unknown, "profile_id", "left").where(~(of_engine & F.coalesce("_unknown", F.lit(False)))).drop("_unknown")


def revision_source(profiles: DataFrame, engines: DataFrame) -> DataFrame:
    """(profile_id, revision_source): observed if the engine tells its revision, attested if somebody vouches for it, else unproven."""
    rows = profiles.join(engines.select("engine_id", "revision"), "engine_id", "left")
    return rows.select("profile_id", F.when(F.col("revision").isNotNull(), "observed").when(F.col("attested_revision").isNotNull(), "attested").otherwise("unproven").alias("revision_source"))


@dataclass(frozen=True)
class Bounds:
    """What a chunking profile allows."""

    profile_id: str
    child_max: int
    overlap_min: int
    overlap_max: int
    allowed_reasons: tuple[str, ...] = ()


def chunk_violations(documents: DataFrame, parents: DataFrame, children: DataFrame, bounds: Bounds, blocks: DataFrame | None = None) -> DataFrame:
    """(document_id, rule, n) of documents(document_id), parents(document_id, parent_id, profile_id, block_ids array), children(document_id, child_id,
    parent_id, profile_id, token_count, overlap_previous, overlap_next, reasons array): rules of a document's chunks that do not hold, and how often.

    blocks(document_id, block_id): parents may name only blocks of their document."""
    every = documents.select("document_id").distinct()
    lone = lambda rows, rule: every.join(rows.select("document_id").distinct(), "document_id", "left_anti").select("document_id", F.lit(rule).alias("rule"), F.lit(1).cast("bigint").alias("n"))
    count = lambda rows, rule: rows.groupBy("document_id").agg(F.count("*").alias("n")).select("document_id", F.lit(rule).alias("rule"), "n")
    twice = lambda rows, c: rows.withColumn("_r", F.row_number().over(Window.partitionBy("document_id", c).orderBy(c))).where("_r > 1")
    outside = lambda c: (F.col(c) > 0) & ~F.col(c).between(bounds.overlap_min, bounds.overlap_max)
    allowed = F.array(*[F.lit(x) for x in bounds.allowed_reasons]).cast("array<string>")
    known = parents.select("document_id", "parent_id").distinct()
    found = [
        lone(parents, "no_parents"), lone(children, "no_children"), count(twice(parents, "parent_id"), "parent_twice"), count(twice(children, "child_id"), "child_twice"),
        count(parents.where(F.col("profile_id") != bounds.profile_id), "parent_profile"), count(children.where(F.col("profile_id") != bounds.profile_id), "child_profile"),
        count(children.join(known, ["document_id", "parent_id"], "left_anti"), "child_parent"), count(children.where(F.col("token_count") > bounds.child_max), "child_tokens"),
        count(children.where(outside("overlap_previous") | outside("overlap_next")), "overlap_tokens"), count(children.where(F.size(F.array_except("reasons", allowed)) > 0), "overlap_reasons"),
    ]
    if blocks is not None:
        named = parents.select("document_id", "parent_id", F.explode("block_ids").alias("block_id"))
        strange = named.join(blocks.select("document_id", "block_id").distinct(), ["document_id", "block_id"], "left_anti")
        found.append(count(strange.select("document_id", "parent_id").distinct(), "parent_blocks"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def golden_contract(expected: DataFrame, summaries: DataFrame, texts: DataFrame, *, exact: list[str], least: dict[str, str]) -> DataFrame:
    """(document_id, rule) of expected(document_id, exact fields, least values, required_reasons array, literals array) that summaries(document_id, exact
    fields, counts, reasons array) and the texts(document_id, text) of all parts do not keep. A null expectation asks nothing.

    exact: fields that must be equal; least: count to the column of its least value. A document without a summary has the one rule missing."""
    mine = summaries.select("document_id", F.lit(True).alias("_have"), *[F.col(c).alias(f"_{c}") for c in [*exact, *least]], F.col("reasons").alias("_reasons"))
    rows = expected.join(mine, "document_id", "left")
    rules = [F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in exact]
    rules += [F.when(F.col(low).isNotNull() & (F.coalesce(f"_{c}", F.lit(0)) < F.col(low)), F.lit(f"{c}_min")) for c, low in least.items()]
    rules.append(F.when(F.size(F.array_except(F.coalesce("required_reasons", F.array().cast("array<string>")), F.coalesce("_reasons", F.array().cast("array<string>")))) > 0, F.lit("reasons")))
    told = rows.select("document_id", F.explode(F.when(F.col("_have").isNull(), F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(*rules)))).alias("rule"))
    # a literal must stand in one of the document's texts
    wanted = expected.join(summaries.select("document_id"), "document_id", "left_semi").select("document_id", F.explode("literals").alias("literal")).distinct()
    held = wanted.join(texts.select("document_id", "text"), "document_id").where(F.contains("text", F.col("literal"))).select("document_id", "literal").distinct()
    lost = wanted.join(held, ["document_id", "literal"], "left_anti").select("document_id", F.concat(F.lit("literal:"), "literal").alias("rule"))
    return told.unionByName(lost)


def variant_gates(requests: DataFrame, processing: DataFrame, chunking: DataFrame, bindings: DataFrame, active: DataFrame) -> DataFrame:
    """(request_id, reason) of requests(request_id, project_id, processing_id, chunking_id, version, binding_key, embedding_profile_id, allow_unverifiable, recipe):
    the first reason that bars a new variant, empty if none. processing(processing_id, project, status), chunking(chunking_id, project),
    bindings(project_id, version, binding_key, bound_profile_id), active(project_id, recipe)."""
    p = processing.select("processing_id", F.col("project").alias("p_project"), F.col("status").alias("p_status"))
    c = chunking.select("chunking_id", F.col("project").alias("c_project"))
    rows = requests.join(p, "processing_id", "left").join(c, "chunking_id", "left").join(bindings, ["project_id", "version", "binding_key"], "left")
    rows = rows.join(active.select("project_id", "recipe").distinct().withColumn("_same", F.lit(True)), ["project_id", "recipe"], "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col("project_id"))
    reason = (
        F.when(differs("p_project"), "processing_of_other_project").when(differs("c_project"), "chunking_of_other_project").when((F.col("p_status") == "unverifiable") & ~F.col("allow_unverifiable"), "unverifiable_revision")
        .when(~F.col("bound_profile_id").eqNullSafe(F.col("embedding_profile_id")), "incompatible_binding").when(F.col("_same"), "recipe_already_active").otherwise("")
    )
    return rows.select("request_id", reason.alias("reason"))
