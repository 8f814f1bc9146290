"""Further platform operators: manifests of ordered members, stage counts, pages of lists, runtime profiles, sidecars and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import text as T
from evidara.operators import lineage

#: Page size of lists if none is asked for, and the largest.
PAGE, LARGEST_PAGE = 25, 100
#: Chunking strategies and whether they carry the section along, to the policy that runs them.
RECIPES = {
    ("structural", False): "v1", ("local-structural", False): "v1", ("local-structural-v1", False): "v1", ("local_structural_v1", False): "v1", ("local-structural-v2", True): "v2", ("local_structural_v2", True): "v2",
}


def page(rows: DataFrame, order: list[Column], *, limit: int | None = None, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(one page of rows in order, one row with the total): the page size is bounded, so only that many rows leave the sort."""
    if offset < 0 or (limit is not None and not 1 <= limit <= LARGEST_PAGE):
        raise ValueError(f"limit must lie in 1..{LARGEST_PAGE} and offset must not be negative")
    return rows.orderBy(*order).offset(offset).limit(limit or PAGE), rows.agg(F.count("*").alias("total"))


def manifests(members: DataFrame, keys: list[str], ordinal: str, fields: list[str]) -> DataFrame:
    """(keys, manifest_hash, n_members, dense): the hash of each key's members in order of their ordinal, and whether the ordinals are 0, 1, 2 ...

    Members are hashed first, so what is gathered for a key is a digest a member."""
    one = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256)
    listed = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), one.alias("d"))))
    per = members.groupBy(*keys).agg(listed.alias("m"), F.count("*").alias("n_members"), F.min(ordinal).alias("low"), F.max(ordinal).alias("high"), F.countDistinct(ordinal).alias("different"))
    return per.select(*keys, F.sha2(F.array_join(F.transform("m", lambda x: x["d"]), "\n"), 256).alias("manifest_hash"), "n_members", ((F.col("low") == 0) & (F.col("high") == F.col("n_members") - 1) & (F.col("different") == F.col("n_members"))).alias("dense"))


def build_report(outcomes: DataFrame, release: str) -> DataFrame:
    """(release, stage, reused, built, failed) of outcomes(release, stage, outcome), with a row for all stages (stage null)."""
    sets = outcomes.groupingSets([[F.col(release), F.col("stage")], [F.col(release)]], F.col(release), F.col("stage"))
    return sets.agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("reused", "built", "failed")])


def with_flag(rows: DataFrame, known: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows with whether their keys are known."""
    have = known.select(*keys).distinct().withColumn("_have", F.lit(True))
    return rows.join(have, keys, "left").withColumn(name, F.coalesce("_have", F.lit(False))).drop("_have")


def with_sidecars(artifacts: DataFrame, suffixes: dict[str, str], *, path: str = "relpath") -> DataFrame:
    """Main files with the path of each of their sidecars (name to suffix), null where there is none: paths are joined on their base name."""
    main = artifacts.where(~F.col(path).rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes.values()) + ")$"))
    for name, suffix in suffixes.items():
        other = artifacts.where(F.col(path).endswith(suffix)).select(F.col(path).alias(name))
        main = main.join(other, T.sidecar(F.col(path), suffix) == F.col(name), "left")
    return main


def relative(path: Column, root: Column | str) -> Column:
    """A path below a root without it, with / between folders; other paths stay whole."""
    base = F.regexp_replace(F.replace(root if isinstance(root, Column) else F.lit(root), F.lit("\\"), F.lit("/")), "/+$", "")
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(plain, F.concat(base, F.lit("/"))), F.substr(plain, F.length(base) + 2)).otherwise(plain)


def runtime_profiles(profiles: DataFrame) -> DataFrame:
    """profiles(profile_id, strategy, include_section_context, fingerprint, expected_fingerprint) with the policy that runs each, or why none does."""
    recipes = profiles.sparkSession.createDataFrame([(s, c, v) for (s, c), v in RECIPES.items()], "strategy string, context boolean, policy string")
    rows = profiles.withColumn("context", F.coalesce("include_section_context", F.lit(False))).join(F.broadcast(recipes), ["strategy", "context"], "left")  # len(RECIPES) rows
    whole = F.col("fingerprint").eqNullSafe(F.col("expected_fingerprint"))
    return rows.select("profile_id", F.when(whole, F.col("policy")).alias("policy"), F.when(~whole, "fingerprint_mismatch").when(F.col("policy").isNull(), "unsupported_recipe").otherwise("").alias("reason"))


def rerank(hits: DataFrame, score: Column | None = None, *, key: str = "node_id") -> DataFrame:
    """Hits with another score (by default their own) and the original one kept; ties to the smaller key."""
    return hits.withColumn("original_score", F.col("score")).withColumn("score", F.col("score") if score is None else score).orderBy(F.desc("score"), key)


def append_inactive(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored vectors and new ones, which come in inactive; a new row of stored keys takes the place of the old one and stays as active as that was."""
    n = max(lineage.parts(stored), lineage.parts(new))
    stored, new = stored.repartition(n, *keys), new.repartition(n, *keys)
    before = stored.select(*keys, F.col("is_active").alias("_was"))
    fresh = new.join(before.hint("merge"), keys, "left").withColumn("is_active", F.coalesce("_was", F.lit(False))).select(*stored.columns)
    return stored.join(new.select(*keys).distinct().hint("merge"), keys, "left_anti").unionByName(fresh)


def parents_first(nodes: DataFrame, *, key: str = "node_id", parent: str = "parent_node_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes without a parent, nodes whose parent is one of them, refused nodes): in this order no write names a row that is not there yet."""
    roots = nodes.where(F.col(parent).isNull())
    known = roots.select(F.col(key).alias(parent))
    rest = nodes.where(F.col(parent).isNotNull())
    return roots, rest.join(known, parent, "left_semi").select(*nodes.columns), rest.join(known, parent, "left_anti").select(*nodes.columns)


def percent(value: Column) -> Column:
    """A share as a percentage with one decimal, half to even."""
    return F.bround(value * 100, 1)


def duration_ms(seconds: Column) -> Column:
    """Milliseconds, never negative, half to even."""
    return F.greatest(F.lit(0).cast("bigint"), F.bround(seconds * 1000, 0).cast("bigint"))
