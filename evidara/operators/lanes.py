"""Changes as frames: the old rows and the change give the new rows. Functions that end in ``_in`` change a stored table, and in it only the folders of the lanes that the change touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.operators import lineage


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """New rows in place of old ones of the same keys. Of new rows that repeat a key the last by ``order`` stays; without an order they must be unique."""
    if order:
        rest = [F.col(c) for c in new.columns if c not in keys]
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in new.columns])
    return old.join(new, keys, "left_anti").unionByName(new)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old, keys, "left_anti"))


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """All old rows of the scopes that the new rows name go."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new)


def activate(vectors: DataFrame, bundle: str, as_of: str) -> DataFrame:
    """Activate a bundle: other active bundles of the same documents in the lane are superseded, other documents stay as they are."""
    lane = ["project_id", "profile_id"]
    touched = vectors.where(F.col("bundle_id") == bundle).select(*lane, "document_id").distinct().withColumn("_touched", F.lit(True))
    joined = vectors.join(touched, [*lane, "document_id"], "left")
    mine = F.col("bundle_id") == bundle
    ends = F.col("_touched") & ~mine & F.col("is_active")
    return joined.withColumns(
        {"superseded_at": F.when(mine, None).when(ends, F.lit(as_of).cast("timestamp")).otherwise(F.col("superseded_at")), "is_active": F.when(mine, True).when(F.col("_touched"), False).otherwise(F.col("is_active"))}
    ).drop("_touched")


def rollback(vectors: DataFrame, current: str, previous: str, as_of: str) -> DataFrame:
    """Take back an activation: the current bundle ends, and the previous one is active again in the lanes and for the documents that the current one held
    there. Documents that another bundle has taken since, or that the current bundle never had, stay as they are; so does everything if the
    previous bundle has no rows in a lane of the current one."""
    scope = ["project_id", "profile_id", "document_id"]
    held = vectors.where((F.col("bundle_id") == current) & F.col("is_active")).select(*scope).distinct().withColumn("_held", F.lit(True))
    lanes = vectors.where(F.col("bundle_id") == previous).select(*scope[:2]).distinct().withColumn("_back", F.lit(True))
    joined = vectors.join(held, scope, "left").join(F.broadcast(lanes), scope[:2], "left")  # one row a lane of one bundle
    may = F.coalesce("_held", F.lit(False)) & F.coalesce("_back", F.lit(False))
    ends, starts = may & (F.col("bundle_id") == current), may & (F.col("bundle_id") == previous)
    return joined.withColumns(
        {"superseded_at": F.when(ends & F.col("is_active"), F.lit(as_of).cast("timestamp")).when(starts, None).otherwise(F.col("superseded_at")), "is_active": F.when(ends, False).when(starts, True).otherwise(F.col("is_active"))}
    ).select(*vectors.columns)


def only_active(rows: DataFrame, scope: list[str], key: str, chosen: DataFrame) -> DataFrame:
    """Exactly the chosen key is active in each scope that has one; other scopes stay."""
    picked = chosen.select(*scope, F.col(key).alias("_chosen"))
    return rows.join(picked, scope, "left").withColumn("active", F.when(F.col("_chosen").isNull(), F.col("active")).otherwise(F.col(key) == F.col("_chosen"))).drop("_chosen")


def seal_once(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows after the upsert, refused rows): a sealed row never changes."""
    sealed = old.where("status = 'sealed'").select(key)
    return upsert(old, new.join(sealed, key, "left_anti"), [key]), new.join(sealed, key, "left_semi")


#: Columns that name a lane; tables of lanes have a folder for each.
LANE = ("project_id", "profile_id")


def write_lanes(rows: DataFrame, path: str) -> None:
    """A new table with a folder for each lane."""
    rows.repartition(*LANE).write.partitionBy(*LANE).parquet(path)


def _swap(rows: DataFrame, path: str, expected: int) -> None:
    """Put the rows in place of the lanes they are of. They are staged and counted first; other lanes keep their files."""
    spark = rows.sparkSession
    staged = lineage.new_path(spark, "staged")
    rows.write.parquet(staged)
    ready = spark.read.schema(rows.schema).parquet(staged)
    n = ready.count()
    if n != expected:
        raise ValueError(f"{n} rows are staged for {path}, {expected} are due: nothing was changed")
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LANE).parquet(path)


def one_lane(spark: SparkSession, path: str, project: str, profile: str) -> DataFrame:
    """The rows of one lane; the filter picks its folder."""
    return spark.read.parquet(path).where((F.col("project_id") == project) & (F.col("profile_id") == profile))


def activate_in(spark: SparkSession, path: str, project: str, profile: str, bundle: str, as_of: str) -> int:
    """``activate`` for a lane of a stored table; returns how many rows the bundle has active there. Only that lane is read and written."""
    lane = one_lane(spark, path, project, profile)
    _swap(activate(lane, bundle, as_of).select(*lane.columns), path, lane.count())
    return one_lane(spark, path, project, profile).where((F.col("bundle_id") == bundle) & F.col("is_active")).count()


def rollback_in(spark: SparkSession, path: str, project: str, profile: str, current: str, previous: str, as_of: str, bundles: DataFrame) -> int:
    """``rollback`` for a lane of a stored table, if the bundles allow it; returns how many rows are active afterwards. Only that lane is read and written."""
    asked = spark.createDataFrame([(current, previous)], "current string, previous string")
    reason = rollback_reasons(asked, bundles).first()["reason"]
    if reason:
        raise ValueError(f"cannot roll back from {current} to {previous}: {reason}")
    lane = one_lane(spark, path, project, profile)
    _swap(rollback(lane, current, previous, as_of).select(*lane.columns), path, lane.count())
    return one_lane(spark, path, project, profile).where(F.col("is_active")).count()


def rollback_reasons(requests: DataFrame, bundles: DataFrame) -> DataFrame:
    """requests(current, previous) with ``reason``: the first that stands against going back, else empty. bundles(bundle_id, is_sealed, profile_id, corpus_version)."""
    side = lambda name: bundles.select(F.col("bundle_id").alias(name), *[F.col(c).alias(f"_{name}_{c}") for c in ("is_sealed", "profile_id", "corpus_version")], F.lit(True).alias(f"_{name}"))
    both = requests.join(side("current"), "current", "left").join(side("previous"), "previous", "left")
    other = lambda c: ~F.col(f"_previous_{c}").eqNullSafe(F.col(f"_current_{c}"))
    reason = F.when(F.col("_current").isNull() | F.col("_previous").isNull(), "unknown_bundle").when(~F.coalesce("_previous_is_sealed", F.lit(False)), "previous_not_sealed").when(other("profile_id"), "other_profile")
    return both.select(*requests.columns, reason.when(other("corpus_version"), "other_corpus_version").otherwise("").alias("reason"))


def _touched(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows of the lanes that new rows are of: folders of other lanes are pruned as the query runs."""
    return old.join(new.select(*LANE).distinct(), list(LANE), "left_semi")


def upsert_in(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: str | None = None) -> None:
    """``upsert`` into a stored table. Lanes without new rows are neither read nor written. The keys hold the lane's columns."""
    old = _touched(spark.read.parquet(path), new)
    fresh = new.select(*keys).distinct().join(old, keys, "left_anti").count()
    merged = upsert(old, new.select(*old.columns) if order is None or order in old.columns else new, keys, order)
    _swap(merged.select(*old.columns), path, old.count() + fresh)


def replace_in(spark: SparkSession, path: str, new: DataFrame, scope: list[str]) -> None:
    """``replace_scope`` in a stored table; the scope holds the lane's columns."""
    old = _touched(spark.read.parquet(path), new)
    kept = old.join(new.select(*scope).distinct(), scope, "left_anti")
    _swap(kept.unionByName(new.select(*old.columns)), path, kept.count() + new.count())
