"""Append-only ledgers: rollups, budgets, latest rows, idempotency, resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Totals, per capability and per provider, with distinct documents, in one pass over grouping sets."""
    sets = usage.groupingSets([[], [F.col("capability")], [F.col("provider")]], F.col("capability"), F.col("provider"))
    return sets.agg(F.round(F.sum("credits"), 4).alias("credits"), F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key in the given order, as a map-side aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def budget(ledger: DataFrame, limit: float) -> DataFrame:
    """Running reservation per document in order of time: the sum of actual credits, estimated where none are known, and what is over."""
    running = Window.partitionBy("document_id").orderBy("at", "entry_id").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.round(F.sum(F.coalesce("actual", "estimated")).over(running), 4)
    return ledger.withColumn("spent", spent).withColumn("remaining", F.round(F.lit(limit) - F.col("spent"), 4)).withColumn("over", F.col("spent") > limit)


def idempotency(requests: DataFrame) -> DataFrame:
    """fresh for the first request of a key, then replay if the fingerprint is the first one's, else conflict."""
    order = Window.partitionBy("key").orderBy("at", "request_id")
    first = F.first("fingerprint").over(order)
    return requests.withColumn("outcome", F.when(F.row_number().over(order) == 1, "fresh").when(F.col("fingerprint").eqNullSafe(first), "replay").otherwise("conflict"))


def reconcile(runs: DataFrame, as_of: str, limit_hours: int) -> DataFrame:
    """Runs still marked running whose last sign of life is too old have failed."""
    stale = (F.col("status") == "running") & (F.col("at") < F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(limit_hours)))
    return runs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def resume(states: DataFrame, order: list[str]) -> DataFrame:
    """Where a job goes on: the state after the last one that succeeded, the first if none did, done at the end."""
    number = F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s), F.lit(i))])
    last = states.groupBy("job_id").agg(F.max(F.when(F.col("ok"), number[F.col("state")])).alias("last"))
    names = F.array(*[F.lit(s) for s in [*order, "done"]])
    return last.withColumn("next_state", F.element_at(names, (F.coalesce("last", F.lit(-1)) + 2).cast("int")))
