"""Ledger queries: events stand for usage entries, runs and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.operators import ledger as L
from evidara.plans.registry import query, table
from evidara.streaming import stateful


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("""
SELECT event_type AS capability, provider, round(sum(value), 4) AS credits, count(*) AS n, count(DISTINCT user_id) AS documents
FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'cloud' ELSE 'local' END AS provider FROM events) GROUP BY GROUPING SETS ((), (event_type), (provider))
""")
def usage_ledger_rollup(spark, sf_dir):
    usage = events(spark, sf_dir).select(F.col("event_type").alias("capability"), F.when(F.col("user_id") % 2 == 0, "cloud").otherwise("local").alias("provider"), F.col("value").alias("credits"), F.col("user_id").alias("document_id"))
    return L.usage_rollup(usage)


@query("""
SELECT event_id, spent, round(2000.0 - spent, 4) AS remaining, spent > 2000 AS over FROM (
  SELECT event_id, round(sum(CASE WHEN event_id % 3 = 0 THEN 10.0 ELSE value END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS spent FROM events)
""")
def credit_budget(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("event_id").alias("entry_id"), F.col("user_id").alias("document_id"), F.col("ts").alias("at"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("actual"), F.lit(10.0).alias("estimated"))
    return L.budget(rows, 2000.0).select(F.col("entry_id").alias("event_id"), "spent", "remaining", "over")


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_key(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id", F.round("value", 6).alias("value"))
    return L.latest(rows, ["user_id", "event_type"], F.col("ts"), F.col("event_id")).drop("ts")


@query("""
SELECT event_id AS request_id, CASE WHEN k = 1 THEN 'fresh' WHEN event_type IS NOT DISTINCT FROM f THEN 'replay' ELSE 'conflict' END AS outcome FROM (
  SELECT event_id, event_type, row_number() OVER w AS k, first_value(event_type) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id, CAST(floor(value / 5) AS BIGINT) ORDER BY ts, event_id))
""")
def idempotency_replay(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("value") / 5).cast("string")).alias("key"), F.col("event_type").alias("fingerprint"), F.col("ts").alias("at"), F.col("event_id").alias("request_id"))
    return L.idempotency(rows).select("request_id", "outcome")


@query("""
WITH m AS (SELECT max(ts) AS t FROM events)
SELECT event_id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 6 HOUR THEN 'failed' WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS status FROM events
""")
def run_reconcile(spark, sf_dir):
    runs = events(spark, sf_dir).select("event_id", F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"), F.col("ts").alias("at"))
    return L.reconcile(runs, "2024-01-15 00:00:00", 6).select("event_id", "status")


@query("""
WITH s AS (SELECT user_id AS job_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS i, value > 20 AS ok FROM events),
l AS (SELECT job_id, max(CASE WHEN ok THEN i END) AS last FROM s GROUP BY job_id)
SELECT job_id, (['view', 'click', 'purchase', 'done'])[coalesce(last, -1) + 2] AS next_state FROM l
""")
def job_resume(spark, sf_dir):
    states = events(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("event_type").alias("state"), (F.col("value") > 20).alias("ok"))
    return L.resume(states, ["view", "click", "purchase"]).select("job_id", "next_state")


_STATUSES = ("ok", "failed", "skipped", "needs_review", "error", "warning", "processed")


@query(f"""
SELECT event_id, '1.0' AS schema_version, s AS status, CASE WHEN s IN ('failed', 'error') THEN 'error' WHEN s IN ('skipped', 'needs_review', 'warning') THEN 'warning' ELSE 'info' END AS level, '***redacted***' AS token, event_type AS kind, round(value, 4) AS cost
FROM (SELECT *, ['{"', '".join(_STATUSES)}'][event_id % {len(_STATUSES)} + 1] AS s FROM events)
""")
def event_log(spark, sf_dir):
    """Events of the log, with levels, versions and secrets set by the sink's rules."""
    status = F.get(F.array(*[F.lit(x) for x in _STATUSES]), (F.col("event_id") % len(_STATUSES)).cast("int"))
    rows = events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("request_id"), status.alias("status"), F.create_map(F.lit("token"), F.concat(F.lit("t"), F.col("user_id").cast("string")), F.lit("kind"), F.col("event_type")).alias("context"),
        F.create_map(F.lit("cost"), F.col("value")).alias("metrics"),
    )
    made = stateful.event_rows(rows)
    return made.select(F.col("request_id").cast("bigint").alias("event_id"), "schema_version", "status", "level", F.col("context")["token"].alias("token"), F.col("context")["kind"].alias("kind"), F.round(F.col("metrics")["cost"], 4).alias("cost"))
