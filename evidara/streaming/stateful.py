"""The ledger with state a key: budgets, first requests and open accounts kept between batches, and a sink in which a replayed batch adds nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from evidara.functions import text as T

#: The fields of an event of the log, and the levels of its states.
EVENT = (
    "schema_version string, timestamp timestamp, run_id string, request_id string, document_id string, source_path string, stage string, event string, status string, level string, provider string, capability string, job_id string, "
    "upstream_job_id string, configuration_hash string, result_count bigint, warning_count bigint, duration_ms bigint, message string, warning_code string, exception_type string, exception_trace string, context map<string,string>, "
    "metrics map<string,double>, attributes map<string,string>"
)
LEVELS = {"error": ("failed", "error"), "warning": ("skipped", "needs_review", "warning")}
VERSION = "1.0"
#: What the ledger says of every request, and of an account that it closes.
OUTCOMES = "account string, event_id bigint, at timestamp, outcome string, spent double, n bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def level(status: F.Column) -> F.Column:
    out = F.when(F.lit(False), "")
    for name, states in LEVELS.items():
        out = out.when(status.isin(*states), name)
    return out.otherwise("info")


def event_rows(events: DataFrame) -> DataFrame:
    """Events as the log holds them: all fields in order (null where the frame has none), the version and a level where none is given, and nothing secret in context, attributes
    and traces."""
    kinds = {x.split(" ", 1)[0]: x.split(" ", 1)[1] for x in EVENT.replace("map<string,string>", "map<string;string>").replace("map<string,double>", "map<string;double>").split(", ")}
    have = {name: F.col(name) if name in events.columns else F.lit(None) for name in kinds}
    have = {name: have[name].cast(kind.replace(";", ",")) for name, kind in kinds.items()}
    have["schema_version"] = F.coalesce(have["schema_version"], F.lit(VERSION))
    have["level"] = F.coalesce(have["level"], level(have["status"]))
    for name in ("context", "attributes"):
        have[name] = F.coalesce(F.map_from_entries(F.transform(F.map_entries(have[name]), lambda e: F.struct(e["key"], T.sanitize(e["value"], e["key"])))), F.create_map().cast("map<string,string>"))
    have["metrics"] = F.coalesce(have["metrics"], F.create_map().cast("map<string,double>"))
    have["exception_trace"] = T.error_text(have["exception_trace"])
    return events.select(*[c.alias(name) for name, c in have.items()])


class Accounts(StatefulProcessor):
    """Of an account: what it has spent, the fingerprint of each request, and a timer that closes it when no event has come for a while."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "spent double, n bigint, last bigint")
        self.first = handle.getMapState("first", "request string", "fingerprint string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spent, n, last = self.total.get() if self.total.exists() else (0.0, 0, 0)
        events = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        out = []
        for event, at, request, fingerprint, amount in zip(events["event_id"], events["at"], events["request"], events["fingerprint"], events["amount"], strict=True):
            if not self.first.containsKey((request,)):
                self.first.updateValue((request,), (fingerprint,))
                outcome, spent, n = "fresh", spent + float(amount), n + 1
            else:
                outcome = "replay" if self.first.getValue((request,))[0] == fingerprint else "conflict"
            out.append((key[0], event, at, outcome, spent, n))
            last = max(last, int(pd.Timestamp(at).timestamp() * 1000))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle_ms)
        self.total.update((spent, n, last))
        yield pd.DataFrame(out, columns=["account", "event_id", "at", "outcome", "spent", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spent, n, last = self.total.get() if self.total.exists() else (0.0, 0, 0)
        self.total.clear()
        self.first.clear()
        yield pd.DataFrame([(key[0], -1, pd.Timestamp(last, unit="ms"), "closed", spent, n)], columns=["account", "event_id", "at", "outcome", "spent", "n"])

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, *, late: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """``OUTCOMES`` of a stream of events(event_id, at, account, request, fingerprint, amount): fresh, replay or conflict of each, what its account has spent on fresh requests
    up to it, and a row ``closed`` once the watermark is past the account's last event by idle_ms. The session's state store must be ``PROVIDER``."""
    keyed = events.select(F.col("account").cast("string").alias("account"), "event_id", "at", "request", "fingerprint", "amount").withWatermark("at", late).groupBy("account")
    return keyed.transformWithStateInPandas(statefulProcessor=Accounts(idle_ms), outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime")


def replayable(root: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of folders named by their batch: a batch that comes again takes its own place."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return put


def start(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, batch by batch, into a replayable sink; the checkpoint lets the next start go on."""
    return stream.writeStream.foreachBatch(replayable(root)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stored(spark: SparkSession, root: str, schema: str = OUTCOMES) -> DataFrame:
    return spark.read.schema(f"{schema}, batch int").parquet(root)
