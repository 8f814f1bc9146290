"""The stateful ledger: equal to the batch rules, and whole after a stop and a replay."""

import datetime
import os
import random

from pyspark.sql import functions as F

from evidara.operators import ledger
from evidara.streaming import stateful

SCHEMA = "event_id bigint, at timestamp, account string, request string, fingerprint string, amount double"


def files(folder, n=4):
    """Files of events in order of time, written one by one with rising modification times."""
    import pandas as pd

    rng, at = random.Random(3), datetime.datetime(2024, 1, 1)
    for f in range(n):
        rows = []
        for i in range(60):
            at += datetime.timedelta(seconds=rng.randint(0, 50))
            rows.append((100 * f + i, at, f"a{rng.randint(0, 4)}", f"r{rng.randint(0, 25)}", f"f{rng.randint(0, 2)}", float(rng.randint(1, 9))))
        df = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])
        df["at"] = df["at"].astype("datetime64[us]")
        df.to_parquet(f"{folder}/{f}.parquet")
        os.utime(f"{folder}/{f}.parquet", (1_700_000_000 + f, 1_700_000_000 + f))


def plain(events):
    """Outcomes by the batch ledger's rule, and running sums of what was fresh."""
    rows = events.select("*", F.concat_ws("/", "account", "request").alias("key"), F.col("event_id").alias("request_id"))
    judged = ledger.idempotency(rows).collect()
    spent, n, out = {}, {}, {}
    for r in sorted(judged, key=lambda r: (r["at"], r.event_id)):
        if r.outcome == "fresh":
            spent[r.account] = spent.get(r.account, 0.0) + r.amount
            n[r.account] = n.get(r.account, 0) + 1
        out[r.event_id] = (r.account, r.outcome, spent[r.account], n[r.account])
    return out


def test_stop_and_replay(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    files(tmp_path / "in")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    try:
        source, root, checkpoint = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
        stream = lambda: stateful.outcomes(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
        stateful.start(stream(), root, checkpoint).awaitTermination()
        rows = lambda: {r.event_id: (r.account, r.outcome, r.spent, r.n) for r in stateful.stored(spark, root).where("event_id >= 0").collect()}
        want = plain(spark.read.schema(SCHEMA).parquet(source))
        assert rows() == want and stateful.stored(spark, root).where("event_id >= 0").count() == len(want) == 240
        # the last batch with data was not committed: it comes again, under its number
        commits = sorted((int(x) for x in os.listdir(tmp_path / "checkpoint" / "commits") if x.isdigit()))
        for number in commits[3:]:
            for name in (str(number), f".{number}.crc"):
                if os.path.exists(tmp_path / "checkpoint" / "commits" / name):
                    os.remove(tmp_path / "checkpoint" / "commits" / name)
        stateful.start(stream(), root, checkpoint).awaitTermination()
        assert rows() == want and stateful.stored(spark, root).where("event_id >= 0").count() == 240
        # days later the accounts have closed, with their totals
        import pandas as pd

        late = pd.DataFrame([(9000 + i, datetime.datetime(2024, 2, 1 + 9 * i), "late", f"x{i}", "f", 1.0) for i in range(2)], columns=[x.split()[0] for x in SCHEMA.split(", ")])
        late["at"] = late["at"].astype("datetime64[us]")
        for i in range(2):
            late[i : i + 1].to_parquet(tmp_path / "in" / f"late{i}.parquet")
            os.utime(tmp_path / "in" / f"late{i}.parquet", (1_700_000_100 + i, 1_700_000_100 + i))
        stateful.start(stream(), root, checkpoint).awaitTermination()
        closed = {r.account: (r.spent, r.n) for r in stateful.stored(spark, root).where("outcome = 'closed' and account <> 'late'").collect()}
        last = {}
        for i in sorted(want):
            last[want[i][0]] = want[i][2:]
        assert closed == last
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)


def test_event_rows_have_all_fields(spark):
    got = stateful.event_rows(spark.createDataFrame([("failed", {"api_key": "x", "n": "1"}, "at /home/u/x.py"), ("done", None, None)], "status string, context map<string,string>, exception_trace string")).collect()
    assert len(got[0]) == len(stateful.EVENT.replace("map<string,string>", "m").replace("map<string,double>", "m").split(", ")) and [r.level for r in got] == ["error", "info"]
    assert got[0].context == {"api_key": "***redacted***", "n": "1"} and got[1].context == {} and "/home" not in got[0].exception_trace and got[0].schema_version == "1.0"
