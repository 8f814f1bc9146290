"""The digest of a table is over its ordered row digests."""

import hashlib
import random
from itertools import groupby

from evidara.operators import checks
from evidara.plans import registry


def test_ordered_digest(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 500), rng.choice("abc")) for _ in range(900)] + [(None, None)] * 3
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    each = sorted(md5("|".join("~" if x is None else str(x) for x in row)) for row in rows)
    want = md5("".join(md5("".join(part)) for _, part in groupby(each, lambda m: m[:3])))
    df = spark.createDataFrame(rows, "k int, v string")
    for given in (df, df.repartition(7, "v")):
        assert tuple(checks.ordered_digest(given, ["k", "v"]).first()) == (want, 903)


def test_table_digest_orders_all_rows():
    from evidara.plans import checking  # noqa: F401

    assert "string_agg(m, '' ORDER BY m)" in registry.SQL["table_digest"]
