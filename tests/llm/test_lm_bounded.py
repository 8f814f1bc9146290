"""LM scoring holds no filter whole: n-grams go to their blocks, a few at a time, and no broadcast grows with the corpus."""

import numpy as np
from pyspark.sql import functions as F

from evidara.llm import lm_scoring as lm
from tests.llm.test_lm_scoring import compare, corpus, frame, plain


def refused(self, value):
    raise AssertionError("the filter is broadcast")


def test_scores_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lm, "BITS", 400_000)
    monkeypatch.setattr(lm, "SIZED_BY", 1)
    monkeypatch.setattr(lm, "AT_ONCE", 50, raising=False)
    monkeypatch.setattr(lm, "BATCH", 3000, raising=False)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    docs = corpus(60) | {6: "a long text of words that goes on and on " * 30}
    got = lm.score(frame(spark, [*docs.items(), (None, "no id")]).repartition(3), size=300, round_blocks=1)
    compare(got, plain(docs), 1e-9)


def test_levels_are_those_of_the_whole_filter(spark):
    docs = [(i, " ".join(str(j * j % (7 + i)) for j in range(300))) for i in range(40)]
    table = lm.token_slices(frame(spark, docs).repartition(3).withColumn("held", F.col("doc_id") % 5 == 0), "held", size=2000)
    whole = np.frombuffer(b"".join(bytes(r.bits) for r in sorted(lm.filter_blocks(table, 3).collect())), np.uint8)
    for groups in (1, 2, 3):
        names = {(r["slice"], r.group): r.names for r in lm.named(table, 3, groups).collect()}
        found = {(r["slice"], r.group): np.frombuffer(r.levels, np.uint8) for r in lm.look_up(table, 3, groups).collect()}
        assert set(found) == set(names) and {g for _, g in names} == set(range(groups))
        for at, raw in names.items():
            name = np.cumsum(lm.unpressed(raw, "<u8"))
            assert (np.diff(name) > 0).all()
            want = lm._probed(name & np.uint64((1 << 40) - 1), (name >> np.uint64(40)).astype(np.int64) * (lm.BLOCK // 8), whole)
            assert (found[at] == want).all() and found[at].max() > 1
