"""Long values are found, hashed and redacted to their end."""

import hashlib
import random

import pytest

from evidara.llm import secrets
from tests.llm.test_llm_operators import docs


@pytest.mark.parametrize("size", [201, 1000, 100_000])
def test_long_values_are_whole(spark, size):
    rng = random.Random(size)
    value = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(size))
    late = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size)) + "1"
    rows = [(1, f'api_key = "{value}" here'), (2, f"token={value}; more"), (3, f"see {late} here"), (4, f"AKIA{value} end")]
    found = secrets.candidates(docs(spark, rows))
    got = {(r.doc_id, r.start, r.candidate) for r in found.collect()}
    assert got == {(1, 11, value), (2, 6, value), (3, 4, late), (4, 0, "AKIA" + value)}
    marked = found.selectExpr("doc_id", "text_hash", "start", "length(candidate) AS length", "true AS is_secret")
    assert [r.text for r in secrets.redact(docs(spark, rows), marked).orderBy("doc_id").collect()] == ['api_key = "[SECRET]" here', "token=[SECRET]; more", "see [SECRET] here", "[SECRET] end"]
    shas = secrets.scan(docs(spark, rows[:1]), secrets.fit(secrets.labelled_findings(spark), secrets.Learnt())).selectExpr("sha2(candidate, 256) AS s").collect()
    assert [r.s for r in shas] == [hashlib.sha256(value.encode()).hexdigest()]


def test_values_end_where_they_end(spark):
    """A quoted value at its quote, any other at white space; marks behind a bare value are not of it."""
    rows = {
        1: ('api_key="AbC9-xY7;zQ1w,Lm3nP0r5T8u" x', "AbC9-xY7;zQ1w,Lm3nP0r5T8u"), 2: ('password = "hunter2abc!!"', "hunter2abc!!"), 3: ("password: abc;def,ghi%jkl9 next", "abc;def,ghi%jkl9"), 4: ("secret='two words 99' y", "two words 99"),
        5: ("(token=abcdef123456).", "abcdef123456"), 6: ('pwd: "open end abc', None), 7: ('token: "abc123def\nmore"', "abc123def"), 8: ("see --a1b2c3d4e5f6a7b8c9d0 there", "a1b2c3d4e5f6a7b8c9d0"),
    }
    df = docs(spark, [(i, t) for i, (t, _) in rows.items()])
    found = secrets.candidates(df)
    got = {r.doc_id: r.candidate for r in found.collect()}
    assert got == {i: v for i, (_, v) in rows.items() if v}
    marked = found.selectExpr("doc_id", "text_hash", "start", "length(candidate) AS length", "true AS is_secret")
    assert {r.doc_id: r.text for r in secrets.redact(df, marked).collect()} == {i: t.replace(v, "[SECRET]") if v else t for i, (t, v) in rows.items()}


def test_long_runs_and_many_findings_take_linear_time(spark):
    import time

    began = time.time()
    rows = [(1, "a-" * 500_000), (2, "/x." * 300_000), (3, "".join(f"token=v{i}abcdef " for i in range(50_000)))]
    found = secrets.candidates(docs(spark, rows)).groupBy("doc_id").count().collect()
    assert [(r.doc_id, r["count"]) for r in found] == [(3, 50_000)] and time.time() - began < 60
