"""Importance resampling against its definition."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from evidara.llm import resampling
from evidara.llm.crc import extended, word_crcs
from evidara.llm.textarrays import pieces, word_spans

SCHEMA = "doc_id long, text string, weight long, score double, rank int, digest string, copies int, part int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 7.0, 7, "x", 7, 7) for r in rows], SCHEMA)


def bag(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda x: x.group().lower(), text or ""))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), collections.Counter(zlib.crc32(x.encode()) % 10000 for x in runs)


def plain(docs, target):
    bags = {i: bag(t) for i, t in docs}
    s, t = collections.Counter(), collections.Counter()
    for _, b in bags.values():
        s.update(b)
    for x in target:
        t.update(bag(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (total_s + 10000) / ((s[k] + 1) * (total_t + 10000))))
    out = {}
    for i, (n, b) in bags.items():
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(k) * v for k, v in b.items())
        out[i] = [sum(b.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i in out if bags[i][0] >= 20), key=lambda i: (-out[i][2], i))
    for rank, i in enumerate(able[: 5 * len(able) // 100], 1):
        out[i][3] = rank
    return out


def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeXYZ09é漢") for _ in range(rng.randint(1, 9))) for _ in range(200)] + ["w" * 63, "x" * 64, "y" * 200, "z" * 5000]
    texts = [rng.choice((" ", "\n", ", ", "-", "\x7f")).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [texts[3]] * 120 + [None, None, "", "  ", "...", "one", "two words", "Ångström ÉCOLE"]
    return [(7 * i - 50, t) for i, t in enumerate(texts)]


def test_against_the_definition(spark):
    docs, target = rows(), [t for _, t in rows()[20:40]] + [None, "", "one two three"]
    got = resampling.resample(frame(spark, docs + [(None, "no id")] + docs[:1]).repartition(7), frame(spark, list(enumerate(target)))).collect()
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in got} == plain(docs, target) and len(got) == len(docs)


def test_draws_and_ties(spark):
    """Equal texts have equal weights; all of them may be drawn, in one order."""
    docs = [(i, "a b c d e f g h i j k l m n o p q r s t u") for i in range(200)]
    got = {r.doc_id: r for r in resampling.resample(frame(spark, docs), frame(spark, []), percent=100).collect()}
    want = sorted(got, key=lambda i: (-got[i].score, i))
    assert [got[i]["rank"] for i in want] == list(range(1, 201)) and len({r.weight for r in got.values()}) == 1


def test_empty(spark):
    assert resampling.resample(frame(spark, []), frame(spark, [])).count() == 0
    got = resampling.resample(frame(spark, [(1, None), (2, "a")]), frame(spark, [])).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in got) == [(1, 0, None), (2, 1, None)]


@pytest.mark.parametrize("limit", (40, 4000, 1 << 20))
def test_texts_in_pieces(spark, monkeypatch, limit):
    monkeypatch.setattr(resampling, "SLICE", limit)
    data = " ".join(t for _, t in rows() if t).encode()
    parts = list(pieces(np.frombuffer(data, np.uint8), resampling.OUTSIDE, limit))
    assert b"".join(p.tobytes() for p in parts) == data and (limit > len(data) or len(parts) > 1)
    total, n, before = np.zeros(10000, int), 0, None
    for p in parts:
        bucket, _, words, before = resampling.run_buckets(p, np.array([0, len(p)]), before)
        total += np.bincount(bucket, minlength=10000)
        n += words[0]
    n_words, want = bag(data.decode())
    assert n == n_words and {k: v for k, v in enumerate(total.tolist()) if v} == dict(want)


def test_crcs_of_joined_strings():
    rng = random.Random(1)
    raw = b" ".join(bytes(rng.choices(b"abcz\xc3\xa9", k=rng.choice((1, 2, 9, 63, 64, 65, 1000)))) for _ in range(300))
    data = np.frombuffer(raw, np.uint8)
    a, b, _ = word_spans(data, np.array([0, len(data)]))
    crc = word_crcs(data, a, b)
    assert crc.tolist() == [zlib.crc32(raw[x:y]) for x, y in zip(a, b, strict=True)]
    blank = np.full(len(crc), resampling.BLANK, np.uint32)
    both = extended(crc[:-1], (b - a)[1:] + 1) ^ (extended(blank, b - a) ^ crc)[1:]
    assert both.tolist() == [zlib.crc32(raw[x:y]) for x, y in zip(a[:-1], b[1:], strict=True)]
