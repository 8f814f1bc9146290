"""LM scoring: the base by its definition, the filter's counts, the model by exact counts, and what it predicts."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.llm import lm_scoring as lm

SCHEMA = "doc_id long, text string, held boolean, c long, token string, slice long, block int, n int, h long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, True, 7, "x", 7, 7, 7, 7) for r in rows], SCHEMA)


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda x: x.group().lower(), text or "")), ""]


def plain(docs, order=3):
    """Base as stated; the model with exact counts, quantised only as the filter does."""
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts, grams = collections.Counter(), collections.Counter()
    for i, t in docs.items():
        if not held[i]:
            counts.update(tokens(t))
            seq = ["\n", *tokens(t)]
            grams.update(tuple(seq[j - k + 1 : j + 1]) for k in range(2, order + 1) for j in range(max(1, k - 1), len(seq)))
    n, v, starts = sum(counts.values()), len(counts), sum(not x for x in held.values())
    level = lambda c: 0 if not c else max(j for j in range(1, 90) if math.ceil(1.5 ** (j - 1) - 1e-9) <= c)
    mean = lambda j: 0 if not j else (math.ceil(1.5 ** (j - 1) - 1e-9) + math.ceil(1.5**j - 1e-9) - 1) / 2
    known = lambda w: starts if w == "\n" else counts[w]

    def history(seq, j, k):
        h = tuple(seq[j - k + 1 : j])
        if len(h) < k - 1 or j < k - 1:
            return 0, 0
        if k == 2:
            return level(known(h[0])), known(h[0])
        return level(grams[h]), mean(level(grams[h]))

    seen = collections.defaultdict(lambda: [0, 0])
    for i, t in docs.items():
        if not held[i]:
            seq = ["\n", *tokens(t)]
            for j in range(1, len(seq)):
                for k in range(2, order + 1):
                    x = seen[k, history(seq, j, k)[0]]
                    x[0] += 1
                    x[1] += j >= k - 1 and grams[tuple(seq[j - k + 1 : j + 1])] >= 2
    share = {}
    for k in range(2, order + 1):
        for j in range(1, 97):
            total, again = seen.get((k, j), (0, 0))
            share[k, j] = (again + 0.5) / (total + 1) if total else share.get((k, j - 1), 0) if j > 1 else 0
        share[k, 0] = 0
    out = {}
    for i, t in docs.items():
        seq, base, score = ["\n", *tokens(t)], 0.0, 0.0
        for j in range(1, len(seq)):
            p = (counts[seq[j]] + 1) / (n + 1 * (v + 1))
            base += math.log10(p)
            for k in range(2, order + 1):
                lv, c = history(seq, j, k)
                s = share[k, lv]
                g = grams[tuple(seq[j - k + 1 : j + 1])] if j >= k - 1 else 0
                p = s * min(mean(level(g)) / max(c, 1), 1) + (1 - s) * p
            score += math.log10(p)
        out[i] = (held[i], len(seq) - 1, sum(counts[w] > 0 for w in seq[1:]), n, base, score)
    return out


def corpus(n=150, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcDEé漢") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    texts = [rng.choice((" ", "\n", "  ")).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 50))) for _ in range(n)]
    texts += [texts[0]] * 40 + [None, "", " \t", "one", "ONE Two", "never seen words here"]
    return {5 * i - 30: t for i, t in enumerate(texts)}


def compare(got, want, tolerance):
    got = {r.doc_id: r for r in got.collect()}
    assert set(got) == set(want)
    for i, (held, n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, score, rel_tol=tolerance, abs_tol=1e-9), (i, r.score, score)


@pytest.mark.parametrize("size,order", ((4 << 20, 3), (60, 3), (500, 2)))
def test_against_exact_counts(spark, monkeypatch, size, order):
    """With many bits the filter has no false positives, so scores equal those from exact counts; texts in pieces too, blocks in rounds."""
    monkeypatch.setattr(lm, "BITS", 400_000)
    monkeypatch.setattr(lm, "SIZED_BY", 1)
    monkeypatch.setattr(lm, "NEAR", 37)
    docs = corpus() | {6: "a long text of words that goes on and on " * 30}
    got = lm.score(frame(spark, [*docs.items(), (None, "no id"), (6, docs[6])]).repartition(5), size=size, order=order, round_blocks=400)
    compare(got, plain(docs, order), 1e-9)


def test_false_positives_change_little(spark):
    docs = corpus(400)
    compare(lm.score(frame(spark, docs.items())), plain(docs), 0.02)


def test_empty_and_without_training(spark):
    assert lm.score(frame(spark, [])).count() == 0
    got = lm.score(frame(spark, [(1, "a b"), (2, None)]), held=F.lit(True)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 3, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)]


def test_levels():
    counts = np.arange(1, 5000)
    level = lm.level_of(counts)
    assert lm.level_of(np.array([0, 1, 2, 3, 4, 5, 6])).tolist() == [0, 1, 2, 3, 4, 4, 5]
    assert [lm.MEANS[j] for j in (1, 2, 3, 4)] == [1, 2, 3, 4.5] and (np.abs(lm.MEANS[level] / counts - 1) <= 0.26).all() and (np.diff(level) >= 0).all()


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    docs = [(i, " ".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=400))) for i in range(60)]
    table = lm.token_slices(frame(spark, docs).withColumn("held", F.lit(False)), "held")
    bits = {r.block: bytes(r.bits) for r in lm.filter_blocks(table, 3).collect()}
    assert set(bits) == {0, 1, 2}
    whole = np.frombuffer(b"".join(bits[i] for i in range(3)), np.uint8)
    grams = collections.Counter()
    hashes = lm._hashes(__import__("pyarrow").array([b"\n", b"", *(bytes([c]) for c in range(97, 123))]))
    name = dict(zip(["\n", "", *map(chr, range(97, 123))], hashes.tolist(), strict=True))
    for _, t in docs:
        seq = np.array([name[x] for x in ["\n", *t.split(), ""]], dtype=np.uint64)
        for h, ok in lm.grams(seq, np.arange(len(seq)), 3):
            grams.update(h[ok].tolist())
    h = np.array(list(grams), dtype=np.uint64)
    want, got = lm.level_of(np.array(list(grams.values()))), lm.probed(h, 3, 0, whole)
    assert (got >= want).all() and (got == want).mean() > 0.97
    other = np.random.default_rng(1).integers(0, 1 << 63, 20000).astype(np.uint64)
    assert (lm.probed(other, 3, 0, whole) > 0).mean() < 0.02
    # in rounds of one block each, every n-gram is found in exactly one of them
    assert (sum(lm.probed(h, 3, i, np.frombuffer(bits[i], np.uint8)).astype(int) for i in range(3)) == got).all()


def test_model_beats_its_base_on_held_out_texts(spark):
    rng = random.Random(9)
    follow = {w: rng.sample(range(40), 3) for w in range(40)}

    def text():
        w, out = rng.randrange(40), []
        for _ in range(60):
            out.append(f"w{w}")
            w = rng.choice(follow[w])
        return " ".join(out)

    got = [r for r in lm.score(frame(spark, [(i, text()) for i in range(300)])).collect() if r.held_out]
    assert len(got) > 20 and sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got) and all(r.score < 0 for r in got)

