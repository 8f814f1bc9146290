"""The longest similar stretch of a benchmark item, against brute force over substituted items."""

import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from evidara.llm import decontamination
from tests.llm.test_llm_operators import docs


def test_longest_stretch_is_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        n, rate, start = rng.randint(1, 40), rng.choice((0.1, 0.2, 0.3)), rng.randint(-5, 5)
        item = np.arange(n, dtype=np.uint64)
        tokens = np.concatenate([np.full(max(0, start), 999, np.uint64), item[max(0, -start) :], np.full(3, 999, np.uint64)])
        tokens[np.array([rng.random() < rate for _ in tokens], bool)] = 999
        a, b = max(0, -start), min(n, len(tokens) - start)
        same = [item[i] == tokens[start + i] for i in range(a, b)]
        want = max((j - i for i in range(len(same)) for j in range(i + 1, len(same) + 1) if 10 * sum(same[i:j]) >= 8 * (j - i)), default=0)
        begin, end = decontamination.longest(np.array(same, dtype=bool), Fraction(4, 5))
        assert end - begin == want and 10 * sum(same[begin:end]) >= 8 * want


def brute(docs_, items):
    """Overlaps of whole texts: on every diagonal the longest stretch, then those beside it, by trying all."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda x: x.group().lower(), t or ""))
    out = set()
    for d, text in docs_:
        tokens = words(text)
        for i, other in items:
            item = words(other)
            least = min(13, max(5, len(item)))
            for line in range(-len(item) + 1, len(tokens)):
                low, high = max(0, -line), min(len(item), len(tokens) - line)
                spans = [(low, high)]
                while spans:
                    a, b = spans.pop()
                    good = [(y - x, -x) for x in range(a, b) for y in range(x + least, b + 1) if 5 * sum(item[k] == tokens[line + k] for k in range(x, y)) >= 4 * (y - x)]
                    if good:
                        n, x = max(good)
                        same = [k for k in range(-x, -x + n) if item[k] == tokens[line + k]]
                        out.add((d, i, same[0], line + same[0], same[-1] - same[0] + 1, len(same), len(item)))
                        spans += [(a, -x), (-x + n, b)]
    return out


@pytest.mark.parametrize("few", [2_000_000, 0])
def test_overlaps_are_brute_force(spark, monkeypatch, few):
    """Substituted copies of items, whole and in part, two overlaps on one diagonal; broadcast seeds and dealt ones."""
    monkeypatch.setattr(decontamination, "FEW", few)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((5, 6, 7, 9, 12, 13, 14, 20, 35, 60, 60))]
    rows = []
    for d in range(150):
        words = items[rng.randrange(len(items))][1].split()
        rate = rng.choice((0, 0.05, 0.1, 0.15, 0.25))
        words = [rng.choice(vocabulary) if rng.random() < rate else x for x in words]
        if d % 5 == 0 and len(words) > 40:
            words[20:32] = rng.sample(vocabulary, 12)
        a, b = sorted((rng.randint(0, 6), len(words) - rng.randint(0, 6))) if d % 2 else (0, len(words))
        rows.append((d, " ".join([*rng.sample(vocabulary, rng.randint(0, 9)), *words[a:b], *rng.sample(vocabulary, rng.randint(0, 9))])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontamination.contaminated(docs(spark, rows), bench).collect()}
    assert got == brute(rows, items)


@pytest.mark.parametrize("n", range(5, 14))
def test_every_item_or_window_with_its_substitutions_holds_a_seed(n):
    """Whole items of up to 13 tokens with a fifth of them substituted, wherever: some mask has all its counted positions left."""
    masks = decontamination.MASKS + (decontamination.SHORT_MASKS if n < decontamination.SHORT_ITEM else ())
    for gone in itertools.combinations(range(n), n // 5):
        assert any(all(m[k] == "0" or p + k not in gone for k in range(len(m))) for m in masks for p in range(n - len(m) + 1)), gone


@pytest.mark.parametrize("n,at", [(50, range(4, 50, 5)), (18, (4, 9, 14)), (15, (4, 10)), (13, (4,))])
def test_spread_substitutions_count(spark, n, at):
    item = [f"w{i}" for i in range(n)]
    copy = [f"x{i}" if i in at else x for i, x in enumerate(item)]
    rest = [f"v{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = [(1, " ".join(rest + copy + rest[::-1])), (2, " ".join(rest)), (3, " ".join(copy)), (4, " ".join(rest[:9] + item[:5] + rest[9:]))]
    got = {r.doc_id: r for r in decontamination.contaminated(docs(spark, rows), bench).collect()}
    assert set(got) == {1, 3}
    assert all(r.n_tokens >= n - 1 and r.n_matches == n - len(at) for r in got.values())


@pytest.mark.parametrize("n", [5, 6])
def test_short_items_with_any_one_substitution(spark, n):
    item = [f"w{i}" for i in range(n)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = [(k, " ".join(f"x{i}" if i == k else x for i, x in enumerate(item))) for k in range(n)]
    assert {r.doc_id for r in decontamination.contaminated(docs(spark, rows), bench).collect()} == set(range(n))
