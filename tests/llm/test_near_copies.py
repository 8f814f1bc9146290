"""Near copies against brute-force Jaccard similarity, and the pipeline's stage with them."""

import random

import pytest

from evidara.llm import near_copies
from tests.llm.test_llm_operators import ODD, docs


def brute(rows, shingle=5, similarity=0.8):
    sets = {}
    for i, t in rows:
        if i is not None:
            w = (t or "").lower().split()
            sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and group[i] != group[j] and 10 * len(sets[i] & sets[j]) >= 10 * similarity * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if v == old else v for k, v in group.items()}
    return group


def edited(seed, n, bases):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 150))] for _ in range(bases)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 1, 2, 4, 8))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((i + 100, " ".join(words)))
    return out


@pytest.mark.parametrize("bases,sample", [(20, 20000), (3, 20000), (3, 1)])
def test_same_as_brute_force(spark, monkeypatch, bases, sample):
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    rows = edited(bases, 250, bases) + [(i and i + 1000, t) for i, t in ODD]
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs(spark, rows)).collect()}
    assert got == brute(rows)
    assert near_copies.near_copies(docs(spark, [])).count() == 0


def test_stage_keeps_one_of_near_copies(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(235)]
    near = [x if i % 60 != 30 else "other" for i, x in enumerate(words)]
    far = [x if i % 9 else "other" for i, x in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), *edited(7, 150, 12)]
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect()}
    assert {1, 3} <= got and 2 not in got and got == {i for i, c in brute(rows).items() if i == c}


def test_stage_asks_multi_index_hashing_first(spark, monkeypatch):
    """Pairs of fingerprints within two bits are checked before the prefix filter's; a pair that is not similar enough makes no link."""
    from evidara.llm import simhash

    seen = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps: seen.append(links(fps)) or seen[-1])
    same = " ".join(f"v{i}" for i in range(300))
    rows = [(1, same), (2, same + " v300"), (3, "a b c d e f"), *edited(5, 60, 6)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, rows), shingle=5, similarity=0.8).collect()}
    assert len(seen) == 1 and got == brute(rows)


def test_pair_comes_up_under_its_first_shingles(spark):
    """Parities from a shingle on: with all before it different, they bound what differs; in a group just under the threshold few pairs come through."""
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = (np.unique(np.concatenate([rng.integers(0, 1 << 63, 60, dtype=np.uint64), base])) for base in [rng.integers(0, 1 << 63, 300, dtype=np.uint64)] * 2)
        none = np.zeros((0, 0))
        x, y = (near_copies.prefix(v, none, 0.8) for v in (a, b))
        left, right = (near_copies.later(np.bitwise_xor.reduce(near_copies.parities(v).reshape(-1, near_copies.WORDS), axis=0), p.view(np.int64)) for v, p in ((a, x), (b, y)))
        i, j = min((int(np.searchsorted(x, h)), int(np.searchsorted(y, h))) for h in np.intersect1d(x, y))
        assert i + j + int(np.bitwise_count((left[i] ^ right[j]).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))
        assert np.array_equal(left[0], np.bitwise_xor.reduce(near_copies.parities(a).reshape(-1, near_copies.WORDS), axis=0))
