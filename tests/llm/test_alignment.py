"""Token alignment against whole texts encoded by the two libraries."""

import collections
import hashlib
import random
import re

import pyarrow as pa
import pytest

from evidara.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, a int, b int, n long, base long, docs string, share int, n_best long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, 7, 7, "x", 7, 7) for r in rows], SCHEMA)


def letters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=B), letters()


def plain(docs, libraries):
    one, two, back = libraries
    groups, links = {}, collections.Counter()
    for i, text in docs.items():
        groups[i] = None
        if not text:
            continue
        a = one.encode(" " + text, add_special_tokens=False).ids
        b = two.encode(text)
        spell_a = [bytes(back[c] for c in one.id_to_token(x)) for x in a]
        spell_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(two.id_to_piece, b)]
        if b"".join(spell_a) != (" " + text).encode() or b"".join(spell_b) != (" " + text).encode():
            continue
        out, x, y, at, bt, ga, gb = [], 0, 0, 0, 0, [], []
        while x < len(a) or y < len(b):
            if at <= bt and x < len(a):
                ga.append(a[x])
                at += len(spell_a[x])
                x += 1
            else:
                gb.append(b[y])
                bt += len(spell_b[y])
                y += 1
            if at == bt and ga and gb:
                out.append((ga, gb))
                ga, gb = [], []
        groups[i] = (len(a), len(b), out)
        links.update((p[-1], q[-1]) for p, q in out)
    best = collections.defaultdict(int)
    for (_, q), n in links.items():
        best[q] = max(best[q], n)
    rows = {}
    for i, g in groups.items():
        if g is None:
            rows[i] = (0, 0, 0, 0, 0, 0, "")
            continue
        pairs = [(p[-1], q[-1]) for p, q in g[2]]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g[2])
        rows[i] = (g[0], g[1], len(pairs), len(pairs), sum(links[x] == best[x[1]] for x in pairs), sum(links[x] for x in pairs), hashlib.sha256(text.encode()).hexdigest())
    return rows


def corpus():
    rng = random.Random(3)
    alphabet = "aaabcdeehiinnoorsttu" * 3 + "  \n\t.,'\"0159éñ漢字🙂́ ﬁÅ<|>_"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 400))) for _ in range(120)]
    texts += ["the same text again, and again.  Twice"] * 60 + [None, "", " ", "   ", "\n", "x", " lead", "trail ", "a  b   c    d", "<|endoftext|> and <s> </s> <unk>", "under▁score", "nul\x00byte", "it's we'll", "<0x0A>"]
    return {11 * i - 40: t for i, t in enumerate(texts)} | {2**40: "far id", 2**41: "far id", -(2**50): "the same text again, and again.  Twice"}


def rows(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


@pytest.mark.parametrize("shares,size,held", ((4, 2 << 20, 1 << 21), (100, 300, 50)))
def test_against_the_definition(spark, libraries, monkeypatch, shares, size, held):
    """Also in small slices and pieces, with ids dealt into many shares, and with a buffer that is flushed often."""
    monkeypatch.setattr(alignment, "SLICE", size)
    monkeypatch.setattr(alignment, "BUFFER", held)
    docs = corpus() | {5: "some words in a rather long text, to be cut in pieces " * 40}
    got = alignment.align(frame(spark, [*docs.items(), (None, "no id"), (5, docs[5])]).repartition(3), A, B, shares=shares)
    assert rows(got) == plain(docs, libraries)


def test_cuts():
    import numpy as np

    data = np.frombuffer((" " + "word " * 50 + "-" * 500 + " more words" * 20).encode(), np.uint8)
    cuts = alignment._cuts(data, 64)
    assert cuts[0] == 0 and cuts[-1] == len(data) and len(cuts) > 5 and all(x < y for x, y in zip(cuts, cuts[1:], strict=False))
    assert all(chr(data[c]) == " " and chr(data[c - 1]).isalpha() and chr(data[c + 1]).isalpha() for c in cuts[1:-1])


def test_parts_give_the_ids_of_whole_texts(libraries):
    one, two, _ = libraries
    texts = [t for t in corpus().values() if t and "▁" not in t]
    aligner = alignment.Aligner(A, B)
    column = pa.array([(" " + t).encode() for t in texts], pa.large_binary())
    for kind, want in ((aligner.a, [one.encode(" " + t, add_special_tokens=False).ids for t in texts]), (aligner.b, [two.encode(t) for t in texts])):
        ids, bounds = kind.encode(column)
        assert [ids[x : y - 1].tolist() for x, y in zip(bounds[:-1], bounds[1:], strict=True)] == want


def test_empty(spark):
    assert alignment.align(frame(spark, []), A, B).count() == 0
    assert rows(alignment.align(frame(spark, [(1, None), (2, "")]), A, B)) == dict.fromkeys((1, 2), (0, 0, 0, 0, 0, 0, ""))
