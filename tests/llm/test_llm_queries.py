"""The registered queries: SQL where there is some, the pipeline against its stages by brute force."""

import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.llm import queries, secrets

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in sorted(os.listdir(SF)):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    df, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want.select(*[f'"{c}"' for c in cols]).fetchall())


def near_groups(texts):
    """Components of texts whose sets of 5-word shingles have a Jaccard similarity of 0.8, by comparing all."""
    def shingles(t):
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda x: x.group().lower(), t))
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}

    sets = {i: shingles(t) for i, t in texts.items()}
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and group[i] != group[j] and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                    old, new = max(group[i], group[j]), min(group[i], group[j])
                    group = {k: new if v == old else v for k, v in group.items()}
    return group


def overlaps(text, items):
    """Whether any diagonal has a stretch of 13 tokens (or a whole shorter item) with 80 % equal tokens, by trying all."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda x: x.group().lower(), t or ""))
    tokens = np.array(words(text), dtype=object)
    for other in items:
        item = np.array(words(other), dtype=object)
        least = min(13, max(5, len(item)))
        common = np.isin(tokens, item)
        lines = {int(i) - int(j) for i in np.flatnonzero(common) for j in np.flatnonzero(item == tokens[i])}
        for line in lines:
            low, high = max(0, -line), min(len(item), len(tokens) - line)
            total = np.concatenate([[0], np.cumsum(np.where(item[low:high] == tokens[line + low : line + high], 1, -4))])
            if len(total) > least and (total[least:] >= np.minimum.accumulate(total[: len(total) - least])).any():
                return True
    return False


def test_pipeline(spark, tmp_path):
    """Every stage by brute force on what its predecessor kept; redaction by the findings, pieces by the tokenizers library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    # the table with some documents that hold secrets, near copies, and a letterless text
    words = lambda i: " ".join(hashlib.md5(f"{i} {k}".encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))[:7] for k in range(60))
    more = [(10**6 + i, f'{words(i // 2)} token = "{hashlib.sha1(str(i // 2).encode()).hexdigest()}" {"tail" * (i % 2)}', "en", "src1", 1) for i in range(8)] + [(10**6 + 99, "12 34", None, None, 5)]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    table.unionByName(spark.createDataFrame(more, table.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    os.symlink(f"{SF}/benchmark.parquet", tmp_path / "benchmark.parquet")
    folder = f"file://{tmp_path}"
    got = corpus_pipeline.run(spark, folder).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    group = near_groups(kept)
    assert any(i != g for i, g in group.items())
    kept = {i: t for i, t in kept.items() if group[i] == i and not overlaps(t, bench)}
    assert {r.doc_id for r in got} == set(kept) and len(kept) < len(docs)
    left = spark.read.parquet(f"{folder}/documents.parquet").where(F.col("doc_id").isin(list(kept)))
    found = secrets.scan(left, secrets.fit(secrets.labelled_findings(spark), secrets.learn(left))).where("is_secret").collect()
    assert len(found) == 4
    for f in sorted(found, key=lambda f: -f.start):
        t = kept[f.doc_id]
        assert docs[f.doc_id][f.start : f.start + f.length] == f.candidate
        kept[f.doc_id] = t[: f.start] + "[SECRET]" + t[f.start + f.length :]
    assert not [i for i, t in kept.items() if re.search('token = "[0-9a-f]{40}"', t, re.I)]
    tokenizer, seen = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), collections.Counter()
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], dtype="<u4") for i, t in kept.items()}
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in ids.items()}


def test_stages_keep_the_columns_of_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
