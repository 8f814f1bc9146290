"""Language identification as multilingual mixture inference.

Each language has a distribution over hashed byte 4-grams of case-folded letters, counted from labelled texts. A
document is a mixture of languages: expectation-maximisation estimates the proportions from its n-gram counts, and
the set of languages is the one whose penalised likelihood (BIC) is best, grown one language at a time.

Results: ``und`` with score 0 for a null text or one without letters; otherwise the language with the largest
proportion (ties: the smaller name), its proportion as score, and all proportions of the chosen set. With no
labelled text at all every document is ``und``. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.llm.common import records
from evidara.llm.textarrays import buffers, leaves_nothing, slices
from evidara.plans.registry import texts

SLOTS = 1 << 15
#: Bytes of text that a task works on at a time: some 50 bytes of arrays for each.
SLICE = 1 << 18
#: Training reads at most so many labelled texts per language, those with the smallest hashes of their ids.
TRAINING_TEXTS = 4000
LETTER = re.compile(r"[^\W\d_]")
#: Bytes as the n-grams see them: ASCII letters in lower case, all other ASCII as a blank, the rest unchanged.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], dtype=np.uint8)
RESULT = "doc_id bigint, lang_pred string, score double, languages array<struct<lang:string,share:double>>"


def gram_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and row of every 4-gram that lies within a row and holds a letter byte."""
    folded = FOLD[data].astype(np.uint32)
    n = len(folded) - 3
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # blank runs count once: a gram never starts with two blanks
    key = folded[:n] | folded[1 : n + 1] << np.uint32(8) | folded[2 : n + 2] << np.uint32(16) | folded[3 : n + 3] << np.uint32(24)
    slot = (key * np.uint32(2654435761)) >> np.uint32(32 - 15)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    keep = np.repeat(offsets[1:], np.diff(offsets))[:n] >= np.arange(n) + 4
    keep &= ~((folded[:n] == 32) & (folded[1 : n + 1] == 32))
    return slot[keep].astype(np.int64), row[keep]


def train(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = TRAINING_TEXTS) -> dict[str, np.ndarray]:
    """Log-probability of each slot for every language with a labelled text (at most ``limit`` texts each)."""
    rows = records(labelled, key, lang, text).select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    # the choice looks at ids and labels only; texts are read for the chosen ids. A bound on the hash leaves half as many again as wanted of
    # each language (one row a language says how many it has), so no task ranks all rows of one
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).withColumn("below", F.lit(float(1 << 63)) * (F.least(F.lit(3.0 * limit) / F.col("n"), F.lit(2.0)) - 1))
    near = rows.select("key", "lang", F.xxhash64("key").alias("h")).join(F.broadcast(sizes), "lang").where(F.col("h") <= F.col("below"))
    order = Window.partitionBy("lang").orderBy("h", "key")
    chosen = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).select("key")
    chosen = rows.join(F.broadcast(chosen), "key", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                slot, row = gram_slots(*buffers(part.column(1)))
                names = part.column(0).to_pylist()
                of = {x: i for i, x in enumerate(dict.fromkeys(names))}
                code = np.array([of[x] for x in names])[row]
                table = np.bincount(code * SLOTS + slot, minlength=len(of) * SLOTS).reshape(len(of), SLOTS)
                for x, i in of.items():
                    sums[x] = sums.get(x, 0) + table[i]
        for x, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch({"lang": pa.array([x] * len(at), pa.string()), "slot": pa.array(at), "n": pa.array(counts[at].astype(np.int64))})

    counted = chosen.select("lang", "text").mapInArrow(leaves_nothing(count), "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    model: dict[str, np.ndarray] = {}
    for x in counted.toPandas().groupby("lang"):  # at most SLOTS rows a language
        name, part = x
        counts = np.full(SLOTS, 0.5)
        counts[part["slot"].to_numpy()] += part["n"].to_numpy()
        model[name] = np.log(counts / counts.sum())
    return dict(sorted(model.items()))


def mixture(counts: np.ndarray, logp: np.ndarray, *, rounds: int = 60, tol: float = 1e-4, parameters_cost: float = 1.0) -> tuple[list[int], np.ndarray]:
    """Languages of one document and their shares. counts: of its distinct slots; logp: languages x slots.

    The set starts as the single most likely language. At each step EM is run for the current set joined by each
    further language in turn; the best of them joins while it lowers BIC = -2 log L + k log n."""
    n = counts.sum()
    single = logp @ counts
    chosen = [int(np.argmax(single))]
    shares = np.ones(1)
    best = single[chosen[0]]
    cost = parameters_cost * np.log(n)
    peak = logp.max(axis=0)
    prob = np.exp(logp - peak)
    shift = peak @ counts
    while len(chosen) < len(logp):
        found = None
        for c in range(len(logp)):
            if c in chosen:
                continue
            part = prob[[*chosen, c]]
            pi = np.append(shares * 0.9, 0.1)
            for _ in range(rounds):
                joint = part * pi[:, None]
                total = joint.sum(axis=0)
                new = (joint / total) @ counts / n
                done = np.abs(new - pi).max() < tol
                pi = new
                if done:
                    break
            like = float(np.log(pi @ part) @ counts + shift)
            if found is None or like > found[0]:
                found = (like, c, pi)
        if 2 * (found[0] - best) <= cost:
            break
        best, shares = found[0], found[2]
        chosen.append(found[1])
    return chosen, shares


def identify(docs: DataFrame, model: dict[str, np.ndarray], *, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Language mixture of every document: doc_id, lang_pred, score, languages (shares, largest first), then the columns ``keep``.

    Kept columns go through with their rows, so whoever picks documents by language need not join texts to what was found."""
    names = list(model)
    kept = [x for x in keep if x != key]
    columns = [text, *(x for x in kept if x != text)]
    table = np.stack([model[x] for x in names]) if names else np.zeros((0, SLOTS))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, offsets = buffers(part.column(1))
                slot, row = gram_slots(data, offsets)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                pred, score, sets = [], [], []
                for i, raw in enumerate(part.column(1).to_pylist()):
                    own = slot[bounds[i] : bounds[i + 1]]
                    if not names or raw is None or not LETTER.search(raw):
                        pred.append("und"), score.append(0.0), sets.append([])
                        continue
                    distinct, counts = np.unique(own, return_counts=True)
                    if not len(own):  # too short for a gram: the prior alone
                        distinct, counts = np.zeros(1, np.int64), np.zeros(1)
                        chosen, shares = [0], np.ones(1)
                        value = 1.0 / len(names)
                    else:
                        chosen, shares = mixture(counts.astype(float), table[:, distinct])
                        value = None
                    order = sorted(range(len(chosen)), key=lambda j: (-shares[j], names[chosen[j]]))
                    pred.append(names[chosen[order[0]]])
                    score.append(float(min(1.0, shares[order[0]])) if value is None else value)
                    sets.append([{"lang": names[chosen[j]], "share": float(shares[j])} for j in order])
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                found = [part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, kind)]
                yield pa.record_batch([*found, *(part.column(1 + columns.index(x)) for x in kept)], names=["doc_id", "lang_pred", "score", "languages", *kept])

    rows = records(docs, key, *columns).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *columns[1:])
    schema = T.StructType([*T.StructType.fromDDL(RESULT).fields, *(T.StructField(x, docs.schema[x].dataType) for x in kept)])
    return rows.mapInArrow(leaves_nothing(predict), schema)


def held_out(key: str = "doc_id") -> Column:
    """Documents that training never sees: crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def query(spark, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    model = train(docs.where(~held_out()))
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))
