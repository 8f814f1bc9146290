"""What Python workers keep between the stages of the pipeline."""

import os

import numpy as np
import pyarrow as pa
import public_tokenizers

from evidara.llm import packing, textarrays

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_a_step_leaves_nothing(monkeypatch):
    freed = []
    monkeypatch.setattr(textarrays, "give_back", lambda give=textarrays.give_back: freed.append(give()))

    def step(batches):
        for batch in batches:
            textarrays.word_hashes(np.frombuffer(b"some words", np.uint8), np.array([0, 5]), np.array([4, 10]))
            yield batch

    batches = [pa.record_batch({"a": pa.array([i])}) for i in range(3)]
    assert list(textarrays.leaves_nothing(step)(iter(batches))) == batches
    assert len(freed) == 1 and len(textarrays._BYTES.up) == 1 and pa.default_memory_pool().bytes_allocated() >= 0


def test_powers_grow_no_more_than_needed():
    powers = textarrays.Powers(3)
    for n in (10, textarrays.STEP, textarrays.STEP + 1, 3 * textarrays.STEP):
        up, down = powers.to(n)
        assert len(up) == n and (up * down == 1).all()
        assert len(powers.up) < n + textarrays.STEP


def test_workers_end_without_tables_of_powers(spark):
    """The pipeline's encoding tasks drop what they made; the stage after them finds no tables."""
    rows = spark.createDataFrame([(i, f"w{i} " * 50, "a") for i in range(20)], "doc_id long, text string, source string").coalesce(1)
    small, whole = (packing.pack(rows, WORDS, release_after=x, limit=y).drop("ids").orderBy("doc_id", "start").collect() for x, y in ((True, 100), (False, packing.SLICE)))
    assert small == whole and len(small) > 0

    def held(batches):
        from evidara.llm.textarrays import _BYTES

        for batch in batches:
            yield pa.record_batch({"pid": pa.array([os.getpid()] * batch.num_rows, pa.int64()), "n": pa.array([len(_BYTES.up)] * batch.num_rows, pa.int64())})

    packing.pack(rows, WORDS, release_after=True).drop("ids").collect()
    assert {x.n for x in rows.select("doc_id").mapInArrow(held, "pid long, n long").collect()} <= {1}
