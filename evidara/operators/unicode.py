"""Canonical composition (NFC) of texts in all scripts."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@functools.cache
def _suspects() -> str:
    """A character class of all that a composed text may not hold, or holds only in some order: marks, second parts of compositions, and what composition replaces."""
    seconds = {unicodedata.normalize("NFD", chr(c))[-1] for c in range(0x110000) if unicodedata.decomposition(chr(c)) and not unicodedata.decomposition(chr(c)).startswith("<")}
    odd = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.combining(chr(c)) or chr(c) in seconds or 0x1161 <= c <= 0x1175 or 0x11A8 <= c <= 0x11C2 or unicodedata.normalize("NFC", chr(c)) != chr(c))]
    runs: list[list[int]] = []
    for c in odd:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs) + "]"


def surely_composed(text: Column) -> Column:
    """Whether a text holds nothing that composition could change; it may say no of composed texts, never yes of others."""
    return ~text.rlike(_suspects())


def composed(df: DataFrame, column: str) -> DataFrame:
    """The frame with the column's texts composed. Texts that the check passes are not touched and never leave the JVM; the others go through Python in Arrow batches."""
    fine = F.coalesce(surely_composed(F.col(column)), F.lit(True))
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([unicodedata.normalize("NFC", x) for x in batch.column(at).to_pylist()], batch.column(at).type)
            yield batch.set_column(at, batch.schema.field(at), made)

    return df.where(fine).unionByName(df.where(~fine).mapInArrow(run, df.schema))
