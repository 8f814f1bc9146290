"""Embedding engines as a parameter: what makes a vector of a text, under which name and revision, and whether its vectors are fit for a profile."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import text as T
from evidara.functions import vectors as V


@dataclass(frozen=True)
class Engine:
    """vector: the column of a text's vector. It may be an expression or a pandas UDF of any model."""

    provider: str
    model: str
    revision: str
    dimension: int
    vector: Callable[[Column], Column]


def hashed(dimension: int = 8) -> Engine:
    """The deterministic stand-in: bytes of hashes of the whole text."""
    return Engine("local", "sha256", "1", dimension, lambda text: V.hash_embedding(text, dimension))


def worded(dimension: int = 64) -> Engine:
    """Feature hashing: each folded word adds one, with a sign, to the place that its hash names; of length 1 unless the text has no words."""

    def vector(text: Column) -> Column:
        places = F.transform(T.words(text), lambda w: F.xxhash64(w))
        count = lambda d, hs: F.aggregate(hs, F.lit(0.0), lambda a, h: a + F.when(F.pmod(h, F.lit(dimension)) == d, F.when(F.shiftright(h, 40) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0))
        raw = F.transform(F.array(places), lambda hs: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda d: count(d, hs)))
        unit = F.transform(raw, lambda v: F.transform(v, lambda x: F.when(V.norm(v) > 0, x / V.norm(v)).otherwise(0.0)))
        return F.get(unit, F.lit(0))

    return Engine("local", "words", "1", dimension, vector)


def embedded(texts: DataFrame, engine: Engine, *, key: str = "node_id", text: str = "text") -> DataFrame:
    """(key, embedding, provider, model, model_revision, dimension, checksum, reason): the engine's vectors and the first reason against each: no_text, no_vector, dimension,
    not_finite; empty for sound ones. A vector with a reason is null."""
    made = texts.select(key, F.col(text).alias("_text"), F.when(F.coalesce(F.trim(text), F.lit("")) != "", engine.vector(F.col(text))).alias("_v"))
    odd = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = F.when(F.coalesce(F.trim("_text"), F.lit("")) == "", "no_text").when(F.col("_v").isNull(), "no_vector").when(F.size("_v") != engine.dimension, "dimension").when(odd, "not_finite").otherwise("")
    made = made.withColumn("reason", reason).withColumn("embedding", F.when(F.col("reason") == "", F.col("_v").cast("array<float>")))
    told = [F.lit(x).alias(n) for n, x in (("provider", engine.provider), ("model", engine.model), ("model_revision", engine.revision), ("dimension", engine.dimension))]
    return made.select(key, "embedding", *told, F.when(F.col("embedding").isNotNull(), V.checksum(F.col("embedding"))).alias("checksum"), "reason")


def unfit(engine: Engine, profiles: DataFrame) -> DataFrame:
    """profiles(profile_id, provider, model, model_revision, dimension) that the engine cannot serve, with all reasons."""
    differs = {"provider": engine.provider, "model": engine.model, "model_revision": engine.revision, "dimension": engine.dimension}
    reasons = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.lit(x)), f"other_{c}") for c, x in differs.items()]))
    return profiles.select("profile_id", F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")
