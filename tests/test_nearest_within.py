"""Nearest values within a distance, against all pairs, also where all lie near each other."""

import random

import pytest
from pyspark.sql import functions as F

from evidara.operators import structure as S


def found(left, right):
    return S.nearest_within(left, right, on=["k"], left_value="a", right_value="b", within=5, left_key="l", right_key="r")


@pytest.mark.parametrize("seed", (1, 2, 3))
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    value = lambda: rng.choice((None, float("nan"), *[rng.randint(-40, 40) / 2 for _ in range(20)]))
    left = [(rng.choice((0, 1, None)), i // 2, value()) for i in range(120)]
    right = [(rng.choice((0, 1, None)), 100 - i, value()) for i in range(40)]
    want = {}
    for k, i, a in left:
        near = [(abs(a - b), r) for q, r, b in right if k == q and k is not None and None not in (a, b) and abs(a - b) <= 5]
        if near:
            want[i] = min(near + ([want[i]] if i in want else []))
    got = found(spark.createDataFrame(left, "k int, l int, a double"), spark.createDataFrame(right, "k int, r int, b double"))
    assert {r.l: r.r for r in got.collect()} == {i: r for i, (_, r) in want.items()}


def test_crowded_values_make_no_pairs(spark):
    left = spark.range(30000).select(F.lit(0).alias("k"), F.col("id").alias("l"), (F.col("id") / 30000).alias("a"))
    right = spark.range(30000).select(F.lit(0).alias("k"), F.col("id").alias("r"), (F.col("id") / 30000).alias("b"))
    got = found(left, right)
    assert got.where("l = r").count() == 30000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "Join Inner" not in plan  # the only join is with the ends of bins
