"""Chat formatting with cumulative-snapshot collapse.

A logged conversation is often the beginning of one logged later. Every turn gets a rolling hash of its conversation up to there: the running
sums of two position-salted 64-bit turn hashes, kept as decimals. A conversation goes if its last hash is an earlier hash of
another one (an anti-join), and of equal conversations the one with the smallest id stays. What remains is rendered.

Turns are dealt by ranges of their order, so one conversation may span many tasks: positions and sums are two-level (within a range, and over the ranges
before). Only hashes take part in that; texts are shuffled once to be ordered and once more, those of retained conversations alone, to be rendered, in parts
of ``turns`` turns.

Results: turns are ordered by turn, role and text, nulls first; rows that repeat in full count once; a null role or text is
empty. One row per retained conversation and part, with the number of equal conversations that it stands for. Every "<|" of a role or text is
written "<||", so that no text can pass for a mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.common import written

TURNS = 4096
DECIMAL = "decimal(38,0)"


def render(role, text):
    plain = lambda x: F.replace(x, F.lit("<|"), F.lit("<||"))
    return F.concat(F.lit("<|"), plain(role), F.lit("|>\n"), plain(text), F.lit("<|end|>\n"))


def rolling(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """conv_id, pos, n_turns of the whole conversation, h1 and h2 (hashes of the conversation up to and with the turn) of turns(conv_id, part, id, x1, x2)."""
    inside = Window.partitionBy("conv_id", "part").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    ranges = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.join(sizes, ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("id") - F.col("first"))
    for i in (1, 2):
        placed = placed.withColumn(f"t{i}", F.xxhash64(F.lit(i), "pos", "x1", "x2").cast(DECIMAL))
    placed = placed.withColumns({f"s{i}": F.sum(f"t{i}").over(inside).cast(DECIMAL) for i in (1, 2)})
    placed = written(placed.select("conv_id", "part", "pos", "n_turns", "n", "t1", "t2", "s1", "s2"))
    # only conversations that lie in several ranges have sums to carry
    sums = placed.where("n < n_turns").groupBy("conv_id", "part").agg(F.sum("t1").cast(DECIMAL).alias("t1"), F.sum("t2").cast(DECIMAL).alias("t2"))
    carried = sums.select("conv_id", "part", *[F.sum(f"t{i}").over(ranges).cast(DECIMAL).alias(f"b{i}") for i in (1, 2)]).where("b1 is not null")
    whole = placed.join(carried, ["conv_id", "part"], "left")
    h = lambda i: (F.col(f"s{i}") + F.coalesce(F.col(f"b{i}"), F.lit(0).cast(DECIMAL))).cast(DECIMAL).alias(f"h{i}")
    return whole.select("conv_id", "pos", "n_turns", h(1), h(2))


def collapse(conversations: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", turns: int = TURNS) -> DataFrame:
    """conv_id, part, n_turns (of the part), n_copies, text."""
    order = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(
        F.col(key).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    ).where("conv_id is not null")
    # equal rows are in one range, so they need no shuffle of their own to count once; ids number the rows of a range in order
    ordered = rows.repartitionByRange(*order).distinct().sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    x = lambda i: F.xxhash64(F.lit(i), "role", "text").alias(f"x{i}")
    table = written(ordered.select("conv_id", F.shiftright("id", 33).alias("part"), "id", x(1), x(2), "role", "text"))
    ranges = Window.partitionBy("conv_id")
    sizes = table.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(ranges.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("conv_id", "part", "n", "first", before.alias("before"), F.sum("n").over(ranges).alias("n_turns"))
    prefixes = written(rolling(table.select("conv_id", "part", "id", "x1", "x2"), sizes))
    whole = prefixes.where("pos = n_turns - 1").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = prefixes.where("pos < n_turns - 1").select("pos", "h1", "h2").distinct()
    kept = whole.join(inner, ["pos", "h1", "h2"], "left_anti").select("conv_id", "n_copies")
    placed = table.select("conv_id", "part", "id", "role", "text").join(sizes.join(kept, "conv_id"), ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("id") - F.col("first"))
    parts = placed.select("conv_id", F.floor(F.col("pos") / turns).alias("part"), "n_copies", "pos", render(F.col("role"), F.col("text")).alias("s"))
    made = parts.groupBy("conv_id", "part", "n_copies").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("turns"))
    return made.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.transform("turns", lambda x: x["s"]), "").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = f"""
WITH rows AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM rows),
prefixed AS (
  SELECT *, string_agg(len(role) || ':' || role || len(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY pos) AS sofar, count(*) OVER (PARTITION BY conv_id) - 1 AS last
  FROM placed
),
whole AS (SELECT sofar, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefixed WHERE pos = last GROUP BY sofar),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM prefixed p WHERE p.pos < p.last AND p.sofar = w.sofar))
SELECT p.conv_id, CAST(p.pos // {TURNS} AS BIGINT) AS part, count(*) AS n_turns, k.n_copies, string_agg('<|' || replace(role, '<|', '<||') || '|>' || chr(10) || replace(text, '<|', '<||') || '<|end|>' || chr(10), '' ORDER BY pos) AS text
FROM prefixed p JOIN kept k USING (conv_id) GROUP BY p.conv_id, p.pos // {TURNS}, k.n_copies
"""
