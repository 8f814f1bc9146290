"""Integrity checks: each gives rows (check, subject, passed, detail); violations are rows, not errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Child keys without a parent."""
    missing = child.select(*keys).distinct().join(parent.select(*keys).distinct(), keys, "left_anti")
    return missing.select(F.lit(name).alias("check"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("subject"))


def all_issues(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def bijection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").where("l is null or r is null").select(key, F.when(F.col("l").isNull(), "missing_left").otherwise("missing_right").alias("side"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dense(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Whether each key's ordinals are 0, 1, 2 ... without gaps or repeats."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), ((F.max(ordinal) == F.count("*") - 1) & (F.min(ordinal) == 0) & (F.countDistinct(ordinal) == F.count("*"))).alias("dense"))


#: Digits of a row's MD5 in each of the sums of a table's state; a sum of 2^47 rows still fits.
LANE = 4


def digest_state(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (lanes, n): sums over the rows' MD5s, four hexadecimal digits each, and the number of rows. States of parts add up to that of the whole, in any order and
    layout, and repeated rows count as often as they stand; so a change is added or taken away without a look at the table."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]))
    hashed = df.select(row.alias("m"))
    sums = [F.coalesce(F.sum(F.conv(F.substring("m", 1 + LANE * i, LANE), 16, 10).cast("bigint")), F.lit(0)) for i in range(32 // LANE)]
    return hashed.agg(F.array(*sums).alias("lanes"), F.count("*").alias("n"))


def changed_state(state: DataFrame, *, added: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """A state after rows came and went, from the states of the changes alone."""
    parts = [(state, 1), (added, 1), (gone, -1)]
    signed = lambda df, sign: df.select((F.lit(sign) * F.col("n")).alias("n"), F.transform("lanes", lambda x: x * sign).alias("lanes"))
    every = reduce(DataFrame.unionByName, [signed(*part) for part in parts if part[0] is not None])
    return every.agg(F.array(*[F.sum(F.col("lanes")[i]) for i in range(32 // LANE)]).alias("lanes"), F.sum("n").alias("n"))


def digest_of(state: DataFrame) -> DataFrame:
    """(digest, n_rows) of a state."""
    return state.select(F.sha2(F.concat_ws(":", F.transform("lanes", lambda x: x.cast("string")), F.col("n").cast("string")), 256).alias("digest"), F.col("n").alias("n_rows"))


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """(digest, n_rows) of a table as a multiset of rows."""
    return digest_of(digest_state(df, columns))


def ordered_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """(digest, n_rows): md5 of the sorted md5s of all rows. Row digests are combined in slices by their first digits, three for up to a hundred million rows
    and three more for each further factor of 4096, and slices in slices of slices, so no task holds all of them."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]))
    n, digits, most = df.count(), 3, 100_000_000
    while n > most:
        digits, most = digits + 3, most * 4096
    slices = df.select(row.alias("m")).groupBy(F.substring("m", 1, digits).alias("p")).agg(F.md5(F.array_join(F.array_sort(F.collect_list("m")), "")).alias("d"), F.count("*").alias("n"))
    of_slices = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), ""))
    for d in range(digits - 3, 0, -3):
        slices = slices.groupBy(F.substring("p", 1, d).alias("q")).agg(of_slices.alias("d"), F.sum("n").alias("n")).withColumnRenamed("q", "p")
    return slices.agg(of_slices.alias("digest"), F.sum("n").alias("n_rows"))


def manifest(members: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Hash of each key's members in order."""
    listed = F.array_sort(F.collect_list(F.struct(order, value)))
    return members.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x[value].cast("string")), "\n"), 256).alias("manifest_hash"), F.count("*").alias("n_members"))


def roll_up(results: DataFrame) -> DataFrame:
    """results(check, passed, severity): counts by severity and a status."""
    failed = ~F.col("passed")
    return results.agg(F.count_if(failed & (F.col("severity") == "error")).alias("errors"), F.count_if(failed & (F.col("severity") == "warning")).alias("warnings")).withColumn(
        "status", F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "passed_with_warnings").otherwise("passed")
    )


def contiguous(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Keys whose numbers are not 1, 2, 3 ... in order; a null number breaks the order."""
    w = Window.partitionBy(*keys).orderBy(number)
    return df.withColumn("_r", F.row_number().over(w)).where(~F.col("_r").eqNullSafe(F.col(number))).select(*keys).distinct()
