"""Which rows take part: optional and list predicates, scopes, backfills, joins that update, claims, reading order and counts for overviews."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_given(rows: DataFrame, **values: object) -> DataFrame:
    """Equality on the columns whose value is given; None asks nothing. The predicate is built from what is given, so it reaches the scan."""
    for column, value in values.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows


def among(rows: DataFrame, column: str, values: Iterable[object] | DataFrame | None) -> DataFrame:
    """Rows whose column is one of the values: a list of any length up to a thousand is a predicate, a frame of one column a semi join; None takes all."""
    if values is None:
        return rows
    if isinstance(values, DataFrame):
        return rows.join(values.select(F.col(values.columns[0]).alias(column)).distinct(), column, "left_semi")
    values = list(values)
    if len(values) > 1000:
        kind = rows.schema[column].dataType.simpleString()
        return among(rows, column, rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} {kind}"))
    return rows.where(F.col(column).isin(values)) if values else rows.where(F.lit(False))


def only_sources(inventory: DataFrame, sources: Iterable[str] | None, path: str = "source_relpath") -> tuple[DataFrame, list[str]]:
    """(records of the named sources, names that no record has). The names are a caller's list."""
    if sources is None:
        return inventory, []
    names = sorted(set(sources))
    found = among(inventory, path, names)
    have = {r[0] for r in found.select(path).distinct().collect()}  # at most the names given
    return found, [x for x in names if x not in have]


def labelled(rows: DataFrame, column: str, labels: Mapping[str, str], *, name: str, other: str) -> DataFrame:
    """The label of a column's value by a table of labels; values without one keep themselves, nulls get ``other``."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return rows.withColumn(name, F.coalesce(table[F.col(column)], F.col(column), F.lit(other)))


def without_keys(metadata: Column, excluded: Iterable[str]) -> Column:
    """A map without the excluded keys and without nulls."""
    gone = list(excluded)
    return F.map_filter(metadata, lambda k, v: ~k.isin(gone) & v.isNotNull())


def enrich(nodes: DataFrame, documents: DataFrame, *, key: str = "document_id", metadata: str = "metadata") -> DataFrame:
    """Nodes whose metadata is the document's with their own on top: a node's key wins over the document's."""
    theirs = documents.select(key, F.col(metadata).alias("_document"))
    joined = nodes.join(theirs, key, "left")
    below = F.map_filter(F.coalesce("_document", F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key(F.col(metadata), k), F.lit(False)))
    return joined.withColumn(metadata, F.map_concat(below, F.coalesce(metadata, F.create_map().cast("map<string,string>")))).drop("_document")


def feature_reasons(features: DataFrame, names: list[str], *, extension: str = "extension") -> DataFrame:
    """Rows with ``reasons``: for PDF files the features that nobody has evaluated, led by the reason that a review is needed if there are any."""
    open_ = F.array_compact(F.array(*[F.when(F.col(n) == "not_evaluated", F.lit(f"{n}_not_evaluated")) for n in names]))
    named = F.when(F.size(open_) > 0, F.concat(F.array(F.lit("pdf_semantic_review_required")), open_)).otherwise(open_)
    return features.withColumn("reasons", F.when(F.col(extension) == ".pdf", named).otherwise(F.array().cast("array<string>")))


def observed(observations: DataFrame, key: str, status: str = "status") -> DataFrame:
    """(key, status): detected if any is, not_detected if all are, else not_evaluated."""
    per = observations.groupBy(key).agg(F.bool_or(F.col(status) == "detected").alias("any"), F.bool_and(F.col(status) == "not_detected").alias("all"))
    return per.select(key, F.when(F.col("any"), "detected").when(F.col("all"), "not_detected").otherwise("not_evaluated").alias("status"))


def selectable(rows: DataFrame, *, kinds: Iterable[str] = ("clean",)) -> DataFrame:
    """Candidates of a snapshot: normalised rows, with ``bulk`` for those that may be chosen together with others."""
    return rows.where(F.col("normalized_at").isNotNull()).withColumn("bulk", F.col("review_state").isin(list(kinds)) & ~F.coalesce("in_snapshot", F.lit(False)))


#: Longs of one row of bits, and profiles that are few enough to be sent to all tasks with their places.
LONGS, FEW = 8, 1 << 19


def backfill(documents: DataFrame, profiles: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """Rows that a backfill has to add: each document with each active profile of its ``on`` columns, but those that exist.

    Pairs are never shuffled (beyond FEW active profiles existing ones may be): they become bits, 64 * LONGS profiles of a group a row, before they move; documents
    meet these rows, then the profiles, and only the pairs to add are made."""
    place = F.dense_rank().over(Window.partitionBy(*on).orderBy("profile_id")) - 1
    placed = profiles.where("active").drop("active").dropna(subset=on).withColumn("_place", place)
    at = F.col("_place")
    placed = placed.withColumns({"_word": F.floor(at / (64 * LONGS)), "_long": F.floor(at % (64 * LONGS) / 64).cast("int"), "_bit": (at % 64).cast("int")}).drop("_place")
    small = F.broadcast if profiles.where("active").count() <= FEW else lambda x: x
    known = placed.select("profile_id", *on, "_word", "_long", "_bit").distinct()
    bits = [F.bit_or(F.when(F.col("_long") == i, F.expr("shiftleft(1L, _bit)")).otherwise(F.lit(0).cast("bigint"))).alias(f"_{i}") for i in range(LONGS)]
    have = existing.select("document_id", "profile_id").join(small(known), "profile_id").groupBy("document_id", *on, "_word").agg(*bits)
    have = have.select("document_id", *on, "_word", F.array(*[f"_{i}" for i in range(LONGS)]).alias("_have"))
    others = [c for c in placed.columns if c not in (*on, "_word")]
    listed = placed.groupBy(*on, "_word").agg(F.collect_list(F.struct(*others)).alias("_profiles"))
    words = placed.select(*on, "_word").distinct()
    asked = documents.join(small(words), on).repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "document_id", *on, "_word")  # few rows, but many pairs
    met = asked.join(have, ["document_id", *on, "_word"], "left").join(small(listed), [*on, "_word"])
    absent = F.filter("_profiles", lambda p: F.getbit(F.get("_have", p["_long"]), p["_bit"]) == 0)
    rest = [c for c in documents.columns if c not in on]
    return met.select(*on, *rest, F.inline(F.when(F.col("_have").isNull(), F.col("_profiles")).otherwise(absent))).drop("_long", "_bit")


def update_from(rows: DataFrame, source: DataFrame, keys: list[str], columns: list[str], *, only_null: bool = False) -> DataFrame:
    """Rows with the columns of the source row of the same keys, which must be unique there; rows without one stay as they are.

    only_null: columns that have a value keep it."""
    theirs = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_found"))
    joined = rows.join(theirs, keys, "left")
    found = F.coalesce("_found", F.lit(False))
    new = {c: F.when(found & (F.col(c).isNull() if only_null else F.lit(True)), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])


def claim(queue: DataFrame, wanted: DataFrame, worker: str, as_of: str, *, key: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """(queue after the claim, claimed keys): wanted rows that are pending run now for the worker; rows in any other state are not claimed."""
    asked = wanted.select(key).distinct().withColumn("_asked", F.lit(True))
    joined = queue.join(asked, key, "left")
    mine = F.coalesce("_asked", F.lit(False)) & (F.col("status") == "pending")
    after = joined.withColumns({"worker": F.when(mine, F.lit(worker)).otherwise(F.col("worker")), "claimed_at": F.when(mine, F.lit(as_of).cast("timestamp")).otherwise(F.col("claimed_at")), "status": F.when(mine, "running").otherwise(F.col("status"))})
    return after.select(*queue.columns), joined.where(mine).select(key)


def supersede_legacy(bundles: DataFrame, references: dict[str, DataFrame], *, key: str = "bundle_id", fingerprint: str = "fingerprint", legacy: str = "legacy_unverified") -> tuple[DataFrame, dict[str, DataFrame]]:
    """(bundles, references): where a verified bundle has the fingerprint of a legacy one, references to the legacy bundle name the other and the legacy row goes.

    references: frames with a column of the key's name."""
    old = bundles.where(F.col("status") == legacy).select(fingerprint, F.col(key).alias("_old"))
    new = bundles.where(F.col("status") != legacy).groupBy(fingerprint).agg(F.min(key).alias("_new"))
    remap = old.join(new, fingerprint).select("_old", "_new")
    kept = bundles.join(remap.select(F.col("_old").alias(key)), key, "left_anti")
    moved = {name: df.join(remap, df[key] == F.col("_old"), "left").select(*[F.coalesce("_new", key).alias(key) if c == key else F.col(c) for c in df.columns]) for name, df in references.items()}
    return kept, moved


#: Which of the kinds of layout elements comes first at one place.
ELEMENTS = {"text": 0, "image": 1, "line": 2, "rect": 3}


def reading_order(elements: DataFrame, page: list[str]) -> DataFrame:
    """Elements with their place on the page from 0: by top, left edge, kind and position in the file."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in ELEMENTS.items() for x in kv])[F.col("kind")], F.lit(len(ELEMENTS)))
    return elements.withColumn("reading_order", F.row_number().over(Window.partitionBy(*page).orderBy("top", "x0", rank, "position")) - 1)


def over_limit(members: DataFrame, group: str, limit: int) -> DataFrame:
    """(group, n) of groups with more members than a build may have."""
    return members.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > limit)


def subset(values: Column, allowed: Iterable[str]) -> Column:
    """Whether all values of an array are allowed; null is the empty set."""
    return F.size(F.array_except(F.coalesce(values, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in allowed]).cast("array<string>"))) == 0


def dimensions(rows: DataFrame, columns: list[str], *, order: str) -> DataFrame:
    """(dimension, key, label, n): the distinct keys of every column pair (key, label), with the last label by ``order``: one pass over the rows."""
    pairs = [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("key"), F.coalesce(F.col(f"{c}_label"), F.col(c)).cast("string").alias("label")) for c in columns]
    listed = rows.select(F.col(order).alias("_order"), F.inline(F.array(*pairs))).where("key <> ''")
    return listed.groupBy("dimension", "key").agg(F.max_by("label", "_order").alias("label"), F.count("*").alias("n"))


def overview(**counts: DataFrame) -> DataFrame:
    """One row: how many rows each frame has."""
    out = None
    for name, df in counts.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # single rows
    return out


def id_sets(rows: DataFrame, key: str, member: str) -> DataFrame:
    """(key, members, n): the sorted distinct members of each key."""
    return rows.where(F.col(member).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("members")).withColumn("n", F.size("members"))


def blockers(tables: dict[str, DataFrame], where: str) -> DataFrame:
    """(table_name, n): rows of each table that stand in the way; tables without any are listed with 0."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count_if(F.expr(where)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def fuse(lists: DataFrame, order: list[str], *, k: int = 60, by: tuple[str, ...] = (), key: str = "node_id") -> DataFrame:
    """Reciprocal rank fusion that keeps the payload: rows (source, rank, key, payload) to (key, score, sources, payload). Sources stand in the order of the lists in
    which a row was first seen, and the payload is that of the first."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("source")).cast("int")
    rest = [c for c in lists.columns if c not in ("source", "rank", key, *by)]
    seen = F.array_sort(F.collect_list(F.struct(place.alias("place"), "rank", "source", F.struct(*rest).alias("payload"))))
    per = lists.groupBy(*by, key).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 6).alias("score"), seen.alias("seen"))
    return per.select(*by, key, "score", F.array_join(F.array_distinct(F.transform("seen", lambda x: x["source"])), ",").alias("sources"), F.element_at("seen", 1)["payload"].alias("payload")).select(*by, key, "score", "sources", "payload.*")
