"""Functions over string maps: canonical JSON, fingerprints, stripping and merging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(values: Column) -> Column:
    """JSON of a map with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def fingerprint(values: Column) -> Column:
    return F.sha2(canonical_json(values), 256)


def without(values: Column, pattern: str) -> Column:
    """The entries whose key does not match."""
    return F.map_filter(values, lambda k, v: ~k.rlike(pattern))


def merged(left: Column, right: Column) -> Column:
    """All entries; those of the right win."""
    keys = F.map_keys(right)
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.array_contains(keys, k)), right)


def typed(value: Column, prefix: str) -> Column:
    """Whether an id has the prefix and lower-case hex digits after it."""
    return F.coalesce(value.rlike(f"^{prefix}_[0-9a-f]{{8,64}}$"), F.lit(False))
