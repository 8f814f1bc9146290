"""All queries of the library over the driver's tables, by name."""

from __future__ import annotations

from evidara.plans import adapting, checking, controlling, documenting, embedding, gating, identifying, ledgers, marking, merging, placing, retrieving, reviewing, searching, selecting, storing, texts, verifying  # noqa: F401
from evidara.plans.registry import QUERIES, SQL

FLAGSHIP = "evidence_search"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
