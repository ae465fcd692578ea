"""All queries of the library, by name."""

from __future__ import annotations

from .plans import curation, dedup, exchange, filters, formats, graph_walks, graphs, joins, rollups, search, splits, storage, streams, texts, upkeep, windows  # noqa: F401  they register their plans
from .plans.base import ORACLES, PLANS


def queries():
    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
