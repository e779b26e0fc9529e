"""Registered queries of the regional-indicator engine and their SQL oracles."""

from __future__ import annotations

from talweg.plans import basics, contracts, datasets, evidence_text, family, homepage, indicators, opportunity, places, recipes, relational, snapshot  # noqa: F401  they register their queries
from talweg.plans.base import ORACLES, QUERIES

FLAGSHIP = "q04_opportunity_index"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
