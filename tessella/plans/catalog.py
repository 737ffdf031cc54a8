"""All queries over the driver's tables and their SQL, gathered from the modules that define them."""

from __future__ import annotations

from tessella.plans import cleaning, geometry, inference, relational, sequences, spatial, statistics, texts  # noqa: F401  registers their queries
from tessella.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
