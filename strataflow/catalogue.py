"""All registered queries of the library, by name."""

from __future__ import annotations

from .plans import catalogue_queries, learning_queries, lifecycle_queries, model_queries, numeric_queries, physics_queries, search_queries, solver_queries, store_queries, table_queries, text_queries  # noqa: F401  they register their queries
from .plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
