"""All registered queries of the document engine with their SQL."""

from __future__ import annotations

from loomdoc.plans import layout_queries, page_queries, parse_queries, store_queries, text_queries, vector_queries  # noqa: F401  they register
from loomdoc.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
