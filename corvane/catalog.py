"""All queries of the library itself and their SQL counterparts."""

from __future__ import annotations

from corvane.plans import composites, health, parsing, vault  # noqa: F401  they register their queries
from corvane.plans import queries as plans


def queries() -> dict:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.SQL)
