"""All queries of the library by name, each with its equivalent in SQL where SQL can express it."""

from __future__ import annotations

from fixwave.plans import domain, ingest, more, reads, records, relational, temporal  # noqa: F401  these fill the registry
from fixwave.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "d_score"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
