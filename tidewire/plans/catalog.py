"""All registered queries of the library and the SQL that each must agree with."""

from __future__ import annotations

from tidewire.plans import enrichment, feeds, relational, stories  # noqa: F401  they register their queries
from tidewire.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
