"""All registered queries and their check SQL."""

from __future__ import annotations

from packetloom.plans import stored  # noqa: F401  (registers its queries)
from packetloom.plans.catalog import QUERIES
from packetloom.plans.oracle import oracle_sql as _sql
from packetloom.plans.oracle_stored import stored_sql


def oracle_sql() -> dict[str, str]:
    return {**_sql(), **stored_sql()}


__all__ = ["QUERIES", "oracle_sql"]
