"""Registered queries of the library and their SQL."""

from __future__ import annotations

from gridledger.plans import automation, coverage, dashboards, facts, ingest, quality, snapshots  # noqa: F401
from gridledger.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
