"""All named queries of the core."""

from __future__ import annotations

from tapeloom.plans import batches, mixing, parameters, planning, records, scans, streams, texts, visibility  # noqa: F401
from tapeloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
