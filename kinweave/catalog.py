"""Named queries over the test tables, with their SQL."""

from __future__ import annotations

from kinweave.plans.queries import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
