"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from .queries import QUERIES, SQL, audit, contracts, evaluation, records, retrieval, sampling, text, training  # noqa: F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
