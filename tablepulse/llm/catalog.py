"""All queries of this folder, by name."""

from __future__ import annotations

from tablepulse.llm.queries import QUERIES, SQL


def callables() -> dict:
    return dict(QUERIES)


def reference_sql() -> dict[str, str]:
    return dict(SQL)
