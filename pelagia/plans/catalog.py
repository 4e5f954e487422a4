"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from pelagia.plans import domain, problems, records

_PARTS = [problems, records, domain]


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
