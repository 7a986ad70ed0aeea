"""All queries of the library but those of the optional packages."""

from __future__ import annotations

from barloom.plans import indicators, streams, workflow

_PARTS = (indicators, workflow, streams)


def queries() -> dict:
    return {k: v for part in _PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.SQL.items()}
