"""Ingestion: a source is asked ticker by ticker, a failing ticker doesn't stop the others, rows are upserted once."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame

from barloom.sources.bars import upsert
from barloom.sources.universe import check_range


class Source(Protocol):
    """Where daily bars come from; ``end`` is exclusive. Returns rows of the bronze table, or None if there are none."""

    def fetch(self, ticker: str, start: dt.date, end: dt.date) -> DataFrame | None: ...


@dataclass
class Ingested:
    table: DataFrame | None
    tickers: int = 0
    failures: dict[str, str] = field(default_factory=dict)


def ingest(existing: DataFrame | None, source: Source, plan: list[tuple[str, dt.date, dt.date]], strict: bool = False) -> Ingested:
    """Fetch each (ticker, start, end) and upsert all that came in one go."""
    new, out = None, Ingested(existing)
    for ticker, start, end in plan:
        check_range(start, end)
        try:
            got = source.fetch(ticker, start, end)
        except Exception as e:  # noqa: BLE001  whatever a source raises concerns its ticker only
            if strict:
                raise
            out.failures[ticker] = f"{type(e).__name__}: {e}"
            continue
        out.tickers += 1
        if got is not None:
            new = got if new is None else new.unionByName(got)
    out.table = upsert(existing, new) if new is not None else existing
    return out


@dataclass
class Onboarded:
    before: DataFrame
    after: DataFrame
    ingested: Ingested


def onboard(existing: DataFrame | None, source: Source, active: DataFrame, start: dt.date, end: dt.date, provider=None, backfill: bool = True, strict: bool = False) -> Onboarded:
    """Report which active tickers have bars, fetch those that have none, and report again. ``backfill=False`` only reports."""
    from barloom.operators.quality import onboarding
    from barloom.sources.bars import BRONZE

    table = existing if existing is not None else active.sparkSession.createDataFrame([], BRONZE)
    before = onboarding(active, table, provider)
    if not backfill:
        return Onboarded(before, before, Ingested(existing))
    missing = [r["ticker"] for r in before.filter("status = 'missing'").orderBy("ticker").collect()]  # tickers, as few as a universe has
    got = ingest(existing, source, [(t, start, end) for t in missing], strict)
    return Onboarded(before, onboarding(active, got.table if got.table is not None else table, provider), got)
