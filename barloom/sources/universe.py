"""Which tickers are active: lists in YAML, with inclusion, exclusion and checks. Small, on the driver."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path


class UniverseError(ValueError):
    pass


def _load(path: str | Path, kind: str) -> dict:
    import yaml

    data = yaml.safe_load(Path(path).read_text())
    if not isinstance(data, dict) or data.get("kind") != kind:
        raise UniverseError(f"{path} is not of kind {kind}")
    return data


def active_tickers(path: str | Path, universes: dict[str, str | Path]) -> list[str]:
    """Sorted tickers: of each universe named in the file, all or the listed symbols, less the excluded ones."""
    found: list[str] = []
    for part in _load(path, "active_tickers").get("universes", []):
        symbols = [s["symbol"] if isinstance(s, dict) else s for s in _load(universes[part["universe"]], "universe")["symbols"]]
        if len(set(symbols)) != len(symbols):
            raise UniverseError(f"{part['universe']} lists a symbol twice")
        include, exclude = part.get("include", "all"), set(part.get("exclude", []))
        chosen = symbols if include == "all" else list(include)
        if unknown := (set(chosen) | exclude) - set(symbols):
            raise UniverseError(f"{part['universe']} has no {sorted(unknown)}")
        found += [s for s in chosen if s not in exclude]
    if len(set(found)) != len(found):
        raise UniverseError("a symbol is in two universes")
    return sorted(found)


def requested_tickers(tickers: Iterable[str], limit: int | None = None) -> list[str]:
    """Stripped, without blanks and repeats, in order; at most ``limit``, if given."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    kept = list(dict.fromkeys(t for t in (x.strip() for x in tickers) if t))
    return kept[:limit]


@dataclass(frozen=True)
class MarketDataSettings:
    provider: str
    initial_start_date: dt.date

    @classmethod
    def read(cls, path: str | Path) -> MarketDataSettings:
        data = _load(path, "market_data")
        start = data.get("initial_start_date")
        return cls(str(data["provider"]), start if isinstance(start, dt.date) else dt.date.fromisoformat(str(start)))


def check_range(start: dt.date, end: dt.date) -> None:
    if start >= end:
        raise ValueError("the start must be before the end")


def write_universe(path: str | Path, name: str, symbols: list[dict], overwrite: bool = False) -> None:
    import yaml

    if Path(path).exists() and not overwrite:
        raise FileExistsError(path)
    Path(path).write_text(yaml.safe_dump({"kind": "universe", "name": name, "symbols": sorted(symbols, key=lambda s: s["symbol"])}, sort_keys=False))
