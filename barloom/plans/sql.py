"""Pieces of DuckDB SQL that the oracle statements are put together from."""

from __future__ import annotations

P = "PARTITION BY provider, ticker ORDER BY trading_date"
LAG = f"OVER ({P})"

BARS = """b AS (
  SELECT 'tpch' AS provider, p_brand AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS trading_date,
    arg_min(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount)) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    arg_max(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount)) AS close,
    CAST(sum(l_quantity) AS BIGINT) AS volume,
    arg_max(l_extendedprice / l_quantity * (1 - l_discount), row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount)) AS adjusted_close
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""

HOURS = """b AS (
  SELECT 'events' AS provider, event_type AS ticker, date_trunc('hour', ts) AS trading_date, arg_min(value, ts) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume, arg_max(value, ts) AS adjusted_close
  FROM events GROUP BY ALL)"""


def over(first: int, last: int) -> str:
    at = lambda n: f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING" if n > 0 else "CURRENT ROW"
    return f"OVER ({P} ROWS BETWEEN {at(first)} AND {at(last)})"


def frame(agg: str, x: str, first: int, last: int) -> str:
    """agg is a name, or a template with {x}."""
    call = agg.format(x=x) if "{" in agg else f"{agg}({x})"
    return f"CASE WHEN count({x}) {over(first, last)} = {last - first + 1} THEN {call} {over(first, last)} END"


def rolling(agg: str, x: str, n: int) -> str:
    return frame(agg, x, 1 - n, 0)


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif(CAST(({b}) AS DOUBLE), 0))"


TRUE_RANGE = f"greatest(high - low, abs(high - lag(close) {LAG}), abs(low - lag(close) {LAG}))"


def ewm(name: str, source: str, x: str, alpha: float, length: int) -> str:
    """CTEs: {name}(provider, ticker, trading_date, y), the recursive mean of column x of source."""
    a, d = repr(alpha), repr(1 - alpha)
    return f"""{name}_n AS (SELECT provider, ticker, trading_date, CAST({x} AS DOUBLE) AS x, row_number() OVER ({P}) AS rn, count({x}) OVER ({P}) AS seen FROM {source}),
{name}_r AS (
  SELECT provider, ticker, rn, trading_date, seen, x AS y, CAST(1 AS DOUBLE) AS w FROM {name}_n WHERE rn = 1
  UNION ALL
  SELECT n.provider, n.ticker, n.rn, n.trading_date, n.seen,
    CASE WHEN r.y IS NULL THEN n.x WHEN n.x IS NULL THEN r.y ELSE (r.w * {d} * r.y + {a} * n.x) / (r.w * {d} + {a}) END,
    CASE WHEN r.y IS NULL OR n.x IS NOT NULL THEN 1 ELSE r.w * {d} END
  FROM {name}_r r JOIN {name}_n n ON n.provider = r.provider AND n.ticker = r.ticker AND n.rn = r.rn + 1),
{name} AS (SELECT provider, ticker, trading_date, CASE WHEN seen >= {length} THEN y END AS y FROM {name}_r)"""


def with_(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


KEYS = "provider, ticker, trading_date"
