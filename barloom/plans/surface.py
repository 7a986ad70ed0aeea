"""The library in SQL: scalar functions, table functions and views, for one session.

    register(spark)                # functions
    open_views(spark, bars)        # bars, cleaned_prices, quality_state, default_features, ...

    SELECT *, true_range_of(high, low, lag(close) OVER w) FROM bars WINDOW w AS (PARTITION BY provider, ticker ORDER BY trading_date);
    SELECT * FROM zigzag(TABLE(bars) PARTITION BY (provider, ticker) ORDER BY (trading_date), 5.0D, 10);
    SELECT * FROM ewm(TABLE(SELECT provider, ticker, trading_date, close AS x FROM bars) PARTITION BY (provider, ticker) ORDER BY (trading_date), 0.1D, 10);
    SELECT * FROM backtest(TABLE(backtest_rows) PARTITION BY run ORDER BY (trading_date, provider, ticker), '{"wide": {...}}');

Scalar functions are SQL expressions that Catalyst puts in place, so they are pushed down and compiled like any other. Table
functions are for what depends on its own past; they read the rows of a partition in order. Views are lazy plans of the same
operators that the Python calls give.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeResult

from barloom.operators import backtest, structure

# name, parameters, result, expression
SCALARS = (
    ("finite_or_null", "x DOUBLE", "DOUBLE", "CASE WHEN abs(x) < double('infinity') THEN x END"),
    ("divide_or_null", "a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN abs(try_divide(a, b)) < double('infinity') AND abs(b) < double('infinity') THEN try_divide(a, b) END"),
    ("typical_price", "high DOUBLE, low DOUBLE, close DOUBLE", "DOUBLE", "(high + low + close) / 3.0"),
    ("true_range_of", "high DOUBLE, low DOUBLE, previous_close DOUBLE", "DOUBLE", "greatest(high - low, abs(high - previous_close), abs(low - previous_close))"),
    ("adjusted_price", "price DOUBLE, close DOUBLE, adjusted_close DOUBLE", "DOUBLE", "price * CASE WHEN abs(try_divide(adjusted_close, close)) < double('infinity') THEN try_divide(adjusted_close, close) END"),
    ("percent_b_of", "x DOUBLE, lower_band DOUBLE, upper_band DOUBLE", "DOUBLE", "try_divide(x - lower_band, upper_band - lower_band)"),
    ("body_fraction", "open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE", "DOUBLE", "try_divide(abs(close - open), high - low)"),
    ("close_location", "high DOUBLE, low DOUBLE, close DOUBLE", "DOUBLE", "try_divide(close - low, high - low)"),
    ("valid_bar", "open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE", "BOOLEAN", "coalesce(low > 0 AND open > 0 AND close > 0 AND high >= greatest(open, close) AND low <= least(open, close), false)"),
    ("net_return_of", "buy DOUBLE, sell DOUBLE, commission DOUBLE", "DOUBLE", "try_divide(sell * (1 - commission) - buy * (1 + commission), buy * (1 + commission))"),
)

_KEYS = [StructField("provider", StringType()), StructField("ticker", StringType())]


def _input(table, *needed: str) -> StructType:
    if table is None or not table.isTable:
        raise ValueError("the first argument must be TABLE(...)")
    if missing := [n for n in needed if n not in table.dataType.fieldNames()]:
        raise ValueError(f"columns are missing: {missing}")
    return table.dataType


def _constant(argument, name: str, default):
    if argument is None:
        return default
    if not argument.isConstantExpression or argument.value is None:
        raise ValueError(f"{name} must be a constant")
    return argument.value


class _Bars:
    """Rows of a partition with a high and a low, in the order they come in."""

    def __init__(self, *args, **kwargs):
        self.rows: list[tuple] = []

    def _candidates(self, legs: int) -> tuple[list, list]:
        """Highs above all ``legs`` before and not below any of the ``legs`` after, lows likewise; None elsewhere."""
        out = []
        for k, sign in ((3, 1), (4, -1)):
            xs = [r[k] for r in self.rows]
            side: list[float | None] = [None] * len(xs)
            for i in range(legs, len(xs) - legs):
                around = xs[i - legs : i + legs + 1]
                if None not in around and all(sign * (xs[i] - x) > 0 for x in around[:legs]) and all(sign * (xs[i] - x) >= 0 for x in around[legs + 1 :]):
                    side[i] = xs[i]
            out.append(side)
        return out[0], out[1]

    def eval(self, row, *args) -> None:
        self.rows.append((row["provider"], row["ticker"], row["trading_date"], *[None if row[c] is None else float(row[c]) for c in ("high", "low")]))


class Zigzag(_Bars):
    """zigzag(TABLE, deviation, pivot_legs): the retained pivots, seen from the end of the history."""

    def __init__(self, *args, **kwargs):
        super().__init__()
        self.settings = (5.0, 10)

    @staticmethod
    def analyze(table, deviation=None, pivot_legs=None) -> AnalyzeResult:
        shape = _input(table, "provider", "ticker", "trading_date", "high", "low")
        structure._check_zigzag(float(_constant(deviation, "deviation", 5.0)), int(_constant(pivot_legs, "pivot_legs", 10)))
        names = ("zigzag_price", "zigzag_direction", "zigzag_return", "zigzag_bars")
        return AnalyzeResult(StructType([*_KEYS, StructField("trading_date", shape["trading_date"].dataType), *[StructField(n, DoubleType()) for n in names]]))

    def eval(self, row, deviation=5.0, pivot_legs=10) -> None:
        self.settings = (float(deviation), int(pivot_legs))
        super().eval(row)

    def terminate(self):
        pivots: list = []
        for i, (high, low) in enumerate(zip(*self._candidates(self.settings[1] // 2), strict=True)):
            structure.step(pivots, i, high, low, self.settings[0] / 100.0)
        found = {i: (price, float(direction), structure.swing_return(price, pivots[k - 1][1]) if k else None, float(i - pivots[k - 1][0]) if k else None) for k, (i, price, direction) in enumerate(pivots)}
        for i, r in enumerate(self.rows):
            yield (*r[:3], *found.get(i, (None, 0.0, None, None)))


class ZigzagState(_Bars):
    """zigzag_state(TABLE, deviation, pivot_legs): what was known at each row."""

    def __init__(self, *args, **kwargs):
        super().__init__()
        self.settings = (5.0, 10)

    @staticmethod
    def analyze(table, deviation=None, pivot_legs=None) -> AnalyzeResult:
        shape = _input(table, "provider", "ticker", "trading_date", "high", "low")
        structure._check_zigzag(float(_constant(deviation, "deviation", 5.0)), int(_constant(pivot_legs, "pivot_legs", 10)))
        return AnalyzeResult(StructType([*_KEYS, StructField("trading_date", shape["trading_date"].dataType), *[StructField(n, DoubleType()) for n in structure.STATE]]))

    def eval(self, row, deviation=5.0, pivot_legs=10) -> None:
        self.settings = (float(deviation), int(pivot_legs))
        super().eval(row)

    def terminate(self):
        legs, pivots = self.settings[1] // 2, []
        highs, lows = self._candidates(legs)
        state = structure.state_of(pivots, 4, 6)
        for i, r in enumerate(self.rows):
            at = i - legs
            if at >= 0 and (highs[at] is not None or lows[at] is not None):
                structure.step(pivots, at, highs[at], lows[at], self.settings[0] / 100.0)
                state = structure.state_of(pivots, 4, 6)
            yield (*r[:3], *[state[n] for n in structure.STATE])


class Ewm:
    """ewm(TABLE, alpha, length): the recursive mean of x; the state is three numbers, no row is held."""

    def __init__(self, *args, **kwargs):
        self.mean, self.weight, self.seen = None, 1.0, 0

    @staticmethod
    def analyze(table, alpha, length=None) -> AnalyzeResult:
        shape = _input(table, "provider", "ticker", "trading_date", "x")
        if not 0 < float(_constant(alpha, "alpha", None)) <= 1 or int(_constant(length, "length", 1)) < 1:
            raise ValueError("alpha must be in (0, 1], length positive")
        return AnalyzeResult(StructType([*_KEYS, StructField("trading_date", shape["trading_date"].dataType), StructField("mean", DoubleType())]))

    def eval(self, row, alpha, length=1):
        x, a = row["x"], float(alpha)
        if x is not None and x == x:
            self.seen += 1
            self.mean = x if self.mean is None else (self.weight * (1 - a) * self.mean + a * x) / (self.weight * (1 - a) + a)
            self.weight = 1.0
        elif self.mean is not None:
            self.weight *= 1 - a
        yield row["provider"], row["ticker"], row["trading_date"], self.mean if self.seen >= length else None


_KINDS = {"string": StringType(), "date": DateType(), "double": DoubleType(), "long": LongType(), "int": IntegerType(), "boolean": BooleanType()}
_TRADES = StructType([StructField(n, _KINDS[k]) for n, k in (c.split() for c in backtest.TRADES.split(","))])


class Backtest:
    """backtest(TABLE, rules): the trades of each run. rules: JSON, by run, of what differs from the defaults."""

    def __init__(self, *args, **kwargs):
        self.rows: list[dict] = []
        self.rules = "{}"

    @staticmethod
    def analyze(table, rules) -> AnalyzeResult:
        _input(table, "run", "provider", "ticker", "trading_date", "open", "high", "low", "close", "place", "atr")
        for r in json.loads(_constant(rules, "rules", "{}")).values():
            backtest.Rules(**r)
        return AnalyzeResult(_TRADES)

    def eval(self, row, rules) -> None:
        self.rules = rules
        self.rows.append(row.asDict())

    def terminate(self):
        if self.rows:
            run = self.rows[0]["run"]
            trades, _ = backtest.replay(self.rows, backtest.Rules(**json.loads(self.rules).get(run, {})))
            for t in trades:
                yield tuple(run if n == "run" else t[n] for n in _TRADES.names)


TABLES = {"zigzag": Zigzag, "zigzag_state": ZigzagState, "ewm": Ewm, "backtest": Backtest}


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session; returns their names."""
    for name, parameters, result, expression in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {expression}")
    for name, handler in TABLES.items():
        spark.udtf.register(name, udtf(handler))
    return [*(s[0] for s in SCALARS), *TABLES]


def open_views(spark: SparkSession, bars: DataFrame, signals: DataFrame | None = None, runs: dict[str, backtest.Rules] | None = None) -> list[str]:
    """Temporary views over bars; with signals and runs also backtest_rows, which the table function reads."""
    from barloom.operators import cross_section, quality, targets, trend
    from barloom.plans.catalog import add_default_features

    views = {
        "bars": bars,
        "price_state": quality.price_state(bars),
        "quality_state": quality.quality_state(bars),
        "cleaned_prices": quality.clean_prices(bars),
        "returns": cross_section.add_returns(bars, (1, 5, 20)),
        "average_true_range": trend.add_atr(bars, 14),
        "forward_returns": targets.add_forward_returns(bars, (5, 10)),
    }
    if {"adjusted_close", "volume"} <= set(bars.columns):
        views["default_features"] = add_default_features(bars)
    if signals is not None:
        views["signals"] = signals
        if runs:
            views["backtest_rows"] = backtest._rows_of_runs(bars, signals, runs)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
