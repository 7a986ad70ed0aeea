"""State of stored bars by ticker, and the gates that decide who may be scored or trained on."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.bars import as_date


@dataclass(frozen=True)
class Thresholds:
    inference_rows: int = 252
    stale_days: int = 4
    training_rows: int = 756
    sparse_volume: float = 0.05
    turnover_rows: int = 60
    turnover_share: float = 0.95
    turnover: int = 5_000_000

    @property
    def turnover_needed(self) -> int:
        return math.ceil(self.turnover_rows * self.turnover_share)


def _scope(bars: DataFrame, provider=None, tickers=None, start_date=None, end_date=None) -> DataFrame:
    if provider is not None:
        bars = bars.filter(F.col("provider") == provider)
    if tickers is not None:
        bars = bars.filter(F.col("ticker").isin(list(tickers)))
    if start_date is not None:
        bars = bars.filter(F.col("trading_date") >= F.lit(as_date(start_date)))
    if end_date is not None:
        bars = bars.filter(F.col("trading_date") <= F.lit(as_date(end_date)))
    return bars


def price_state(bars: DataFrame, provider=None, tickers=None, end_date=None) -> DataFrame:
    """(ticker, row_count, first_date, last_date)."""
    return _scope(bars, provider, tickers, end_date=end_date).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date")
    )


def available_tickers(bars: DataFrame, provider=None, start_date=None, end_date=None) -> DataFrame:
    return _scope(bars, provider, None, start_date, end_date).select("ticker").distinct()


def quality_state(bars: DataFrame, provider=None, tickers=None, end_date=None, t: Thresholds = Thresholds()) -> DataFrame:
    """price_state with counts of missing adjusted closes and of empty volumes, and the turnover of the latest rows.

    The latest ``turnover_rows`` rows count whether they are usable or not; the turnover is the exact median of the usable ones.
    """
    rows = _scope(bars, provider, tickers, end_date=end_date)
    at = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("trading_date")))
    usable = F.col("close").isNotNull() & (F.col("volume") > 0) & (F.col("__at") <= t.turnover_rows)
    turnover = F.when(usable, F.col("close") * F.col("volume"))
    rows = rows.withColumn("__at", at).withColumn("__turnover", turnover)
    return rows.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"),
        F.count_if(F.col("adjusted_close").isNull()).alias("missing_adjusted_close"),
        F.count_if(F.col("volume").isNull() | (F.col("volume") <= 0)).alias("empty_volume"),
        F.count("__turnover").alias("turnover_observations"), F.percentile("__turnover", 0.5).alias("median_turnover"),
    )


def _gate(bars: DataFrame, requested: DataFrame, rows: int, as_of: Column | None, provider, end_date, t: Thresholds) -> DataFrame:
    state = requested.select("ticker").distinct().join(quality_state(bars, provider, None, end_date, t), "ticker", "left")
    there = F.col("row_count").isNotNull()
    few = F.col("turnover_observations") < t.turnover_needed
    reasons = [
        F.when(~there, "missing"),
        F.when(F.col("missing_adjusted_close") > 0, "missing_adjusted_close"),
        F.when(F.col("empty_volume") / F.col("row_count") > t.sparse_volume, "sparse_volume"),
        F.when(there & few, "insufficient_turnover_observations").when(there & (F.col("median_turnover").isNull() | (F.col("median_turnover") < t.turnover)), "low_liquidity"),
        F.when(F.col("row_count") < rows, "insufficient_history"),
    ]
    if as_of is not None:
        reasons.append(F.when(F.datediff(as_of, "last_date") > t.stale_days, "stale"))
    return state.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("ok", F.size("reasons") == 0)


def inference_readiness(bars: DataFrame, requested: DataFrame, as_of: dt.date | str, provider=None, t: Thresholds = Thresholds()) -> DataFrame:
    """The state of each requested ticker, why it can't be scored (reasons), and whether it can (ok)."""
    return _gate(bars, requested, t.inference_rows, F.lit(as_date(as_of)), provider, None, t)


def training_eligibility(bars: DataFrame, requested: DataFrame, cutoff: dt.date | str | None = None, provider=None, t: Thresholds = Thresholds()) -> DataFrame:
    """The same for training: a longer history, nothing after the cutoff, no staleness."""
    return _gate(bars, requested, t.training_rows, None, provider, cutoff, t)


def passing(gate: DataFrame) -> DataFrame:
    return gate.filter("ok").select("ticker")


def onboarding(active: DataFrame, bars: DataFrame, provider=None) -> DataFrame:
    """Each active ticker with whether any bar of it is stored."""
    state = price_state(bars, provider)
    return active.select("ticker").distinct().join(state, "ticker", "left").select("ticker", F.when(F.col("row_count") > 0, "onboarded").otherwise("missing").alias("status"), F.coalesce("row_count", F.lit(0)).alias("row_count"), "first_date", "last_date")


def update_plan(active: DataFrame, bars: DataFrame, end: dt.date | str, provider=None) -> DataFrame:
    """What to fetch: from the last stored day, which is fetched again, to the end; nothing for tickers that are up to it."""
    start = price_state(bars, provider).select("ticker", F.col("last_date").alias("start_date"))
    return active.select("ticker").distinct().join(start, "ticker").filter(F.col("start_date") < F.lit(as_date(end))).withColumn("end_date", F.lit(as_date(end)))


def clean_prices(bars: DataFrame) -> DataFrame:
    """Bars for labelling: no-volume repeats of the bar before are dropped, prices adjusted, bad factors and bars dropped."""
    from barloom.functions.core import divide, finite, lag
    from barloom.operators.targets import valid_bar

    same = F.lit(True)
    for c in ("open", "high", "low", "close"):
        same = same & (F.abs(F.col(c) - lag(c)) <= 1e-10)
    rows = bars.withColumn("__repeat", F.coalesce((F.col("volume") == 0) & same, F.lit(False))).filter("NOT __repeat")
    factor = divide("adjusted_close", "close")
    rows = rows.withColumn("__f", F.when(factor > 0, factor)).filter("__f IS NOT NULL")
    rows = rows.withColumns({**{c: finite(c) * F.col("__f") for c in ("open", "high", "low")}, "close": finite("adjusted_close")})
    return rows.filter(valid_bar()).drop("__repeat", "__f")
