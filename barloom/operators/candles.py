"""Candlesticks and price levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import KEYS, ORDER, by_ticker, check_length, clip_low, col, divide, lag, previous, rolling, runs, so_far
from barloom.operators.trend import add_atr, true_range

LEVEL_NAMES = ("close_to_upper_atr", "close_to_lower_atr", "breakout_high_strength", "breakout_low_strength", "failed_break_high_strength", "failed_break_low_strength")


def _edges(open_, close) -> tuple[Column, Column]:
    both = col(open_).isNotNull() & col(close).isNotNull()
    return F.when(both, F.greatest(col(open_), col(close))), F.when(both, F.least(col(open_), col(close)))


def geometry(open_="open", high="high", low="low", close="close") -> dict[str, Column]:
    top, bottom = _edges(open_, close)
    size = col(high) - col(low)
    return {
        "signed_body_fraction": divide(col(close) - col(open_), size),
        "upper_wick_fraction": divide(col(high) - top, size),
        "lower_wick_fraction": divide(bottom - col(low), size),
        "close_location": divide(col(close) - col(low), size),
    }


def share_at_most(x: str, length: int) -> Column:
    """Share of the previous ``length`` values that are at most x; all must be there. x is a column."""
    before = F.collect_list(x).over(by_ticker(-length, -1))
    return F.when((F.size(before) == length) & col(x).isNotNull(), F.size(F.filter(before, lambda y: y <= F.col(x))) / float(length))


def add_range_context(df: DataFrame, atr_length: int = 14, percentile_length: int = 20, high="high", low="low", close="close", open_="open") -> DataFrame:
    check_length(atr_length, percentile_length)
    df = add_atr(df, atr_length, "__atr", high, low, close).withColumn("__tr", true_range(high, low, close)).withColumn("__range", col(high) - col(low))
    before = lag("__atr")
    return df.withColumns(
        {
            "range_atr": divide("__tr", before),
            "gap_atr": divide(col(open_) - lag(close), before),
            "range_percentile": share_at_most("__range", percentile_length),
        }
    ).drop("__atr", "__tr", "__range")


def add_patterns(df: DataFrame, atr_length: int = 14, open_="open", high="high", low="low", close="close") -> DataFrame:
    check_length(atr_length)
    df = add_atr(df, atr_length, "__atr", high, low, close)
    top, bottom = _edges(open_, close)
    df = df.withColumns({"__top": top, "__bottom": bottom, "__body": col(close) - col(open_)})
    h, lo, ph, pl = col(high), col(low), lag(high), lag(low)
    pt, pb, pbody, patr = lag("__top"), lag("__bottom"), lag("__body"), lag("__atr")
    body = F.col("__body")
    known = body.isNotNull() & pbody.isNotNull()
    contains = (F.col("__top") >= pt) & (F.col("__bottom") <= pb) & ((F.col("__bottom") < pb) | (F.col("__top") > pt))
    engulfs = F.coalesce(known & (body * pbody < 0) & contains, F.lit(False))
    strength = F.when(engulfs, divide(body, F.abs(body)) * divide(F.abs(body) - F.abs(pbody), patr)).otherwise(0.0)
    place = divide(col(close) - lo, h - lo)
    df = df.withColumns(
        {
            "inside_bar": (h <= ph) & (lo >= pl) & ((h < ph) | (lo > pl)),
            "outside_bar": (h >= ph) & (lo <= pl) & ((h > ph) | (lo < pl)),
            "engulfing_strength": F.when(known & patr.isNotNull(), strength),
            "lower_rejection_strength": divide(F.col("__bottom") - lo, patr) * place,
            "upper_rejection_strength": divide(h - F.col("__top"), patr) * (1.0 - place),
        }
    )
    comparable = h.isNotNull() & lo.isNotNull() & ph.isNotNull() & pl.isNotNull()
    df = df.withColumns({c: F.when(comparable, F.col(c)) for c in ("inside_bar", "outside_bar")})
    return runs(df, F.col("inside_bar"), "consecutive_inside_bars").drop("__atr", "__top", "__bottom", "__body")


def add_direction_runs(df: DataFrame, atr_length: int = 14, open_="open", high="high", low="low", close="close") -> DataFrame:
    check_length(atr_length)
    df = add_atr(df, atr_length, "__atr", high, low, close)
    body = col(close) - col(open_)
    df = df.withColumns({"__dir": F.signum(body).cast("int"), "__body_atr": divide(body, lag("__atr"))})
    active = F.coalesce(F.col("__dir") != 0, F.lit(False))
    fresh = ~active | F.coalesce(F.col("__dir") != lag("__dir"), F.lit(True))
    df = df.withColumns({"__run": F.sum(fresh.cast("int")).over(so_far()), "__base": F.when(active & fresh, lag(close))})
    inside = Window.partitionBy(*KEYS, "__run").orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0)
    base = F.last("__base", ignorenulls=True).over(inside)
    whole = F.bool_and(F.col("__body_atr").isNotNull()).over(inside)
    known = F.col("__dir").isNotNull()
    of_run = lambda x: F.when(known, F.when(active, x).otherwise(0.0))
    return df.withColumns(
        {
            "direction_run": F.when(known, F.when(active, F.count(F.lit(1)).over(inside) * F.col("__dir")).otherwise(0)).cast("long"),
            "direction_run_return": of_run(divide(close, base) - 1.0),
            "direction_run_body_atr": of_run(F.when(whole, F.sum("__body_atr").over(inside))),
        }
    ).drop("__atr", "__dir", "__body_atr", "__run", "__base")


def level_interactions(upper: str | Column, lower: str | Column, prior_atr: str | Column, high="high", low="low", close="close") -> dict[str, Column]:
    """Distance of the close from known levels, accepted and failed breakouts, in ATRs known before the row."""
    h, lo, c, up, down, atr = map(col, (high, low, close, upper, lower, prior_atr))
    to_upper, to_lower = divide(c - up, atr), divide(c - down, atr)
    over, under = divide(h - up, atr), divide(down - lo, atr)
    failed = lambda when, x: F.when(x.isNotNull() & c.isNotNull(), F.when(F.coalesce(when, F.lit(False)), x).otherwise(0.0))
    return {
        "close_to_upper_atr": to_upper,
        "close_to_lower_atr": to_lower,
        "breakout_high_strength": clip_low(to_upper),
        "breakout_low_strength": clip_low(-to_lower),
        "failed_break_high_strength": failed((h > up) & (c <= up), over),
        "failed_break_low_strength": failed((lo < down) & (c >= down), under),
    }


def add_level_interactions(df: DataFrame, length: int = 20, atr_length: int = 14, high="high", low="low", close="close") -> DataFrame:
    check_length(length, atr_length)
    df = add_atr(df, atr_length, "__atr", high, low, close)
    df = df.withColumns({"prior_high": previous(F.max, high, length), "prior_low": previous(F.min, low, length), "__patr": lag("__atr")})
    return df.withColumns(level_interactions("prior_high", "prior_low", "__patr", high, low, close)).drop("__atr", "__patr")


def bullish_fraction(lookback: int = 14, exclude_current: bool = False, open_="open", close="close") -> Column:
    check_length(lookback)
    up = (col(close) > col(open_)).cast("double")
    return previous(F.avg, up, lookback) if exclude_current else rolling(F.avg, up, lookback)
