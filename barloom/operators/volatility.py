"""Volatility and volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.core import check_length, col, divide, previous, rolling
from barloom.operators.trend import add_atr, sma


def add_atr_percent(df: DataFrame, length: int = 14, name: str = "atr_percent", high="high", low="low", close="close") -> DataFrame:
    return add_atr(df, length, "__atr", high, low, close).withColumn(name, divide(100.0 * F.col("__atr"), close)).drop("__atr")


def adr(length: int = 20, high="high", low="low") -> Column:
    return sma(col(high) - col(low), length)


def adr_percent(length: int = 20, high="high", low="low", close="close") -> Column:
    return divide(100.0 * adr(length, high, low), close)


def bands(x: str | Column, length: int = 20, num_std: float = 2.0) -> tuple[Column, Column, Column]:
    """(middle, upper, lower): the mean and num_std population deviations either way."""
    check_length(length)
    if not num_std > 0:
        raise ValueError("num_std must be positive")
    middle, width = sma(x, length), rolling(F.stddev_pop, x, length) * float(num_std)
    return middle, middle + width, middle - width


def bandwidth(x: str | Column, length: int = 20, num_std: float = 2.0) -> Column:
    middle, upper, lower = bands(x, length, num_std)
    return divide(upper - lower, middle)


def percent_b(x: str | Column, length: int = 20, num_std: float = 2.0) -> Column:
    """Place of x between the bands; NULL in a flat window."""
    _, upper, lower = bands(x, length, num_std)
    flat = rolling(F.max, x, length) == rolling(F.min, x, length)
    return F.when(~flat, divide(col(x) - lower, upper - lower))


def turnover(log: bool = False, close="close", volume="volume") -> Column:
    x = col(close).cast("double") * col(volume)
    return F.log1p(x) if log else x


def turnover_zscore(length: int = 252, log: bool = False, close="close", volume="volume") -> Column:
    """Distance from the median of the length - 1 earlier rows in their population deviations."""
    if length < 2:
        raise ValueError("length must be at least 2")
    x = turnover(log, close, volume)
    middle = previous(lambda c: F.percentile(c, 0.5), x, length - 1)
    flat = previous(F.max, x, length - 1) == previous(F.min, x, length - 1)
    return F.when(~flat, divide(x - middle, previous(F.stddev_pop, x, length - 1)))
