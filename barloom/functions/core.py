"""Building blocks over keyed bars: windows, null-safe arithmetic, rolling frames, recursive smoothing, runs.

A bar frame is a DataFrame with key columns (provider, ticker) and an order column (trading_date). Missing is NULL;
NaN and infinities are turned into NULL where numbers are made. Every window is partitioned by the keys, so an
instrument is the unit of work and all indicators of a frame share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

KEYS = ("provider", "ticker")
ORDER = "trading_date"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def by_ticker(first: int | None = None, last: int | None = None, keys=KEYS, order: str = ORDER) -> WindowSpec:
    """Rows of an instrument in order; with a frame [first, last] relative to the row if given."""
    w = Window.partitionBy(*keys).orderBy(order)
    return w if first is None and last is None else w.rowsBetween(first, last)


def so_far(keys=KEYS, order: str = ORDER) -> WindowSpec:
    return by_ticker(Window.unboundedPreceding, Window.currentRow, keys, order)


def by_date(*order, keys=("provider",), date: str = ORDER) -> WindowSpec:
    w = Window.partitionBy(*keys, date)
    return w.orderBy(*order) if order else w


def finite(x: str | Column) -> Column:
    x = col(x).cast("double")
    return F.when(F.abs(x) < float("inf"), x)  # NaN is greater than every number, so it fails too


def divide(a: str | Column, b: str | Column) -> Column:
    """a / b; NULL if b is 0, or if b or the result is not finite."""
    b = finite(b)
    return finite(F.try_divide(col(a).cast("double"), b))


def clip_low(x: Column, least: float = 0.0) -> Column:
    """max(x, least) that keeps NULL."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(least))))


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(col(x), n).over(by_ticker())


def lead(x: str | Column, n: int = 1) -> Column:
    return F.lead(col(x), n).over(by_ticker())


def frame(agg, x: str | Column, first: int, last: int) -> Column:
    """agg over rows [first, last], NULL unless all of them are there and not missing."""
    x, w = col(x), by_ticker(first, last)
    return F.when(F.count(x).over(w) == last - first + 1, agg(x).over(w))


def rolling(agg, x: str | Column, length: int) -> Column:
    return frame(agg, x, 1 - length, 0)


def previous(agg, x: str | Column, length: int) -> Column:
    """agg over the ``length`` rows before the row."""
    return frame(agg, x, -length, -1)


def position(keys=KEYS, order: str = ORDER) -> Column:
    return F.row_number().over(by_ticker(keys=keys, order=order))


def check_new(df: DataFrame, names) -> None:
    taken = [n for n in names if n in df.columns]
    if taken:
        raise ValueError(f"columns already exist: {taken}")


def check_has(df: DataFrame, names) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")


def check_length(*lengths: int) -> None:
    for n in lengths:
        if isinstance(n, bool) or not isinstance(n, int) or n < 1:
            raise ValueError(f"a length must be a positive integer, not {n!r}")


def ewm(df: DataFrame, specs: dict[str, tuple[str, float, int]], keys=KEYS, order: str = ORDER) -> DataFrame:
    """Recursive smoothing: adds, for each name, the mean of a column with weight alpha for the newest value.

    specs: name -> (column, alpha, length). The recursion starts at the first value; a missing value repeats the last
    result and lets the old weight decay; a result needs ``length`` values so far. An instrument's history is one
    group: all recursions of a call are computed in one Arrow pass over it, and other columns are passed as they are.
    """
    check_new(df, specs)
    fields = [*df.schema.fields, *(StructField(n, DoubleType()) for n in specs)]

    def smooth(_, bars):
        import pandas as pd
        import pyarrow as pa

        bars = bars.sort_by(order)
        for name, (column, alpha, length) in specs.items():
            x = pd.Series(bars.column(column).to_numpy(), dtype="float64")
            y = x.ewm(alpha=alpha, adjust=False, ignore_na=False, min_periods=length).mean()
            bars = bars.append_column(name, pa.array(y, pa.float64(), from_pandas=True))
        return bars

    return df.groupBy(*keys).applyInArrow(smooth, StructType(fields))


def ema_alpha(length: int) -> float:
    return 2.0 / (length + 1)


def wilder_alpha(length: int) -> float:
    return 1.0 / length


def runs(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """Adds the number of consecutive rows up to the row where the condition holds: 0 where it doesn't, NULL (and a new
    start) where it is missing."""
    df = df.withColumn("__on", condition)
    df = df.withColumn("__run", F.sum(F.when(F.coalesce("__on", F.lit(False)), 0).otherwise(1)).over(so_far()))
    inside = Window.partitionBy(*KEYS, "__run").orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0)
    length = F.sum(F.col("__on").cast("long")).over(inside)
    return df.withColumn(name, F.when(F.col("__on"), length).when(~F.col("__on"), F.lit(0))).drop("__on", "__run")


def adjusted(df: DataFrame, columns=("open", "high", "low", "close"), prefix: str = "adj_") -> DataFrame:
    """Prices on the scale of adjusted_close, under prefixed names; NULL where the factor is."""
    factor = divide("adjusted_close", "close")
    new = {f"{prefix}{c}": F.col(c) * factor for c in columns if c != "close"}
    if "close" in columns:
        new[f"{prefix}close"] = F.when(factor.isNotNull(), F.col("adjusted_close").cast("double"))
    return df.withColumns(new)


def add_percentile(df: DataFrame, x: str | Column, name: str, least: int, keys=("provider",), date: str = ORDER) -> DataFrame:
    """(average rank - 0.5) / count of x among the rows of its date; NULL where x is, or with fewer than ``least`` values."""
    group = Window.partitionBy(*keys, date)
    df = df.withColumn("__v", finite(x))
    n = F.count("__v").over(group)
    first = F.rank().over(group.orderBy(F.col("__v").asc_nulls_last()))
    ties = F.count("__v").over(Window.partitionBy(*keys, date, "__v"))
    rank = first + (ties - 1) / 2.0
    return df.withColumn(name, F.when(F.col("__v").isNotNull() & (n >= least), (rank - 0.5) / n)).drop("__v")
