"""Returns, and what compares instruments on a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import KEYS, ORDER, add_percentile, by_date, check_length, check_new, divide, lag, lead


def add_returns(df: DataFrame, horizons=(1, 5, 10, 20), x: str = "adjusted_close") -> DataFrame:
    check_length(*horizons)
    names = [f"return_{h}d" for h in horizons]
    check_new(df, names)
    return df.withColumns({n: divide(x, lag(x, h)) - 1.0 for n, h in zip(names, horizons, strict=True)})


def add_calendar(df: DataFrame, horizons, future: bool = False) -> DataFrame:
    """__on_<h>: the instrument's row h sessions away is h sessions away in the provider's calendar too.

    The calendar is one row a provider and date; a date that the provider has, but not h further ones, has no answer (false).
    """
    move = F.lead if future else F.lag
    shift = lead if future else lag
    dates = df.select("provider", ORDER).distinct()
    ordered = Window.partitionBy("provider").orderBy(ORDER)
    dates = dates.withColumns({f"__e_{h}": move(ORDER, h).over(ordered) for h in horizons})
    df = df.join(dates, ["provider", ORDER], "left")
    own = {f"__on_{h}": F.coalesce(shift(ORDER, h) == F.col(f"__e_{h}"), F.lit(False)) for h in horizons}
    return df.withColumns(own).drop(*[f"__e_{h}" for h in horizons])


def add_cross_section(df: DataFrame, return_horizons=(1, 5, 10, 20), market_return_horizon: int = 1, minimum_cross_section_size: int = 20) -> DataFrame:
    """Percentile of each return on its date, and the market's breadth, mean and median; out-of-step rows count as missing."""
    check_length(*return_horizons, market_return_horizon, minimum_cross_section_size)
    m = market_return_horizon
    every = sorted({*return_horizons, m})
    names = [f"return_{h}d_cross_sectional_percentile" for h in return_horizons]
    market = [f"market_breadth_positive_{m}d", f"market_mean_return_{m}d", f"market_median_return_{m}d"]
    check_new(df, [*names, *market])
    kept = df.columns
    df = add_calendar(df, every)
    x = "adjusted_close"
    df = df.withColumns({f"__r_{h}": F.when(F.col(f"__on_{h}"), divide(x, lag(x, h)) - 1.0) for h in every})
    for n, h in zip(names, return_horizons, strict=True):
        df = add_percentile(df, f"__r_{h}", n, minimum_cross_section_size)
    r, group = F.col(f"__r_{m}"), by_date()
    enough = F.count(r).over(group) >= minimum_cross_section_size
    of = (F.avg((r > 0).cast("double")), F.avg(r), F.percentile(r, 0.5))
    df = df.withColumns({n: F.when(enough, agg.over(group)) for n, agg in zip(market, of, strict=True)})
    return df.select(*kept, *names, *market)
