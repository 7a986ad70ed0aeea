"""Future-looking targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.core import ORDER, add_percentile, adjusted, by_date, by_ticker, check_length, check_new, col, divide, finite, frame, lead
from barloom.operators.cross_section import add_calendar
from barloom.operators.trend import add_atr

COST = 0.0025
YEARLY = 1.5
#: the return over five of 252 sessions that pays both commissions and a yearly gain of a half
FIXED_RETURN = (1 + COST + YEARLY ** (5 / 252) - 1) / (1 - COST) - 1
POLICIES = ("stop_loss_first", "take_profit_first", "candle_path", "exclude")


def add_forward_returns(df: DataFrame, horizons=(5, 10, 15), x: str = "adjusted_close") -> DataFrame:
    check_length(*horizons)
    names = [f"forward_return_{h}d" for h in horizons]
    check_new(df, names)
    ok = lambda c: F.when(finite(c) > 0, finite(c))
    return df.withColumns({n: divide(ok(lead(x, h)), ok(F.col(x))) - 1.0 for n, h in zip(names, horizons, strict=True)})


def above(forward_return: str | Column, threshold: float = FIXED_RETURN) -> Column:
    return col(forward_return) > float(threshold)


def add_future_max_returns(df: DataFrame, horizons=(5, 10, 15)) -> DataFrame:
    """Highest high of the next h rows over the next open; raw prices, NULL if any of them is missing."""
    check_length(*horizons)
    names = [f"future_max_return_{h}d" for h in horizons]
    check_new(df, names)
    return df.withColumns({n: divide(frame(F.max, "high", 1, h), lead("open")) - 1.0 for n, h in zip(names, horizons, strict=True)})


def add_cross_sectional_targets(df: DataFrame, horizons=(5, 10, 15), relevance_grade_count: int = 16, minimum_cross_section_size: int = 20) -> DataFrame:
    """Forward return relative to the market's mean, its percentile on the date, and a grade; by the future calendar."""
    check_length(*horizons, relevance_grade_count, minimum_cross_section_size)
    kept, out = df.columns, []
    df = add_calendar(df, horizons, future=True)
    positive = F.when(finite("adjusted_close") > 0, finite("adjusted_close"))
    df = df.withColumn("__p", positive)
    df = df.withColumns({f"__f_{h}": F.when(F.col(f"__on_{h}"), divide(lead("__p", h), "__p") - 1.0) for h in horizons})
    for h in horizons:
        r, group = F.col(f"__f_{h}"), by_date()
        mean = F.when(F.count(r).over(group) >= minimum_cross_section_size, F.avg(r).over(group))
        names = [f"market_relative_forward_return_{h}d", f"forward_return_{h}d_cross_sectional_percentile", f"forward_return_{h}d_relevance_grade"]
        check_new(df, names)
        df = df.withColumn(names[0], F.when((1 + r > 0) & (1 + mean > 0), divide(1 + r, 1 + mean) - 1.0))
        df = add_percentile(df, r, names[1], minimum_cross_section_size)
        top = relevance_grade_count - 1
        df = df.withColumn(names[2], F.when(F.col(names[1]).isNotNull(), F.greatest(F.lit(0), F.least(F.lit(top), F.floor(F.col(names[1]) * relevance_grade_count)))).cast("long"))
        out += names
    return df.select(*kept, *out)


def valid_bar(open_="open", high="high", low="low", close="close") -> Column:
    o, h, lo, c = (finite(x) for x in (open_, high, low, close))
    return F.coalesce((lo > 0) & (o > 0) & (h >= F.greatest(o, c)) & (lo <= F.least(o, c)) & (c > 0) & (h > 0), F.lit(False))


def add_triple_barrier(
    df: DataFrame, horizons=(5, 10), atr_length: int = 14, stop_atr_multiple: float = 1.0, reward_risk_ratio: float = 2.0, intrabar_policy: str = "stop_loss_first",
) -> DataFrame:
    """First barrier that the next h rows touch: label (-1 stop, 1 target, 0 none), bars until then, and its date.

    The entry is the next open; a gap over a barrier at the open counts first; a bar that touches both goes by the policy. The
    rows ahead are gathered once for the longest horizon and folded up to the first event.
    """
    check_length(*horizons, atr_length)
    if intrabar_policy not in POLICIES:
        raise ValueError(f"intrabar_policy must be one of {POLICIES}")
    kept, most = df.columns, max(horizons)
    factor = F.when(divide("adjusted_close", "close") > 0, divide("adjusted_close", "close"))
    df = df.withColumns({f"__{c}": finite(c) * factor for c in ("open", "high", "low")} | {"__close": F.when(factor.isNotNull(), finite("adjusted_close"))})
    df = df.withColumn("__ok", valid_bar("__open", "__high", "__low", "__close"))
    df = df.withColumns({f"__v{c}": F.when(F.col("__ok"), F.col(f"__{c}")) for c in ("high", "low", "close")})
    df = add_atr(df, atr_length, "__atr", "__vhigh", "__vlow", "__vclose")
    ahead = F.collect_list(F.struct(F.col("__open").alias("o"), F.col("__high").alias("h"), F.col("__low").alias("l"), F.col("__close").alias("c"), F.col("__ok").alias("ok"), F.col(ORDER).alias("d")))
    df = df.withColumn("__ahead", ahead.over(by_ticker(1, most)))
    entry = F.when(F.get("__ahead", F.lit(0))["ok"], F.get("__ahead", F.lit(0))["o"])
    risk = F.when(F.col("__atr") > 0, F.col("__atr") * float(stop_atr_multiple))
    df = df.withColumns({"__entry": entry, "__stop": F.when(F.col("__ok"), entry - risk), "__target": entry + risk * float(reward_risk_ratio)})
    stop, target = F.col("__stop"), F.col("__target")

    def both(b: Column) -> Column:
        return {"stop_loss_first": F.lit(-1), "take_profit_first": F.lit(1), "candle_path": F.when(b["c"] < b["o"], 1).otherwise(-1), "exclude": F.lit(9)}[intrabar_policy]

    def event(b: Column) -> Column:  # 0: none, 8: an invalid bar, 9: excluded
        hit_stop, hit_target = b["l"] <= stop, b["h"] >= target
        return (
            F.when(~b["ok"], 8).when(b["o"] <= stop, -1).when(b["o"] >= target, 1)
            .when(hit_stop & hit_target, both(b)).when(hit_stop, -1).when(hit_target, 1).otherwise(0)
        )

    df = df.withColumn("__events", F.transform("__ahead", event))
    df = df.withColumn("__first", F.array_position(F.transform("__events", lambda e: e != 0), True).cast("int"))
    out = {}
    for h in horizons:
        names = [f"triple_barrier_label_{h}d", f"time_to_event_{h}d", f"target_end_date_{h}d"]
        check_new(df, names)
        hit = F.col("__first").between(1, h)
        what = F.when(hit, F.get("__events", F.col("__first") - 1)).when(F.size("__ahead") >= h, 0)
        label = F.when(stop.isNotNull() & (stop > 0) & what.between(-1, 1), what)
        at = F.when(hit, F.col("__first")).otherwise(h)
        out |= {names[0]: label.cast("int"), names[1]: F.when(label.isNotNull(), at).cast("long"), names[2]: F.when(label.isNotNull(), F.get("__ahead", at - 1)["d"])}
    return df.withColumns(out).select(*kept, *out)
