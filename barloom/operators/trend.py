"""Moving averages, oscillators and momentum. Each function adds named columns to a bar frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barloom.functions.core import (
    KEYS, ORDER, adjusted, by_ticker, check_length, check_new, clip_low, col, divide, ema_alpha, ewm, finite, lag, position, previous, rolling, runs, wilder_alpha,
)
from barloom.functions.stored import stored


PREPARED = "__memo_"


def prepare(df: DataFrame, ema_lengths=(10, 12, 20, 26, 50), rsi_length: int = 21, atr_length: int = 14) -> DataFrame:
    """Hidden columns with the recursions that several families need, computed together in one pass over each history.

    Families that find one use it instead of smoothing again: adjusted prices are in __a_*, the rest in __memo_*.
    """
    df = adjusted(df, ("open", "high", "low", "close"), "__a_")
    change = F.col("adjusted_close") - lag("adjusted_close")
    h, lo, c = "__a_high", "__a_low", "__a_close"
    up, down = _movement(h, lo)
    df = df.withColumns({"__tr": true_range(h, lo, c), "__gain": clip_low(change), "__loss": clip_low(-change), "__up": up, "__down": down})
    a, r = wilder_alpha(atr_length), wilder_alpha(rsi_length)
    specs = {f"{PREPARED}{n}_{atr_length}": (x, a, atr_length) for n, x in (("atr", "__tr"), ("up", "__up"), ("down", "__down"))}
    specs |= {f"{PREPARED}{n}_{rsi_length}": (x, r, rsi_length) for n, x in (("gain", "__gain"), ("loss", "__loss"))}
    specs |= {f"{PREPARED}ema_{k}": ("adjusted_close", ema_alpha(k), k) for k in ema_lengths}
    return ewm(df, specs).drop("__tr", "__gain", "__loss", "__up", "__down")


def _smoothed(df: DataFrame, specs: dict[str, tuple[str, float, int]], memo: dict[str, str]) -> DataFrame:
    """ewm, but names whose memo column is there are copied from it."""
    known = {n: F.col(memo[n]) for n in specs if memo.get(n) in df.columns}
    df = df.withColumns(known) if known else df
    rest = {n: s for n, s in specs.items() if n not in known}
    return ewm(df, rest) if rest else df


def sma(x: str | Column, length: int) -> Column:
    check_length(length)
    return rolling(F.avg, col(x).cast("double"), length)


def add_sma(df: DataFrame, x: str, length: int, name: str = "sma") -> DataFrame:
    return df.withColumn(name, sma(x, length))


def add_ema(df: DataFrame, x: str, *lengths: int, names=None) -> DataFrame:
    check_length(*lengths)
    names = names or [f"ema_{k}" for k in lengths]
    memo = {n: f"{PREPARED}ema_{k}" for n, k in zip(names, lengths, strict=True)} if x == "adjusted_close" else {}
    return _smoothed(df, {n: (x, ema_alpha(k), k) for n, k in zip(names, lengths, strict=True)}, memo)


def rolling_vwap(length: int, high="high", low="low", close="close", volume="volume") -> Column:
    """Sum of typical price times volume over the sum of volume."""
    check_length(length)
    price = (col(high) + col(low) + col(close)) / 3.0
    return divide(rolling(F.sum, price * col(volume), length), rolling(F.sum, col(volume).cast("double"), length))


def fraction_above(x: str | Column, ema: str, lookback: int, exclude_current: bool = False) -> Column:
    """Share of the last rows on which x is above its EMA; a row whose EMA is missing is missing."""
    above = F.when(F.col(ema).isNotNull() & col(x).isNotNull(), (col(x) > F.col(ema)).cast("double"))
    return previous(F.avg, above, lookback) if exclude_current else rolling(F.avg, above, lookback)


def add_rsi(df: DataFrame, x: str, length: int = 14, name: str = "rsi") -> DataFrame:
    """100 * gain / (gain + loss), both smoothed from the second row on; NULL for a flat history."""
    check_length(length)
    change = col(x) - lag(x)
    df = df.withColumns({"__gain": clip_low(change), "__loss": clip_low(-change)})
    memo = {"__g": f"{PREPARED}gain_{length}", "__l": f"{PREPARED}loss_{length}"} if x == "adjusted_close" else {}
    df = _smoothed(df, {"__g": ("__gain", wilder_alpha(length), length), "__l": ("__loss", wilder_alpha(length), length)}, memo)
    return df.withColumn(name, divide(100.0 * F.col("__g"), F.col("__g") + F.col("__l"))).drop("__gain", "__loss", "__g", "__l")


def add_stochastic(df: DataFrame, k_length: int = 14, k_smoothing: int = 3, d_length: int = 3, high="high", low="low", close="close") -> DataFrame:
    check_length(k_length, k_smoothing, d_length)
    floor, top = rolling(F.min, low, k_length), rolling(F.max, high, k_length)
    df = df.withColumn("__raw", divide(100.0 * (col(close) - floor), top - floor))
    df = df.withColumn("stochastic_k", sma("__raw", k_smoothing))
    return df.withColumn("stochastic_d", sma("stochastic_k", d_length)).drop("__raw")


def _fast_slow(df: DataFrame, x: str, lengths, kind: str, line: Column, names) -> DataFrame:
    fast, slow, signal = lengths
    check_length(fast, slow, signal)
    if fast >= slow:
        raise ValueError("the fast length must be below the slow one")
    df = add_ema(df, x, fast, slow, names=("__fast", "__slow"))
    df = ewm(df.withColumn(names[0], line), {names[1]: (names[0], ema_alpha(signal), signal)})
    return df.withColumn(names[2], F.col(names[0]) - F.col(names[1])).drop("__fast", "__slow")


def add_macd(df: DataFrame, x: str = "close", lengths=(12, 26, 9), names=("macd", "macd_signal", "macd_histogram")) -> DataFrame:
    return _fast_slow(df, x, lengths, "macd", F.col("__fast") - F.col("__slow"), names)


def add_ppo(df: DataFrame, x: str = "close", lengths=(12, 26, 9), use_percent: bool = True, names=("ppo", "ppo_signal", "ppo_histogram")) -> DataFrame:
    line = divide(F.col("__fast") - F.col("__slow"), "__slow") * (100.0 if use_percent else 1.0)
    return _fast_slow(df, x, lengths, "ppo", line, names)


def true_range(high="high", low="low", close="close") -> Column:
    """Largest of the three ranges; those that need a missing previous close are left out."""
    before = lag(close)
    return F.greatest(col(high) - col(low), F.abs(col(high) - before), F.abs(col(low) - before))


def add_atr(df: DataFrame, length: int = 14, name: str = "atr", high="high", low="low", close="close") -> DataFrame:
    check_length(length)
    check_new(df, [name])
    memo = {name: f"{PREPARED}atr_{length}"} if close == "__a_close" else {}
    df = df.withColumn("__tr", true_range(high, low, close))
    return _smoothed(df, {name: ("__tr", wilder_alpha(length), length)}, memo).drop("__tr")


def _movement(high, low) -> tuple[Column, Column]:
    """Directional movements up and down; 0 where the other side is as strong, and on the first row."""
    up, down = col(high) - lag(high), lag(low) - col(low)
    move = lambda a, b: F.when(F.coalesce((a > b) & (a > 0), F.lit(False)), a).otherwise(0.0)
    return move(up, down), move(down, up)


def add_adx(df: DataFrame, length: int = 14, high="high", low="low", close="close") -> DataFrame:
    """plus_di, minus_di and adx. On the first row a directional movement is 0, not missing."""
    check_length(length)
    check_new(df, ("adx", "plus_di", "minus_di"))
    up, down = _movement(high, low)
    df = df.withColumns({"__up": up, "__down": down, "__tr": true_range(high, low, close)})
    a = wilder_alpha(length)
    memo = {n: f"{PREPARED}{m}_{length}" for n, m in (("__u", "up"), ("__d", "down"), ("__t", "atr"))} if close == "__a_close" else {}
    df = _smoothed(df, {"__u": ("__up", a, length), "__d": ("__down", a, length), "__t": ("__tr", a, length)}, memo)
    df = df.withColumns({"plus_di": divide(100.0 * F.col("__u"), "__t"), "minus_di": divide(100.0 * F.col("__d"), "__t")})
    dx = divide(100.0 * F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di"))
    return ewm(df.withColumn("__dx", dx), {"adx": ("__dx", a, length)}).drop("__up", "__down", "__tr", "__u", "__d", "__t", "__dx")


def add_mfi(df: DataFrame, length: int = 14, name: str = "mfi", high="high", low="low", close="close", volume="volume") -> DataFrame:
    check_length(length)
    df = df.withColumn("__tp", (col(high) + col(low) + col(close)) / 3.0)
    change, flow = F.col("__tp") - lag("__tp"), F.col("__tp") * col(volume)
    df = df.withColumns({"__pos": F.when(change > 0, flow).when(change <= 0, 0.0), "__neg": F.when(change < 0, flow).when(change >= 0, 0.0)})
    pos, neg = rolling(F.sum, "__pos", length), rolling(F.sum, "__neg", length)
    return df.withColumn(name, divide(100.0 * pos, pos + neg)).drop("__tp", "__pos", "__neg")


def earlier_at_most(v):
    """For each value, how many before it are at most it; NaN counts for nothing. Compared in slices: n * n / 2 steps."""
    import numpy as np

    v = np.asarray(v, np.float64)
    out = np.zeros(len(v), np.int64)
    for a in range(0, len(v), 512):
        own = v[a : a + 512]
        for c in range(0, a, 4096):
            out[a : a + 512] += (v[None, c : min(a, c + 4096)] <= own[:, None]).sum(axis=1)
        out[a : a + 512] += np.tril(own[None, :] <= own[:, None], -1).sum(axis=1)
    return out


def add_expanding_percentile(df: DataFrame, x: str, min_history: int = 1, name: str = "ppo_percentile", block: int | None = None) -> DataFrame:
    """Share of an instrument's earlier values that are at most the value; NULL with fewer than min_history of them.

    With ``block``, no task holds more than that many rows of a history at a time: rows are cut into blocks of time and into ranges
    of value, both of ``block`` rows. What is earlier and at most the value is in an earlier block and a lower range (running sums
    over counts by block and range), in the same range of an earlier block (compared within the range), or in the same block
    (compared within the block). Without it a history is one group: right for daily bars, of which decades are some thousands.
    """
    check_length(min_history)
    check_new(df, [name])
    if block is not None:
        return _percentile_in_blocks(df, x, min_history, name, block)

    def rank(_, bars):
        import numpy as np
        import pyarrow as pa

        bars = bars.sort_by(ORDER)
        v = bars.column(x).to_numpy().astype(np.float64)
        here = ~np.isnan(v)
        before = np.cumsum(here) - here
        share = np.where(here & (before >= min_history), earlier_at_most(v) / np.maximum(before, 1), np.nan)
        return bars.append_column(name, pa.array(share, pa.float64(), from_pandas=True))

    return df.groupBy(*KEYS).applyInArrow(rank, StructType([*df.schema.fields, StructField(name, DoubleType())]))


def _percentile_in_blocks(df: DataFrame, x: str, min_history: int, name: str, block: int) -> DataFrame:
    check_length(block)
    own = Window.partitionBy(*KEYS)
    rows = df.select(*KEYS, ORDER, finite(x).alias("v")).filter("v IS NOT NULL")
    rows = rows.withColumn("at", F.row_number().over(own.orderBy(ORDER)) - 1).withColumn("place", F.row_number().over(own.orderBy("v", "at")) - 1)
    rows = stored(rows.withColumns({"block": F.floor(F.col("at") / block), "range": F.floor(F.col("place") / block)}), "ranked")
    cells = rows.groupBy(*KEYS, "block", "range").agg(F.count(F.lit(1)).alias("n"))
    # of each block that has a row in a range: rows of earlier blocks in lower ranges
    grid = cells.select(*KEYS, "block").distinct().join(cells.select(*KEYS, "range").distinct(), list(KEYS)).join(cells, [*KEYS, "block", "range"], "left")
    lower = F.coalesce(F.sum("n").over(Window.partitionBy(*KEYS, "block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = F.coalesce(F.sum("lower").over(Window.partitionBy(*KEYS, "range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    corner = grid.withColumn("lower", lower).withColumn("corner", earlier).filter("n IS NOT NULL").select(*KEYS, "block", "range", "corner")

    def compared(within: str, other: str):
        """Counts of earlier rows at most the row, in the same ``within``; of other blocks only where that is a range."""

        def run(_, t):
            import pyarrow as pa

            t = t.sort_by("at")
            v, k = t.column("v").to_numpy(), t.column(other).to_numpy()
            n = earlier_at_most(v)
            if within == "range":  # not those of the same block
                for b in set(k.tolist()):
                    same = k == b
                    n[same] -= earlier_at_most(v[same])
            return pa.table({**{c: t.column(c) for c in (*KEYS, "at")}, "n": pa.array(n)})

        kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in KEYS)
        return rows.groupBy(*KEYS, within).applyInArrow(run, f"{kinds}, at int, n long").withColumnRenamed("n", f"in_{within}")

    found = rows.join(corner, [*KEYS, "block", "range"]).join(compared("block", "range"), [*KEYS, "at"]).join(compared("range", "block"), [*KEYS, "at"])
    share = F.when(F.col("at") >= min_history, F.try_divide(F.col("corner") + F.col("in_block") + F.col("in_range"), F.col("at").cast("double")))
    return df.join(found.select(*KEYS, ORDER, share.alias(name)), [*KEYS, ORDER], "left").select(*df.columns, name)


def linreg_endpoint(x: str | Column, length: int, offset: int = 0) -> Column:
    """The fitted value, at position length - 1 - offset, of the line through the last ``length`` values."""
    check_length(length)
    x = col(x)
    if length == 1:
        return x.cast("double")
    at = F.col("__at").cast("double")
    w = by_ticker(1 - length, 0)
    fit = F.regr_intercept(x, at).over(w) + F.regr_slope(x, at).over(w) * (at - float(offset))
    return F.when(F.count(x).over(w) == length, fit)


def add_squeeze(
    df: DataFrame, bb_length: int = 20, bb_mult: float = 2.0, kc_length: int = 20, kc_mult: float = 1.5, atr_length: int = 14, high="high", low="low", close="close",
) -> DataFrame:
    """Bollinger bands against Keltner channels (mean true range): state, release, width, momentum and durations."""
    names = ("squeeze_on", "squeeze_off", "squeeze_released", "squeeze_width_ratio", "squeeze_momentum", "squeeze_momentum_atr", "squeeze_momentum_atr_change", "squeeze_duration", "squeeze_release_duration")
    check_new(df, names)
    check_length(bb_length, kc_length, atr_length)
    c = col(close)
    df = df.withColumns(
        {
            "__tr": true_range(high, low, close), "__at": position(), "__bm": sma(c, bb_length), "__bs": rolling(F.stddev_pop, c, bb_length) * bb_mult,
            "__km": sma(c, kc_length), "__mid": (rolling(F.max, high, kc_length) + rolling(F.min, low, kc_length)) / 2.0,
        }
    )
    df = df.withColumns({"__kr": sma("__tr", kc_length) * kc_mult, "__x": c - (F.col("__mid") + F.col("__km")) / 2.0})
    b_low, b_top = F.col("__bm") - F.col("__bs"), F.col("__bm") + F.col("__bs")
    k_low, k_top = F.col("__km") - F.col("__kr"), F.col("__km") + F.col("__kr")
    df = df.withColumns({
        "squeeze_on": (b_low > k_low) & (b_top < k_top), "squeeze_off": (b_low < k_low) & (b_top > k_top),
        "squeeze_width_ratio": divide(b_top - b_low, k_top - k_low), "squeeze_momentum": linreg_endpoint("__x", kc_length),
    })
    was = F.lag("squeeze_on", 1, False).over(by_ticker())
    df = df.withColumn("squeeze_released", was & ~F.col("squeeze_on"))
    df = _smoothed(df, {"__atr": ("__tr", wilder_alpha(atr_length), atr_length)}, {"__atr": f"{PREPARED}atr_{atr_length}"} if close == "__a_close" else {})
    df = df.withColumn("squeeze_momentum_atr", divide("squeeze_momentum", "__atr"))
    df = df.withColumn("squeeze_momentum_atr_change", F.col("squeeze_momentum_atr") - lag("squeeze_momentum_atr"))
    df = runs(df, F.col("squeeze_on"), "squeeze_duration")
    ended = F.when(F.col("squeeze_released"), lag("squeeze_duration"))
    return df.withColumn("squeeze_release_duration", ended).drop("__tr", "__at", "__bm", "__bs", "__km", "__mid", "__kr", "__x", "__atr")
