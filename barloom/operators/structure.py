"""Market structure: channels, pivots and the zigzag."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barloom.functions.core import KEYS, ORDER, adjusted, by_ticker, check_length, check_new, col, divide, frame, lag, position, previous
from barloom.operators.candles import level_interactions
from barloom.operators.trend import add_atr


def donchian(length: int = 20, high="high", low="low") -> tuple[Column, Column]:
    """(highest high, lowest low) of the previous ``length`` rows."""
    check_length(length)
    return previous(F.max, high, length), previous(F.min, low, length)


def donchian_position(length: int = 20, high="high", low="low", close="close") -> Column:
    upper, lower = donchian(length, high, low)
    return divide(col(close) - lower, upper - lower)


def _beyond(x: Column, side: str):
    return (lambda y: y > x) if side == "high" else (lambda y: y < x)


def add_pivot_points(
    df: DataFrame, high_left: int = 10, high_right: int = 10, low_left: int = 10, low_right: int = 10, kind: str = "high_low", rank_output: str = "rank",
) -> DataFrame:
    """Rank of a row's high (low) among its neighbours, and the pivot price where the rank is 1. Looks ahead.

    rank_output "strength" gives 1 - (rank - 1) / (left + right); kind "balanced" prices a pivot at a third of the way
    from the extreme to the body.
    """
    check_length(high_left, high_right, low_left, low_right)
    if kind not in ("high_low", "balanced") or rank_output not in ("rank", "strength"):
        raise ValueError("kind is high_low or balanced; rank_output is rank or strength")
    out = {}
    for side, x, left, right in (("high", "high", high_left, high_right), ("low", "low", low_left, low_right)):
        around = F.collect_list(x).over(by_ticker(-left, right))
        better = F.filter(around, _beyond(F.col(x), side))
        rank = F.when(F.col(x).isNotNull() & (F.size(around) == left + right + 1), F.size(better) + 1)
        body = F.greatest("open", "close") if side == "high" else F.least("open", "close")
        price = F.col(x) if kind == "high_low" else (2.0 * F.col(x) + body) / 3.0
        out[f"pivot_{side}"] = F.when(rank == 1, price)
        out[f"pivot_{side}_{rank_output}"] = rank.cast("long") if rank_output == "rank" else 1.0 - (rank - 1) / float(left + right)
    return df.withColumns(out)


def zigzag_candidates(legs: int, high="high", low="low") -> dict[str, Column]:
    """A row's high, if above all ``legs`` rows before and not below any of the ``legs`` after; the low likewise."""
    h, lo = col(high), col(low)
    return {
        "__zh": F.when((h > frame(F.max, h, -legs, -1)) & (h >= frame(F.max, h, 1, legs)), h),
        "__zl": F.when((lo < frame(F.min, lo, -legs, -1)) & (lo <= frame(F.min, lo, 1, legs)), lo),
    }


def step(pivots: list, at: int, high: float | None, low: float | None, deviation: float) -> None:
    """Put one row's candidates to the pivots (position, price, direction): at most one change, the high first.

    From a pivot at 0 every other price is a reversal: its relative change has no bound."""
    for price, direction in ((high, 1), (low, -1)):
        if price is None:
            continue
        if not pivots:
            pivots.append((at, price, direction))
            return
        _, last, same = pivots[-1]
        if direction == same:
            if (price - last) * direction > 0:
                pivots[-1] = (at, price, direction)
                return
        elif abs(price / last - 1.0) >= deviation if last else price != 0:
            pivots.append((at, price, direction))
            return


def swing_return(price: float, before: float) -> float | None:
    """price / before - 1; None after a pivot at 0."""
    return price / before - 1.0 if before else None


def kendall(prices: list[float]) -> float | None:
    """Tau-b of prices in order of time; None if all are equal."""
    n = len(prices)
    pairs = [(prices[j] > prices[i]) - (prices[j] < prices[i]) for i in range(n) for j in range(i + 1, n)]
    untied = sum(p != 0 for p in pairs)
    return sum(pairs) / math.sqrt(len(pairs) * untied) if untied else None


def leg_dynamics(pivots: list, legs: int) -> tuple[float | None, float | None]:
    """(balance, efficiency) of the last legs, from log moves."""
    from statistics import median

    if len(pivots) < legs + 1:
        return None, None
    last = pivots[-legs - 1 :]
    if any(not (p[1] > 0 and math.isfinite(p[1])) for p in last):
        return None, None
    moves = [(math.log(b[1] / a[1]), b[2]) for a, b in zip(last, last[1:], strict=False)]
    up, down = [abs(m) for m, d in moves if d == 1], [abs(m) for m, d in moves if d == -1]
    if not up or not down:
        return None, None
    u, d, path = median(up), median(down), sum(abs(m) for m, _ in moves)
    return ((u - d) / (u + d) if u + d > 0 else None), (sum(m for m, _ in moves) / path if path > 0 else None)


def _check_zigzag(deviation: float, pivot_legs: int) -> int:
    if not deviation > 0 or pivot_legs < 2:
        raise ValueError("deviation must be positive and pivot_legs at least 2")
    return pivot_legs // 2


def _by_group(df: DataFrame, columns: dict[str, object], fold) -> DataFrame:
    """Adds double columns that fold makes from an instrument's candidates (lists of highs and lows)."""
    check_new(df, columns)

    def run(_, bars):
        import pyarrow as pa

        bars = bars.sort_by(ORDER)
        found = fold(bars.column("__zh").to_pylist(), bars.column("__zl").to_pylist())
        for name in columns:
            bars = bars.append_column(name, pa.array(found[name], pa.float64()))
        return bars

    return df.groupBy(*KEYS).applyInArrow(run, StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in columns)]))


def add_zigzag(df: DataFrame, deviation: float = 5.0, pivot_legs: int = 10, high="high", low="low") -> DataFrame:
    """The retained pivots seen from the end of the history: price, direction, return and bars since the pivot before."""
    legs = _check_zigzag(deviation, pivot_legs)
    names = dict.fromkeys(("zigzag_price", "zigzag_direction", "zigzag_return", "zigzag_bars"))

    def fold(highs, lows):
        pivots: list = []
        for i, (h, lo) in enumerate(zip(highs, lows, strict=True)):
            step(pivots, i, h, lo, deviation / 100.0)
        out = {n: [None] * len(highs) for n in names}
        out["zigzag_direction"] = [0.0] * len(highs)
        for k, (i, price, direction) in enumerate(pivots):
            out["zigzag_price"][i], out["zigzag_direction"][i] = price, float(direction)
            if k:
                out["zigzag_return"][i], out["zigzag_bars"][i] = swing_return(price, pivots[k - 1][1]), float(i - pivots[k - 1][0])
        return out

    return _by_group(df.withColumns(zigzag_candidates(legs, high, low)), names, fold).drop("__zh", "__zl")


STATE = (
    "last_price", "previous_price", "last_direction", "last_position", "previous_position", "last_high_price", "previous_high_price", "last_high_position",
    "previous_high_position", "last_low_price", "previous_low_price", "last_low_position", "previous_low_position", "high_consistency", "low_consistency",
    "leg_balance", "efficiency",
)


def state_of(pivots: list, consistency_pivots: int, dynamics_legs: int) -> dict[str, float | None]:
    out: dict[str, float | None] = dict.fromkeys(STATE)
    if not pivots:
        return out
    out["last_position"], out["last_price"], out["last_direction"] = float(pivots[-1][0]), pivots[-1][1], float(pivots[-1][2])
    if len(pivots) > 1:
        out["previous_position"], out["previous_price"] = float(pivots[-2][0]), pivots[-2][1]
    for side, direction in (("high", 1), ("low", -1)):
        own = [p for p in pivots[-2 * max(2, consistency_pivots) :] if p[2] == direction]
        for which, k in (("last", 1), ("previous", 2)):
            if len(own) >= k:
                out[f"{which}_{side}_price"], out[f"{which}_{side}_position"] = own[-k][1], float(own[-k][0])
        if len(own) >= consistency_pivots:
            out[f"{side}_consistency"] = kendall([p[1] for p in own[-consistency_pivots:]])
    out["leg_balance"], out["efficiency"] = leg_dynamics(pivots, dynamics_legs)
    return out


def add_zigzag_state(df: DataFrame, deviation: float = 5.0, pivot_legs: int = 10, consistency_pivots: int = 4, dynamics_legs: int = 6, high="high", low="low") -> DataFrame:
    """What was known at each row: the candidates of the row ``pivot_legs // 2`` before count there. 17 columns, __z_*."""
    legs = _check_zigzag(deviation, pivot_legs)
    if consistency_pivots < 2 or dynamics_legs < 2 or dynamics_legs % 2:
        raise ValueError("consistency_pivots must be at least 2, dynamics_legs even")
    names = {f"__z_{n}": n for n in STATE}

    def fold(highs, lows):
        pivots: list = []
        out: dict[str, list] = {n: [] for n in names}
        state = state_of(pivots, consistency_pivots, dynamics_legs)
        for i in range(len(highs)):
            at = i - legs
            if at >= 0 and (highs[at] is not None or lows[at] is not None):
                step(pivots, at, highs[at], lows[at], deviation / 100.0)
                state = state_of(pivots, consistency_pivots, dynamics_legs)
            for n, key in names.items():
                out[n].append(state[key])
        return out

    return _by_group(df.withColumns(zigzag_candidates(legs, high, low)), names, fold).drop("__zh", "__zl")


def add_zigzag_features(
    df: DataFrame, deviation: float = 5.0, pivot_legs: int = 10, consistency_pivots: int = 4, dynamics_legs: int = 6, atr_length: int = 14,
) -> DataFrame:
    """20 features of the confirmed state; prices are adjusted first if adjusted_close is there."""
    h, lo, c = ("__a_high", "__a_low", "__a_close") if "adjusted_close" in df.columns else ("high", "low", "close")
    before = df.columns
    if "adjusted_close" in before and "__a_close" not in before:
        df = adjusted(df, ("high", "low", "close"), "__a_")
    df = add_atr(df, atr_length, "__zatr", h, lo, c).withColumns({"__patr": lag("__zatr"), "__at": position() - 1})
    df = add_zigzag_state(df, deviation, pivot_legs, consistency_pivots, dynamics_legs, h, lo)
    z = {n: F.col(f"__z_{n}") for n in STATE}
    ratio, bars = divide(z["last_price"], z["previous_price"]), z["last_position"] - z["previous_position"]
    out = {
        "zigzag_last_direction": z["last_direction"],
        "zigzag_last_swing_return": ratio - 1.0,
        "zigzag_last_swing_bars": bars,
        "zigzag_swing_return_per_bar": F.when((ratio > 0) & (bars > 0), F.pow(ratio, F.lit(1.0) / bars) - 1.0),
        "zigzag_bars_since_pivot": F.col("__at") - z["last_position"],
        "zigzag_retracement": divide(-(F.col(c) - z["last_price"]), z["last_price"] - z["previous_price"]),
    }
    for side in ("high", "low"):
        change = divide(z[f"last_{side}_price"], z[f"previous_{side}_price"])
        change = F.when(change > 0, F.log(change))
        apart = z[f"last_{side}_position"] - z[f"previous_{side}_position"]
        out[f"market_structure_{side}_change"] = change
        out[f"market_structure_{side}_rate"] = F.when(apart > 0, divide(change, apart))
        out[f"market_structure_{side}_consistency"] = z[f"{side}_consistency"]
    out |= {"market_structure_leg_balance": z["leg_balance"], "market_structure_efficiency": z["efficiency"]}
    level = level_interactions(z["last_high_price"], z["last_low_price"], "__patr", h, lo, c)
    names = ("close_to_prior_high_atr", "close_to_prior_low_atr", "breakout_high_strength", "breakout_low_strength", "failed_breakout_high_strength", "failed_breakout_low_strength")
    out |= {f"market_structure_{n}": x for n, x in zip(names, level.values(), strict=True)}
    return df.withColumns(out).select(*before, *out)
