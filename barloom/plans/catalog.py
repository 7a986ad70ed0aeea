"""The default feature set and the target sets with their primary tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barloom.operators import cross_section, features, targets
from barloom.operators.trend import prepare
from barloom.plans.contracts import Block, BlockSet, Task

_PRICES = frozenset({"high", "low", "close", "adjusted_close"})

FEATURES = BlockSet(
    "ohlcv_default",
    "1",
    (
        Block("returns", cross_section.add_returns, tuple(f"return_{h}d" for h in (1, 5, 10, 20)), frozenset({"adjusted_close"}), {"horizons": (1, 5, 10, 20)}),
        Block(
            "cross_sectional", cross_section.add_cross_section,
            (*(f"return_{h}d_cross_sectional_percentile" for h in (1, 5, 10, 20)), "market_breadth_positive_1d", "market_mean_return_1d", "market_median_return_1d"),
            frozenset({"adjusted_close"}), {"return_horizons": (1, 5, 10, 20), "market_return_horizon": 1, "minimum_cross_section_size": 2}, "cross_sectional",
        ),
        Block("trend", features.add_trend_features, features.TREND, _PRICES | {"volume"}, {"ma_lengths": (10, 20, 50)}, "path_dependent"),
        Block("momentum", features.add_momentum_features, features.MOMENTUM, _PRICES | {"volume"}, {"rsi_length": 21, "ppo_percentile_min_history": 100}, "expanding"),
        Block("volatility", features.add_volatility_features, features.VOLATILITY, _PRICES, {"adr_length": 20, "atr_length": 14}, "path_dependent"),
        Block(
            "price_action", features.add_price_action_features,
            (
                "candle_signed_body_fraction", "candle_upper_wick_fraction", "candle_lower_wick_fraction", "candle_close_location", "candle_range_atr", "candle_gap_atr", "range_percentile_20",
                "candle_inside_bar", "candle_outside_bar", "candle_engulfing_strength", "candle_lower_rejection_strength", "candle_upper_rejection_strength", "candle_consecutive_inside_bars",
                "candle_direction_run", "candle_direction_run_return", "candle_direction_run_body_atr", "candle_close_to_prior_high_atr_20", "candle_close_to_prior_low_atr_20",
                "candle_breakout_high_strength_20", "candle_breakout_low_strength_20", "candle_failed_breakout_high_strength_20", "candle_failed_breakout_low_strength_20", "rolling_bullish_candle_fraction",
            ), _PRICES | {"open"}, {"breakout_length": 20}, "path_dependent",
        ),
        Block("volume", features.add_volume_features, ("turnover_zscore",), frozenset({"close", "volume"}), {"turnover_zscore_length": 252, "turnover_zscore_log": True}),
        Block("market_structure", features.add_market_structure_features, features.STRUCTURE, frozenset({"high", "low", "close"}), {"donchian_length": 20}, "path_dependent"),
    ),
)


def add_default_features(df: DataFrame) -> DataFrame:
    """All 92 features, with the recursions that families share computed once."""
    return FEATURES.apply(prepare(df)).select(*df.columns, *FEATURES.outputs)


def _fixed(df: DataFrame, horizon: int, threshold: float, name: str) -> DataFrame:
    before = df.columns
    df = targets.add_forward_returns(df, (horizon,))
    return df.withColumn(name, targets.above(f"forward_return_{horizon}d", threshold)).select(*before, name)


FORWARD = BlockSet(
    "forward_returns", "1",
    (
        Block("forward_returns", targets.add_forward_returns, tuple(f"forward_return_{h}d" for h in (5, 10, 15)), frozenset({"adjusted_close"}), {"horizons": (5, 10, 15)}),
        Block("significant_up", _fixed, ("target_significant_up_5d",), frozenset({"adjusted_close"}), {"horizon": 5, "threshold": targets.FIXED_RETURN, "name": "target_significant_up_5d"}),
    ),
)
MAX_RETURN = BlockSet("future_max_return", "1", (Block("future_max_return", targets.add_future_max_returns, tuple(f"future_max_return_{h}d" for h in (5, 10, 15)), frozenset({"open", "high"}), {"horizons": (5, 10, 15)}),))
CROSS_SECTION = BlockSet(
    "cross_sectional_returns", "1",
    (Block("cross_sectional_returns", targets.add_cross_sectional_targets, tuple(n for h in (5, 10, 15) for n in (f"market_relative_forward_return_{h}d", f"forward_return_{h}d_cross_sectional_percentile", f"forward_return_{h}d_relevance_grade")), frozenset({"adjusted_close"}), {"horizons": (5, 10, 15), "minimum_cross_section_size": 20}, "cross_sectional"),),
)
BARRIER = BlockSet(
    "triple_barrier", "1",
    (Block("triple_barrier", targets.add_triple_barrier, tuple(f"{n}_{h}d" for h in (5, 10) for n in ("triple_barrier_label", "time_to_event", "target_end_date")), _PRICES | {"open"}, {"horizons": (5, 10)}),),
)
TASKS = {
    "forward_returns": Task("target_significant_up_5d", "boolean", 5),
    "future_max_return": Task("future_max_return_5d", "number", 5),
    "cross_sectional_returns": Task("forward_return_5d_relevance_grade", "integer", 5),
    "triple_barrier": Task("triple_barrier_label_10d", "integer", 10, "target_end_date_10d"),
}
SETS = {s.name: s for s in (FORWARD, MAX_RETURN, CROSS_SECTION, BARRIER)}
