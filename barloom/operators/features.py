"""Feature families: which indicators, on which scale, under which names. Prices are adjusted first where that matters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.core import adjusted, check_has, check_new, divide
from barloom.operators import candles, structure, trend, volatility

A = {c: f"__a_{c}" for c in ("open", "high", "low", "close")}
HLC = {k: A[k] for k in ("high", "low", "close")}


def _family(df: DataFrame, names: list[str], needs: tuple[str, ...], columns: tuple[str, ...], build) -> DataFrame:
    check_has(df, needs)
    check_new(df, names)
    scaled = columns and not all(A[c] in df.columns for c in columns)
    return build(adjusted(df, columns, "__a_") if scaled else df).select(*df.columns, *names)


# The names of the output columns of each family, and the default lengths of its function, below.
TREND = (
    "ema_fast_to_ema_mid", "ema_mid_to_ema_slow", "ema_mid_to_sma_mid", "close_to_ema_fast", "close_to_ema_mid", "close_to_ema_slow",
    "close_over_ema_fast_fraction", "close_over_ema_mid_fraction", "close_over_ema_slow_fraction", "adx", "plus_di", "minus_di", "vwap_distance", "vwap_distance_percent_b",
)


def add_trend_features(
    df: DataFrame, ma_lengths=(10, 20, 50), adx_length: int = 14, rolling_fraction_lookback: int = 20, vwap_length: int = 20, vwap_bollinger_length: int = 20,
    vwap_bollinger_num_std: float = 2.0,
) -> DataFrame:
    fast, mid, slow = ma_lengths
    if not 0 < fast < mid < slow:
        raise ValueError("the lengths must ascend")

    def build(x: DataFrame) -> DataFrame:
        x = trend.add_ema(x, "adjusted_close", fast, mid, slow, names=("__f", "__m", "__s"))
        to = lambda a, b: divide(a, b) - 1.0
        out = {
            "ema_fast_to_ema_mid": to("__f", "__m"), "ema_mid_to_ema_slow": to("__m", "__s"), "ema_mid_to_sma_mid": to("__m", trend.sma("adjusted_close", mid)),
            "close_to_ema_fast": to("adjusted_close", "__f"), "close_to_ema_mid": to("adjusted_close", "__m"), "close_to_ema_slow": to("adjusted_close", "__s"),
            "vwap_distance": to("adjusted_close", trend.rolling_vwap(vwap_length, **HLC)),
        }
        for name, ema in (("fast", "__f"), ("mid", "__m"), ("slow", "__s")):
            out[f"close_over_ema_{name}_fraction"] = trend.fraction_above("adjusted_close", ema, rolling_fraction_lookback, True)
        x = x.withColumns(out)
        x = x.withColumn("vwap_distance_percent_b", volatility.percent_b("vwap_distance", vwap_bollinger_length, vwap_bollinger_num_std))
        return trend.add_adx(x, adx_length, **HLC)

    return _family(df, list(TREND), ("high", "low", "close", "volume", "adjusted_close"), ("high", "low", "close"), build)


MOMENTUM = (
    "ppo", "ppo_signal", "ppo_histogram", "ppo_percentile", "rsi", "rsi_percent_b", "stochastic_k", "stochastic_d", "mfi", "mfi_percent_b", "squeeze_on", "squeeze_off",
    "squeeze_released", "squeeze_width_ratio", "squeeze_momentum_atr", "squeeze_momentum_atr_change", "squeeze_duration", "squeeze_release_duration",
)


def add_momentum_features(
    df: DataFrame, ppo_lengths=(12, 26, 9), ppo_percentile_min_history: int = 100, rsi_length: int = 21, rsi_bollinger_length: int = 20, rsi_bollinger_num_std: float = 2.0,
    stochastic_k_length: int = 14, stochastic_k_smoothing: int = 3, stochastic_d_length: int = 3, mfi_length: int = 14, mfi_bollinger_length: int = 20,
    mfi_bollinger_num_std: float = 2.0, squeeze_bb_length: int = 20, squeeze_bb_mult: float = 2.0, squeeze_kc_length: int = 20, squeeze_kc_mult: float = 1.5, squeeze_atr_length: int = 14,
) -> DataFrame:
    def build(x: DataFrame) -> DataFrame:
        x = trend.add_ppo(x, "adjusted_close", ppo_lengths, use_percent=False)
        x = trend.add_expanding_percentile(x, "ppo", ppo_percentile_min_history)
        x = trend.add_rsi(x, "adjusted_close", rsi_length)
        x = trend.add_stochastic(x, stochastic_k_length, stochastic_k_smoothing, stochastic_d_length, **HLC)
        x = trend.add_mfi(x, mfi_length, **HLC)
        x = x.withColumns({
            "rsi_percent_b": volatility.percent_b("rsi", rsi_bollinger_length, rsi_bollinger_num_std),
            "mfi_percent_b": volatility.percent_b("mfi", mfi_bollinger_length, mfi_bollinger_num_std),
        })
        return trend.add_squeeze(x, squeeze_bb_length, squeeze_bb_mult, squeeze_kc_length, squeeze_kc_mult, squeeze_atr_length, **HLC)

    return _family(df, list(MOMENTUM), ("high", "low", "close", "adjusted_close", "volume"), ("high", "low", "close"), build)


VOLATILITY = ("adr_percent", "atr_percent", "bollinger_bandwidth", "bollinger_percent_b")


def add_volatility_features(df: DataFrame, adr_length: int = 20, atr_length: int = 14, bollinger_length: int = 20, bollinger_num_std: float = 2.0) -> DataFrame:
    def build(x: DataFrame) -> DataFrame:
        x = volatility.add_atr_percent(x, atr_length, **HLC)
        return x.withColumns({
            "adr_percent": volatility.adr_percent(adr_length, **HLC), "bollinger_bandwidth": volatility.bandwidth("adjusted_close", bollinger_length, bollinger_num_std),
            "bollinger_percent_b": volatility.percent_b("adjusted_close", bollinger_length, bollinger_num_std),
        })

    return _family(df, list(VOLATILITY), ("high", "low", "close", "adjusted_close"), ("high", "low", "close"), build)


def add_price_action_features(df: DataFrame, atr_length: int = 14, range_percentile_length: int = 20, breakout_length: int = 20, rolling_candle_lookback: int = 14) -> DataFrame:
    ohlc = {"open_": A["open"], **HLC}
    geometry = {f"candle_{n}": c for n, c in candles.geometry(**ohlc).items()}
    context = {"range_atr": "candle_range_atr", "gap_atr": "candle_gap_atr", "range_percentile": f"range_percentile_{range_percentile_length}"}
    patterns = {n: f"candle_{n}" for n in ("inside_bar", "outside_bar", "engulfing_strength", "lower_rejection_strength", "upper_rejection_strength", "consecutive_inside_bars")}
    directions = {n: f"candle_{n}" for n in ("direction_run", "direction_run_return", "direction_run_body_atr")}
    to = ("close_to_prior_high_atr", "close_to_prior_low_atr", "breakout_high_strength", "breakout_low_strength", "failed_breakout_high_strength", "failed_breakout_low_strength")
    levels = {n: f"candle_{t}_{breakout_length}" for n, t in zip(candles.LEVEL_NAMES, to, strict=True)}
    names = [*geometry, *context.values(), *patterns.values(), *directions.values(), *levels.values(), "rolling_bullish_candle_fraction"]

    def build(x: DataFrame) -> DataFrame:
        x = candles.add_range_context(x, atr_length, range_percentile_length, **ohlc)
        x = candles.add_patterns(x, atr_length, **ohlc)
        x = candles.add_direction_runs(x, atr_length, **ohlc)
        x = candles.add_level_interactions(x, breakout_length, atr_length, **HLC)
        x = x.withColumns({**geometry, "rolling_bullish_candle_fraction": candles.bullish_fraction(rolling_candle_lookback, True, A["open"], A["close"])})
        return x.withColumnsRenamed(context | patterns | directions | levels)

    return _family(df, names, ("open", "high", "low", "close", "adjusted_close"), ("open", "high", "low", "close"), build)


def add_volume_features(df: DataFrame, turnover_zscore_length: int = 252, turnover_zscore_log: bool = True) -> DataFrame:
    return _family(df, ["turnover_zscore"], ("close", "volume"), (), lambda x: x.withColumn("turnover_zscore", volatility.turnover_zscore(turnover_zscore_length, turnover_zscore_log)))


STRUCTURE = (
    "donchian_position", "zigzag_last_direction", "zigzag_last_swing_return", "zigzag_last_swing_bars", "zigzag_swing_return_per_bar", "zigzag_bars_since_pivot",
    "zigzag_retracement", "market_structure_high_change", "market_structure_low_change", "market_structure_high_rate", "market_structure_low_rate",
    "market_structure_high_consistency", "market_structure_low_consistency", "market_structure_leg_balance", "market_structure_efficiency",
    "market_structure_close_to_prior_high_atr", "market_structure_close_to_prior_low_atr", "market_structure_breakout_high_strength",
    "market_structure_breakout_low_strength", "market_structure_failed_breakout_high_strength", "market_structure_failed_breakout_low_strength",
)


def add_market_structure_features(
    df: DataFrame, donchian_length: int = 20, zigzag_deviation: float = 5.0, zigzag_pivot_legs: int = 10, zigzag_consistency_pivots: int = 4, zigzag_dynamics_legs: int = 6,
    zigzag_atr_length: int = 14,
) -> DataFrame:
    scaled = "adjusted_close" in df.columns

    def build(x: DataFrame) -> DataFrame:
        x = x.withColumn("donchian_position", structure.donchian_position(donchian_length, **(HLC if scaled else {})))
        return structure.add_zigzag_features(x, zigzag_deviation, zigzag_pivot_legs, zigzag_consistency_pivots, zigzag_dynamics_legs, zigzag_atr_length)

    return _family(df, list(STRUCTURE), ("high", "low", "close"), ("high", "low", "close") if scaled else (), build)
