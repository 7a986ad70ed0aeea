"""Queries of the indicators and features over weekly bars, with oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.core import by_ticker, ema_alpha, wilder_alpha
from barloom.functions.stored import stored_dir
from barloom.operators import candles, cross_section, features, structure, targets, trend, volatility
from barloom.plans import catalog, flagship, sql
from barloom.plans.sql import BARS, HOURS, KEYS, LAG, TRUE_RANGE, div, ewm, frame, r6, rolling, with_
from barloom.sources import layout
from barloom.sources.bars import bars_hour, bars_week

QUERIES: dict = {}
SQL: dict[str, str] = {}


def out(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Keys and the named columns; doubles rounded, so that the order of a sum doesn't show."""
    kind = dict(df.dtypes)
    return df.select("provider", "ticker", "trading_date", *[F.round(n, digits).alias(n) if kind[n] == "double" else F.col(n) for n in names])


def add(name: str, make, *columns: str, oracle: str | None = None, bars=bars_week) -> None:
    QUERIES[name] = lambda spark, d: out(make(bars(spark, d)), *columns)
    if oracle:
        SQL[name] = oracle


def plain(select: str, *more: str, bars: str = BARS) -> str:
    return with_(bars, *more, select=f"SELECT {KEYS}, {select} FROM {'b' if not more else more[-1].split(' ', 1)[0]}")


QUERIES["x00_top5_by_week"] = lambda spark, d: flagship(spark, d)
SQL["x00_top5_by_week"] = with_(
    BARS,
    f"r AS (SELECT *, adjusted_close / lag(adjusted_close) {LAG} - 1 AS r1, adjusted_close / lag(adjusted_close, 5) {LAG} - 1 AS r5 FROM b)",
    "k AS (SELECT *, count(r1) OVER d AS n, rank() OVER (PARTITION BY provider, trading_date ORDER BY r1 NULLS LAST) + (count(r1) OVER (PARTITION BY provider, trading_date, r1) - 1) / 2.0 AS k FROM r WINDOW d AS (PARTITION BY provider, trading_date))",
    "q AS (SELECT *, CASE WHEN r1 IS NOT NULL AND n >= 2 THEN (k - 0.5) / n END AS percentile FROM k)",
    "t AS (SELECT *, row_number() OVER (PARTITION BY provider, trading_date ORDER BY percentile DESC, ticker) AS place FROM q WHERE percentile IS NOT NULL)",
    select=f"SELECT {KEYS}, round(r1, 6) AS return_1d, round(r5, 6) AS return_5d, round(percentile, 6) AS percentile, place FROM t WHERE place <= 5",
)

_BAR = ("open", "high", "low", "close", "adjusted_close", "volume")
QUERIES["a00_bars_week"] = lambda spark, d: bars_week(spark, d).select("provider", "ticker", "trading_date", *_BAR)
SQL["a00_bars_week"] = plain(", ".join(_BAR))
QUERIES["a00_bars_hour"] = lambda spark, d: out(bars_hour(spark, d), "open", "high", "low", "close", "volume")
SQL["a00_bars_hour"] = plain(r6("open", "high", "low", "close") + ", volume", bars=HOURS)

# moving averages, oscillators, momentum
add("m01_sma", lambda b: trend.add_sma(b, "close", 20), "sma", oracle=plain(f"round({rolling('avg', 'close', 20)}, 6) AS sma"))


def _stored(spark, d):
    """The same averages over bars stored by instrument: planned without an exchange."""
    name = f"bars_{uuid.uuid4().hex}"
    bars = layout.store_bars(bars_week(spark, d), name, 8, f"{stored_dir(spark)}/{name}")
    with layout.presorted(spark):
        return out(trend.add_sma(bars, "close", 20), "sma")


QUERIES["m01_sma_over_stored_bars"], SQL["m01_sma_over_stored_bars"] = _stored, SQL["m01_sma"]
add("m02_ema", lambda b: trend.add_ema(b, "close", 10, 50), "ema_10", "ema_50", oracle=with_(BARS, ewm("e1", "b", "close", ema_alpha(10), 10), ewm("e2", "b", "close", ema_alpha(50), 50), select=f"SELECT {KEYS}, round(e1.y, 6) AS ema_10, round(e2.y, 6) AS ema_50 FROM e1 JOIN e2 USING ({KEYS})"))
add("m03_vwap", lambda b: b.withColumn("vwap", trend.rolling_vwap(20)), "vwap", oracle=plain(f"round({div(rolling('sum', '((high + low + close) / 3.0 * volume)', 20), rolling('sum', 'volume', 20))}, 6) AS vwap"))
_ABOVE = "f AS (SELECT b.*, e.y AS ema, CASE WHEN e.y IS NOT NULL THEN CAST(close > e.y AS INT) END AS up FROM b JOIN e USING (provider, ticker, trading_date))"
add(
    "m04_fraction_above_ema",
    lambda b: trend.add_ema(b, "close", 10).withColumns({"fraction": trend.fraction_above("close", "ema_10", 20), "fraction_before": trend.fraction_above("close", "ema_10", 20, True)}),
    "fraction", "fraction_before",
    oracle=with_(BARS, ewm("e", "b", "close", ema_alpha(10), 10), _ABOVE, select=f"SELECT {KEYS}, round({rolling('avg', 'up', 20)}, 6) AS fraction, round({frame('avg', 'up', -20, -1)}, 6) AS fraction_before FROM f"),
)
_CHANGE = f"c AS (SELECT *, greatest(0, close - lag(close) {LAG}) * (CASE WHEN lag(close) {LAG} IS NULL THEN NULL ELSE 1 END) AS gain, greatest(0, lag(close) {LAG} - close) * (CASE WHEN lag(close) {LAG} IS NULL THEN NULL ELSE 1 END) AS loss FROM b)"


def _rsi(n: int) -> tuple[str, ...]:
    return _CHANGE, ewm("g", "c", "gain", wilder_alpha(n), n), ewm("l", "c", "loss", wilder_alpha(n), n)


add("m05_rsi", lambda b: trend.add_rsi(b, "close"), "rsi", oracle=with_(BARS, *_rsi(14), select=f"SELECT {KEYS}, round({div('100 * g.y', 'g.y + l.y')}, 6) AS rsi FROM g JOIN l USING ({KEYS})"))
add(
    "m06_stochastic", lambda b: trend.add_stochastic(b), "stochastic_k", "stochastic_d",
    oracle=with_(BARS, f"k0 AS (SELECT *, {div(f'100 * (close - ({rolling("min", "low", 14)}))', f'({rolling("max", "high", 14)}) - ({rolling("min", "low", 14)})')} AS raw FROM b)", f"k1 AS (SELECT *, {rolling('avg', 'raw', 3)} AS k FROM k0)", select=f"SELECT {KEYS}, round(k, 6) AS stochastic_k, round({rolling('avg', 'k', 3)}, 6) AS stochastic_d FROM k1"),
)


def _lines(expr: str, names) -> str:
    return with_(
        BARS, ewm("f", "b", "close", ema_alpha(12), 12), ewm("s", "b", "close", ema_alpha(26), 26),
        f"m AS (SELECT {KEYS}, {expr} AS line FROM f JOIN s USING ({KEYS}))", ewm("g", "m", "line", ema_alpha(9), 9),
        select=f"SELECT {KEYS}, round(line, 6) AS {names[0]}, round(g.y, 6) AS {names[1]}, round(line - g.y, 6) AS {names[2]} FROM m JOIN g USING ({KEYS})",
    )


add("m07_macd", lambda b: trend.add_macd(b), "macd", "macd_signal", "macd_histogram", oracle=_lines("f.y - s.y", ("macd", "macd_signal", "macd_histogram")))
add("m08_ppo", lambda b: trend.add_ppo(b), "ppo", "ppo_signal", "ppo_histogram", oracle=_lines("100 * " + div("f.y - s.y", "s.y"), ("ppo", "ppo_signal", "ppo_histogram")))
_MOVE = f"d AS (SELECT *, {TRUE_RANGE} AS tr, high - lag(high) {LAG} AS up, lag(low) {LAG} - low AS dn FROM b)"
_DM = "d2 AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS mdm FROM d)"
_W = wilder_alpha(14)
add(
    "m09_adx", lambda b: trend.add_adx(b), "adx", "plus_di", "minus_di",
    oracle=with_(
        BARS, _MOVE, _DM, ewm("u", "d2", "pdm", _W, 14), ewm("v", "d2", "mdm", _W, 14), ewm("t", "d2", "tr", _W, 14),
        f"i AS (SELECT {KEYS}, {div('100 * u.y', 't.y')} AS p, {div('100 * v.y', 't.y')} AS m FROM u JOIN v USING ({KEYS}) JOIN t USING ({KEYS}))",
        f"x AS (SELECT *, {div('100 * abs(p - m)', 'p + m')} AS dx FROM i)", ewm("a", "x", "dx", _W, 14),
        select=f"SELECT {KEYS}, round(a.y, 6) AS adx, round(p, 6) AS plus_di, round(m, 6) AS minus_di FROM x JOIN a USING ({KEYS})",
    ),
)
_MFI = (
    "t AS (SELECT *, (high + low + close) / 3.0 AS tp FROM b)",
    f"d AS (SELECT *, tp - lag(tp) {LAG} AS ch FROM t)",
    "s AS (SELECT *, CASE WHEN ch > 0 THEN tp * volume WHEN ch <= 0 THEN 0 END AS pos, CASE WHEN ch < 0 THEN tp * volume WHEN ch >= 0 THEN 0 END AS neg FROM d)",
)
add("m10_mfi", lambda b: trend.add_mfi(b), "mfi", oracle=with_(BARS, *_MFI, select=f"SELECT {KEYS}, round({div(f'100 * ({rolling("sum", "pos", 14)})', f'({rolling("sum", "pos", 14)}) + ({rolling("sum", "neg", 14)})')}, 6) AS mfi FROM s"))
add(
    "m11_expanding_percentile", lambda b: trend.add_expanding_percentile(b, "close", 100, "percentile", block=256), "percentile",
    oracle=with_(BARS, f"n AS (SELECT *, row_number() OVER ({sql.P}) AS rn FROM b)", select=f"SELECT a.provider, a.ticker, a.trading_date, round(CASE WHEN a.rn > 100 THEN CAST(count_if(o.close <= a.close) AS DOUBLE) / (a.rn - 1) END, 6) AS percentile FROM n a LEFT JOIN n o ON a.provider = o.provider AND a.ticker = o.ticker AND o.rn < a.rn GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY a.provider, a.ticker, a.trading_date, a.rn")),
)
_SQUEEZE = ("squeeze_on", "squeeze_off", "squeeze_released", "squeeze_width_ratio", "squeeze_momentum", "squeeze_momentum_atr", "squeeze_momentum_atr_change", "squeeze_duration", "squeeze_release_duration")
add(
    "m12_squeeze", lambda b: trend.add_squeeze(b), *_SQUEEZE,
    oracle=with_(
        BARS, f"t AS (SELECT *, {TRUE_RANGE} AS tr, row_number() OVER ({sql.P}) AS rn FROM b)", ewm("a", "t", "tr", _W, 14),
        f"w AS (SELECT *, {rolling('avg', 'close', 20)} AS m, 2.0 * ({rolling('stddev_pop', 'close', 20)}) AS s, 1.5 * ({rolling('avg', 'tr', 20)}) AS k, (({rolling('max', 'high', 20)}) + ({rolling('min', 'low', 20)})) / 2.0 AS mid FROM t)",
        "x AS (SELECT *, m - s > m - k AND m + s < m + k AS squeeze_on, m - s < m - k AND m + s > m + k AS squeeze_off, close - (mid + m) / 2.0 AS x FROM w)",
        f"y AS (SELECT *, CASE WHEN count(x) {sql.over(-19, 0)} = 20 THEN regr_intercept(x, rn) {sql.over(-19, 0)} + regr_slope(x, rn) {sql.over(-19, 0)} * rn END AS squeeze_momentum, lag(squeeze_on, 1, false) {LAG} AND NOT squeeze_on AS squeeze_released, sum(CASE WHEN squeeze_on THEN 0 ELSE 1 END) OVER ({sql.P}) AS run FROM x)",
        "z AS (SELECT y.*, a.y AS atr, CASE WHEN squeeze_on THEN CAST(sum(CAST(squeeze_on AS INT)) OVER (PARTITION BY provider, ticker, run ORDER BY trading_date) AS BIGINT) WHEN NOT squeeze_on THEN 0 END AS squeeze_duration FROM y JOIN a USING (provider, ticker, trading_date))",
        select=f"SELECT {KEYS}, squeeze_on, squeeze_off, squeeze_released, round({div('2 * s', '2 * k')}, 6) AS squeeze_width_ratio, round(squeeze_momentum, 6) AS squeeze_momentum, round(squeeze_momentum / atr, 6) AS squeeze_momentum_atr, round(squeeze_momentum / atr - lag(squeeze_momentum / atr) {LAG}, 6) AS squeeze_momentum_atr_change, squeeze_duration, CASE WHEN squeeze_released THEN lag(squeeze_duration) {LAG} END AS squeeze_release_duration FROM z",
    ),
)
add("m13_linreg", lambda b: b.withColumn("__at", F.row_number().over(by_ticker())).withColumn("linreg", trend.linreg_endpoint("close", 20, 3)), "linreg", oracle=with_(BARS, f"t AS (SELECT *, row_number() OVER ({sql.P}) AS rn FROM b)", select=f"SELECT {KEYS}, round(CASE WHEN count(close) {sql.over(-19, 0)} = 20 THEN regr_intercept(close, rn) {sql.over(-19, 0)} + regr_slope(close, rn) {sql.over(-19, 0)} * (rn - 3) END, 6) AS linreg FROM t"))

# volatility and volume
_TR = f"t AS (SELECT *, {TRUE_RANGE} AS tr FROM b)"
_ATR = (_TR, ewm("a", "t", "tr", _W, 14))
QUERIES["v01_true_range"] = lambda spark, d: bars_week(spark, d).select("provider", "ticker", "trading_date", trend.true_range().alias("true_range"))
SQL["v01_true_range"] = plain(f"{TRUE_RANGE} AS true_range")
add("v02_atr", lambda b: trend.add_atr(b), "atr", oracle=with_(BARS, *_ATR, select=f"SELECT {KEYS}, round(y, 6) AS atr FROM a"))
add("v03_atr_percent", lambda b: volatility.add_atr_percent(b), "atr_percent", oracle=with_(BARS, *_ATR, select=f"SELECT {KEYS}, round({div('100 * y', 'close')}, 6) AS atr_percent FROM a JOIN b USING ({KEYS})"))
add("v04_adr", lambda b: b.withColumns({"adr": volatility.adr(), "adr_percent": volatility.adr_percent()}), "adr", "adr_percent", oracle=plain(f"round({rolling('avg', '(high - low)', 20)}, 6) AS adr, round({div(f'100 * ({rolling("avg", "(high - low)", 20)})', 'close')}, 6) AS adr_percent"))
_BB = f"w AS (SELECT *, {rolling('avg', 'close', 20)} AS m, 2.0 * ({rolling('stddev_pop', 'close', 20)}) AS s FROM b)"


def _bands(b: DataFrame) -> DataFrame:
    m, u, lo = volatility.bands("close")
    return b.withColumns({"middle": m, "upper": u, "lower": lo})


add("v05_bands", _bands, "middle", "upper", "lower", oracle=with_(BARS, _BB, select=f"SELECT {KEYS}, round(m, 6) AS middle, round(m + s, 6) AS upper, round(m - s, 6) AS lower FROM w"))
add("v06_bandwidth", lambda b: b.withColumn("bandwidth", volatility.bandwidth("close")), "bandwidth", oracle=with_(BARS, _BB, select=f"SELECT {KEYS}, round({div('2 * s', 'm')}, 6) AS bandwidth FROM w"))
add("v07_percent_b", lambda b: b.withColumn("percent_b", volatility.percent_b("close")), "percent_b", oracle=with_(BARS, _BB, select=f"SELECT {KEYS}, round({div('close - (m - s)', '2 * s')}, 6) AS percent_b FROM w"))
add("v08_turnover", lambda b: b.withColumns({"turnover": F.round(volatility.turnover(), 3), "log_turnover": volatility.turnover(True)}), "turnover", "log_turnover", oracle=plain("round(close * volume, 3) AS turnover, round(ln(1 + close * volume), 6) AS log_turnover"))
add("v09_turnover_zscore", lambda b: b.withColumn("zscore", volatility.turnover_zscore(60, True)), "zscore", oracle=with_(BARS, "t AS (SELECT *, ln(1 + close * volume) AS x FROM b)", select=f"SELECT {KEYS}, round({div('x - (' + frame('median', 'x', -59, -1) + ')', frame('stddev_pop', 'x', -59, -1))}, 6) AS zscore FROM t"))

# candlesticks and levels
add(
    "c01_geometry", lambda b: b.withColumns(candles.geometry()), "signed_body_fraction", "upper_wick_fraction", "lower_wick_fraction", "close_location",
    oracle=plain(f"round({div('close - open', 'high - low')}, 6) AS signed_body_fraction, round({div('high - greatest(open, close)', 'high - low')}, 6) AS upper_wick_fraction, round({div('least(open, close) - low', 'high - low')}, 6) AS lower_wick_fraction, round({div('close - low', 'high - low')}, 6) AS close_location"),
)
_PATR = f"p AS (SELECT t.*, lag(a.y) {LAG.replace('provider, ticker ORDER BY trading_date', 't.provider, t.ticker ORDER BY t.trading_date')} AS patr, high - low AS rg FROM t JOIN a USING ({KEYS}))"
add(
    "c02_range_context", lambda b: candles.add_range_context(b), "range_atr", "gap_atr", "range_percentile",
    oracle=with_(
        BARS, *_ATR, _PATR, f"q AS (SELECT *, row_number() OVER ({sql.P}) AS rn, lag(close) {LAG} AS pc FROM p)",
        "n AS (SELECT x.provider, x.ticker, x.trading_date, count(o.rg) AS n, count_if(o.rg <= x.rg) AS k FROM q x LEFT JOIN q o ON o.provider = x.provider AND o.ticker = x.ticker AND o.rn BETWEEN x.rn - 20 AND x.rn - 1 GROUP BY ALL)",
        select=f"SELECT {KEYS}, round({div('tr', 'patr')}, 6) AS range_atr, round({div('open - pc', 'patr')}, 6) AS gap_atr, round(CASE WHEN n = 20 THEN k / 20.0 END, 6) AS range_percentile FROM q JOIN n USING ({KEYS})",
    ),
)
_PATTERN = ("inside_bar", "outside_bar", "engulfing_strength", "lower_rejection_strength", "upper_rejection_strength", "consecutive_inside_bars")
add(
    "c04_patterns", lambda b: candles.add_patterns(b), *_PATTERN,
    oracle=with_(
        BARS, *_ATR, _PATR,
        f"q AS (SELECT *, lag(high) {LAG} AS ph, lag(low) {LAG} AS pl, greatest(open, close) AS tp, least(open, close) AS bt, close - open AS body, lag(greatest(open, close)) {LAG} AS pt, lag(least(open, close)) {LAG} AS pb, lag(close - open) {LAG} AS pbody FROM p)",
        "s AS (SELECT *, high <= ph AND low >= pl AND (high < ph OR low > pl) AS inside_bar, high >= ph AND low <= pl AND (high > ph OR low < pl) AS outside_bar, coalesce(body * pbody < 0 AND tp >= pt AND bt <= pb AND (bt < pb OR tp > pt), false) AS eng FROM q)",
        f"u AS (SELECT *, sum(CASE WHEN inside_bar THEN 0 ELSE 1 END) OVER ({sql.P}) AS run FROM s)",
        select=f"SELECT {KEYS}, inside_bar, outside_bar, round(CASE WHEN pbody IS NOT NULL AND patr IS NOT NULL THEN CASE WHEN eng THEN sign(body) * {div('abs(body) - abs(pbody)', 'patr')} ELSE 0.0 END END, 6) AS engulfing_strength, round({div('bt - low', 'patr')} * {div('close - low', 'high - low')}, 6) AS lower_rejection_strength, round({div('high - tp', 'patr')} * (1 - {div('close - low', 'high - low')}), 6) AS upper_rejection_strength, CASE WHEN inside_bar THEN CAST(sum(CAST(inside_bar AS INT)) OVER (PARTITION BY provider, ticker, run ORDER BY trading_date) AS BIGINT) WHEN NOT inside_bar THEN 0 END AS consecutive_inside_bars FROM u",
    ),
)
_R = "OVER (PARTITION BY provider, ticker, run ORDER BY trading_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
add(
    "c05_direction_runs", lambda b: candles.add_direction_runs(b), "direction_run", "direction_run_return", "direction_run_body_atr",
    oracle=with_(
        BARS, *_ATR, _PATR,
        f"q AS (SELECT *, CAST(sign(close - open) AS INT) AS dir, {div('close - open', 'patr')} AS ba, lag(close) {LAG} AS pc FROM p)",
        f"s AS (SELECT *, dir = 0 OR lag(dir) {LAG} IS NULL OR dir <> lag(dir) {LAG} AS fresh FROM q)",
        f"u AS (SELECT *, sum(CAST(fresh AS INT)) OVER ({sql.P}) AS run FROM s)",
        select=f"SELECT {KEYS}, CASE WHEN dir = 0 THEN 0 ELSE count(*) {_R} * dir END AS direction_run, round(CASE WHEN dir = 0 THEN 0.0 ELSE close / first(pc) {_R} - 1 END, 6) AS direction_run_return, round(CASE WHEN dir = 0 THEN 0.0 WHEN count(ba) {_R} = count(*) {_R} THEN sum(ba) {_R} END, 6) AS direction_run_body_atr FROM u",
    ),
)
_LEVELS = {
    "close_to_upper_atr": div("close - up", "patr"), "close_to_lower_atr": div("close - dn", "patr"),
    "breakout_high_strength": f"CASE WHEN up IS NOT NULL AND patr IS NOT NULL THEN greatest(0, {div('close - up', 'patr')}) END",
    "breakout_low_strength": f"CASE WHEN dn IS NOT NULL AND patr IS NOT NULL THEN greatest(0, {div('dn - close', 'patr')}) END",
    "failed_break_high_strength": f"CASE WHEN {div('high - up', 'patr')} IS NOT NULL THEN CASE WHEN high > up AND close <= up THEN {div('high - up', 'patr')} ELSE 0.0 END END",
    "failed_break_low_strength": f"CASE WHEN {div('dn - low', 'patr')} IS NOT NULL THEN CASE WHEN low < dn AND close >= dn THEN {div('dn - low', 'patr')} ELSE 0.0 END END",
}
add(
    "c06_level_interactions", lambda b: candles.add_level_interactions(b), "prior_high", "prior_low", *candles.LEVEL_NAMES,
    oracle=with_(BARS, *_ATR, _PATR, f"q AS (SELECT *, {frame('max', 'high', -20, -1)} AS up, {frame('min', 'low', -20, -1)} AS dn FROM p)", select=f"SELECT {KEYS}, round(up, 6) AS prior_high, round(dn, 6) AS prior_low, " + ", ".join(f"round({x}, 6) AS {n}" for n, x in _LEVELS.items()) + " FROM q"),
)
add("c08_bullish_fraction", lambda b: b.withColumns({"fraction": candles.bullish_fraction(), "fraction_before": candles.bullish_fraction(exclude_current=True)}), "fraction", "fraction_before", oracle=with_(BARS, "t AS (SELECT *, CAST(close > open AS INT) AS up FROM b)", select=f"SELECT {KEYS}, round({rolling('avg', 'up', 14)}, 6) AS fraction, round({frame('avg', 'up', -14, -1)}, 6) AS fraction_before FROM t"))

# market structure
add("p00_donchian", lambda b: b.withColumns(dict(zip(("upper", "lower"), structure.donchian(), strict=True))).withColumn("donchian_position", structure.donchian_position()), "upper", "lower", "donchian_position", oracle=with_(BARS, f"q AS (SELECT *, {frame('max', 'high', -20, -1)} AS up, {frame('min', 'low', -20, -1)} AS dn FROM b)", select=f"SELECT {KEYS}, round(up, 6) AS upper, round(dn, 6) AS lower, round({div('close - dn', 'up - dn')}, 6) AS donchian_position FROM q"))
add(
    "p01_pivot_points", lambda b: structure.add_pivot_points(b, 5, 5, 5, 5, "balanced", "rank"), "pivot_high", "pivot_high_rank", "pivot_low", "pivot_low_rank",
    oracle=with_(
        BARS, f"q AS (SELECT *, row_number() OVER ({sql.P}) AS rn FROM b)",
        "n AS (SELECT x.provider, x.ticker, x.trading_date, count(*) AS n, CAST(count_if(o.high > x.high) + 1 AS BIGINT) AS hr, CAST(count_if(o.low < x.low) + 1 AS BIGINT) AS lr FROM q x JOIN q o ON o.provider = x.provider AND o.ticker = x.ticker AND o.rn BETWEEN x.rn - 5 AND x.rn + 5 GROUP BY x.provider, x.ticker, x.trading_date)",
        select=f"SELECT {KEYS}, CASE WHEN n = 11 AND hr = 1 THEN round((2 * high + greatest(open, close)) / 3, 6) END AS pivot_high, CASE WHEN n = 11 THEN hr END AS pivot_high_rank, CASE WHEN n = 11 AND lr = 1 THEN round((2 * low + least(open, close)) / 3, 6) END AS pivot_low, CASE WHEN n = 11 THEN lr END AS pivot_low_rank FROM q JOIN n USING ({KEYS})",
    ),
)
add("p02_zigzag", lambda b: structure.add_zigzag(b), "zigzag_price", "zigzag_direction", "zigzag_return", "zigzag_bars")
add(
    "p03_zigzag_candidates", lambda b: b.withColumns(structure.zigzag_candidates(5)).withColumnsRenamed({"__zh": "high_candidate", "__zl": "low_candidate"}), "high_candidate", "low_candidate",
    oracle=plain(f"CASE WHEN high > ({frame('max', 'high', -5, -1)}) AND high >= ({frame('max', 'high', 1, 5)}) THEN round(high, 6) END AS high_candidate, CASE WHEN low < ({frame('min', 'low', -5, -1)}) AND low <= ({frame('min', 'low', 1, 5)}) THEN round(low, 6) END AS low_candidate"),
)
add("p05_zigzag_state", lambda b: structure.add_zigzag_state(b).withColumnsRenamed({f"__z_{n}": n for n in structure.STATE}), *structure.STATE)
_Z = ("zigzag_last_direction", "zigzag_last_swing_return", "zigzag_last_swing_bars", "zigzag_swing_return_per_bar", "zigzag_bars_since_pivot", "zigzag_retracement")
add("p09_zigzag_features", lambda b: structure.add_zigzag_features(b), *_Z, "market_structure_high_change", "market_structure_low_rate", "market_structure_leg_balance", "market_structure_efficiency")

# feature families: the indicators above over adjusted bars, under the names that the families give them
ADJUSTED = BARS.replace("b AS (", "raw AS (", 1) + """,
b AS (SELECT provider, ticker, trading_date, open * (adjusted_close / close) AS open, high * (adjusted_close / close) AS high, low * (adjusted_close / close) AS low,
  adjusted_close AS close, volume, adjusted_close FROM raw)"""


def _over_adjusted(*parts: tuple[str, dict[str, str]]) -> str:
    """Columns, under other names, of several oracles joined by key, each over adjusted bars."""
    asked = [f"{name}.{old} AS {new}" for name, columns in parts for old, new in columns.items()]
    sources = [f"({SQL[name].replace(BARS, ADJUSTED)}) {name}" for name, _ in parts]
    return f"SELECT {KEYS}, {', '.join(asked)} FROM {sources[0]} " + " ".join(f"JOIN {x} USING ({KEYS})" for x in sources[1:])


def _percent_b(x: str) -> str:
    m, s = rolling("avg", x, 20), rolling("stddev_pop", x, 20)
    return div(f"{x} - (({m}) - 2.0 * ({s}))", f"4.0 * ({s})")


_EMAS = {"fast": 10, "mid": 20, "slow": 50}
add(
    "x05_trend_family", lambda b: features.add_trend_features(b), *features.TREND,
    oracle=with_(
        ADJUSTED, *[ewm(n, "b", "close", ema_alpha(k), k) for n, k in _EMAS.items()],
        f"f AS (SELECT b.*, fast.y AS ef, mid.y AS em, slow.y AS es, {', '.join(f'CASE WHEN {n}.y IS NOT NULL THEN CAST(close > {n}.y AS INT) END AS up_{n}' for n in _EMAS)} FROM b JOIN fast USING ({KEYS}) JOIN mid USING ({KEYS}) JOIN slow USING ({KEYS}))",
        f"v AS (SELECT *, {div('close', div(rolling('sum', '((high + low + close) / 3.0 * volume)', 20), rolling('sum', 'volume', 20)))} - 1 AS vd FROM f)",
        f"adx AS ({SQL['m09_adx'].replace(BARS, ADJUSTED)})",
        select=f"SELECT {KEYS}, round({div('ef', 'em')} - 1, 6) AS ema_fast_to_ema_mid, round({div('em', 'es')} - 1, 6) AS ema_mid_to_ema_slow, round({div('em', rolling('avg', 'close', 20))} - 1, 6) AS ema_mid_to_sma_mid, "
        + ", ".join(f"round({div('close', x)} - 1, 6) AS close_to_ema_{n}, round({frame('avg', f'up_{n}', -20, -1)}, 6) AS close_over_ema_{n}_fraction" for n, x in (("fast", "ef"), ("mid", "em"), ("slow", "es")))
        + f", round(vd, 6) AS vwap_distance, round({_percent_b('vd')}, 6) AS vwap_distance_percent_b, adx, plus_di, minus_di FROM v JOIN adx USING ({KEYS})",
    ),
)
_PPO = (ewm("pf", "b", "close", ema_alpha(12), 12), ewm("ps", "b", "close", ema_alpha(26), 26), f"pm AS (SELECT {KEYS}, {div('pf.y - ps.y', 'ps.y')} AS line FROM pf JOIN ps USING ({KEYS}))", ewm("pg", "pm", "line", ema_alpha(9), 9))
add(
    "x06_momentum_family", lambda b: features.add_momentum_features(b), *features.MOMENTUM,
    oracle=with_(
        ADJUSTED, *_PPO, f"pn AS (SELECT pm.*, pg.y AS signal, count(line) OVER ({sql.P.replace('provider, ticker', 'pm.provider, pm.ticker').replace('BY trading_date', 'BY pm.trading_date')}) AS seen FROM pm JOIN pg USING ({KEYS}))",
        "pe AS (SELECT x.provider, x.ticker, x.trading_date, CASE WHEN x.line IS NOT NULL AND x.seen > 100 THEN CAST(count_if(o.line <= x.line) AS DOUBLE) / (x.seen - 1) END AS pct FROM pn x LEFT JOIN pn o ON o.provider = x.provider AND o.ticker = x.ticker AND o.trading_date < x.trading_date GROUP BY x.provider, x.ticker, x.trading_date, x.line, x.seen)",
        *_rsi(21), f"rs AS (SELECT {KEYS}, {div('100 * g.y', 'g.y + l.y')} AS rsi FROM g JOIN l USING ({KEYS}))",
        *(x.replace("t AS (", "mt AS (", 1).replace("d AS (", "md AS (", 1).replace("s AS (", "ms AS (", 1).replace("FROM t)", "FROM mt)").replace("FROM d)", "FROM md)") for x in _MFI),
        f"mf AS (SELECT {KEYS}, {div(f'100 * ({rolling("sum", "pos", 14)})', f'({rolling("sum", "pos", 14)}) + ({rolling("sum", "neg", 14)})')} AS mfi FROM ms)",
        f"st AS ({SQL['m06_stochastic'].replace(BARS, ADJUSTED)})", f"sq AS ({SQL['m12_squeeze'].replace(BARS, ADJUSTED)})",
        f"al AS (SELECT {KEYS}, line, signal, pct, rsi, mfi FROM pn JOIN pe USING ({KEYS}) JOIN rs USING ({KEYS}) JOIN mf USING ({KEYS}))",
        select=f"SELECT {KEYS}, round(line, 6) AS ppo, round(signal, 6) AS ppo_signal, round(line - signal, 6) AS ppo_histogram, round(pct, 6) AS ppo_percentile, round(rsi, 6) AS rsi, round({_percent_b('rsi')}, 6) AS rsi_percent_b, stochastic_k, stochastic_d, round(mfi, 6) AS mfi, round({_percent_b('mfi')}, 6) AS mfi_percent_b, "
        + ", ".join(c for c in _SQUEEZE if c != "squeeze_momentum") + f" FROM al JOIN st USING ({KEYS}) JOIN sq USING ({KEYS})",
    ),
)
add(
    "x07_volatility_family", lambda b: features.add_volatility_features(b), *features.VOLATILITY,
    oracle=_over_adjusted(("v04_adr", {"adr_percent": "adr_percent"}), ("v03_atr_percent", {"atr_percent": "atr_percent"}), ("v06_bandwidth", {"bandwidth": "bollinger_bandwidth"}), ("v07_percent_b", {"percent_b": "bollinger_percent_b"})),
)
_ACTION = {
    "c01_geometry": {n: f"candle_{n}" for n in ("signed_body_fraction", "upper_wick_fraction", "lower_wick_fraction", "close_location")},
    "c02_range_context": {"range_atr": "candle_range_atr", "gap_atr": "candle_gap_atr", "range_percentile": "range_percentile_20"},
    "c04_patterns": {n: f"candle_{n}" for n in _PATTERN},
    "c05_direction_runs": {n: f"candle_{n}" for n in ("direction_run", "direction_run_return", "direction_run_body_atr")},
    "c06_level_interactions": dict(zip(_LEVELS, (f"candle_{n}_20" for n in ("close_to_prior_high_atr", "close_to_prior_low_atr", "breakout_high_strength", "breakout_low_strength", "failed_breakout_high_strength", "failed_breakout_low_strength")), strict=True)),
    "c08_bullish_fraction": {"fraction_before": "rolling_bullish_candle_fraction"},
}
add("x08_price_action_family", lambda b: features.add_price_action_features(b), *[n for columns in _ACTION.values() for n in columns.values()], oracle=_over_adjusted(*_ACTION.items()))
add("x09_volume_family", lambda b: features.add_volume_features(b), "turnover_zscore", oracle=with_(BARS, "t AS (SELECT *, ln(1 + close * volume) AS x FROM b)", select=f"SELECT {KEYS}, round({div('x - (' + frame('median', 'x', -251, -1) + ')', frame('stddev_pop', 'x', -251, -1))}, 6) AS turnover_zscore FROM t"))
add("x10_market_structure_family", lambda b: features.add_market_structure_features(b), *features.STRUCTURE)

# returns and cross-section
_RET = ", ".join(f"round(adjusted_close / lag(adjusted_close, {h}) {LAG} - 1, 6) AS return_{h}d" for h in (1, 5, 10, 20))
add("x01_returns", lambda b: cross_section.add_returns(b), "return_1d", "return_5d", "return_10d", "return_20d", oracle=plain(_RET))


def _percentile(x: str, least: int) -> str:
    d = "PARTITION BY provider, trading_date"
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER ({d}) >= {least} THEN (rank() OVER ({d} ORDER BY {x} NULLS LAST) + (count({x}) OVER ({d}, {x}) - 1) / 2.0 - 0.5) / count({x}) OVER ({d}) END"


def _cross_sql(horizons: tuple[int, ...]) -> str:
    """Percentiles of returns over calendar horizons, and breadth, mean and median of the first one."""
    every = lambda t: ", ".join(t.format(h=h) for h in horizons)
    return with_(
        BARS, "cal AS (SELECT *, " + every("lag(trading_date, {h}) OVER (ORDER BY trading_date) AS e{h}") + " FROM (SELECT DISTINCT trading_date FROM b))",
        f"rt AS (SELECT b.*, {every('e{h}')}, " + ", ".join(f"lag(trading_date, {h}) {LAG} AS d{h}, adjusted_close / lag(adjusted_close, {h}) {LAG} - 1 AS q{h}" for h in horizons) + " FROM b JOIN cal USING (trading_date))",
        "r AS (SELECT *, " + every("CASE WHEN d{h} = e{h} THEN q{h} END AS r{h}") + " FROM rt)",
        select=f"SELECT {KEYS}, " + ", ".join(f"round({_percentile(f'r{h}', 2)}, 6) AS return_{h}d_cross_sectional_percentile" for h in horizons)
        + ", CASE WHEN count(r1) OVER d >= 2 THEN round(avg(CAST(r1 > 0 AS INT)) OVER d, 6) END AS market_breadth_positive_1d, CASE WHEN count(r1) OVER d >= 2 THEN round(avg(r1) OVER d, 6) END AS market_mean_return_1d, CASE WHEN count(r1) OVER d >= 2 THEN round(median(r1) OVER d, 6) END AS market_median_return_1d FROM r WINDOW d AS (PARTITION BY provider, trading_date)",
    )


_H = (1, 5)
add(
    "x04_cross_section", lambda b: cross_section.add_cross_section(b, _H, 1, 2),
    "return_1d_cross_sectional_percentile", "return_5d_cross_sectional_percentile", "market_breadth_positive_1d", "market_mean_return_1d", "market_median_return_1d",
    oracle=_cross_sql(_H),
)
_SHOWN = [c for c in catalog.FEATURES.outputs if c not in features.STRUCTURE]
_FAMILIES = [SQL["x01_returns"], _cross_sql((1, 5, 10, 20)), *(SQL[n] for n in ("x05_trend_family", "x06_momentum_family", "x07_volatility_family", "x08_price_action_family", "x09_volume_family"))]
add(
    "x12_default_features_by_family", catalog.add_default_features, *_SHOWN,
    oracle=f"SELECT {KEYS}, {', '.join(_SHOWN)} FROM ({_FAMILIES[0]}) AS f0 " + " ".join(f"JOIN ({q}) AS f{k} USING ({KEYS})" for k, q in enumerate(_FAMILIES[1:], 1)),
)

# targets
add("t01_forward_returns", lambda b: targets.add_forward_returns(b), "forward_return_5d", "forward_return_10d", "forward_return_15d", oracle=plain(", ".join(f"round(lead(adjusted_close, {h}) {LAG} / adjusted_close - 1, 6) AS forward_return_{h}d" for h in (5, 10, 15))))
add("t02_fixed_return", lambda b: targets.add_forward_returns(b, (5,)).withColumn("target_significant_up_5d", targets.above("forward_return_5d")), "target_significant_up_5d", oracle=plain(f"lead(adjusted_close, 5) {LAG} / adjusted_close - 1 > {targets.FIXED_RETURN!r} AS target_significant_up_5d"))
add("t03_future_max_return", lambda b: targets.add_future_max_returns(b, (5, 10)), "future_max_return_5d", "future_max_return_10d", oracle=plain(", ".join(f"round(({frame('max', 'high', 1, h)}) / lead(open) {LAG} - 1, 6) AS future_max_return_{h}d" for h in (5, 10))))
add(
    "t04_cross_sectional_targets", lambda b: targets.add_cross_sectional_targets(b, (5,), 16, 5), "market_relative_forward_return_5d", "forward_return_5d_cross_sectional_percentile", "forward_return_5d_relevance_grade",
    oracle=with_(
        BARS, "cal AS (SELECT *, lead(trading_date, 5) OVER (ORDER BY trading_date) AS e5 FROM (SELECT DISTINCT trading_date FROM b))",
        f"rt AS (SELECT b.*, e5, lead(trading_date, 5) {LAG} AS d5, lead(adjusted_close, 5) {LAG} / adjusted_close - 1 AS q5 FROM b JOIN cal USING (trading_date))",
        "r AS (SELECT *, CASE WHEN d5 = e5 THEN q5 END AS r FROM rt)",
        f"k AS (SELECT *, {_percentile('r', 5)} AS p, CASE WHEN count(r) OVER d >= 5 THEN avg(r) OVER d END AS m FROM r WINDOW d AS (PARTITION BY provider, trading_date))",
        select=f"SELECT {KEYS}, round((1 + r) / (1 + m) - 1, 6) AS market_relative_forward_return_5d, round(p, 6) AS forward_return_5d_cross_sectional_percentile, CAST(greatest(0, least(15, floor(p * 16))) * (CASE WHEN p IS NULL THEN NULL ELSE 1 END) AS BIGINT) AS forward_return_5d_relevance_grade FROM k",
    ),
)
add(
    "t05_triple_barrier", lambda b: targets.add_triple_barrier(b, (5, 10)), *[f"{n}_{h}d" for h in (5, 10) for n in ("triple_barrier_label", "time_to_event", "target_end_date")],
    oracle=with_(
        BARS, "ad AS (SELECT provider, ticker, trading_date, open * adjusted_close / close AS open, high * adjusted_close / close AS high, low * adjusted_close / close AS low, adjusted_close AS close FROM b)",
        f"t AS (SELECT *, {TRUE_RANGE} AS tr, row_number() OVER ({sql.P}) AS rn FROM ad)", ewm("a", "t", "tr", _W, 14),
        f"s AS (SELECT t.*, lead(open) OVER (PARTITION BY t.provider, t.ticker ORDER BY t.trading_date) AS entry, a.y AS atr, max(rn) OVER (PARTITION BY t.provider, t.ticker) AS last FROM t JOIN a USING ({KEYS}))",
        "e AS (SELECT s.provider, s.ticker, s.trading_date, min(CASE WHEN f.low <= s.entry - s.atr OR f.high >= s.entry + 2 * s.atr THEN f.rn - s.rn END) AS k FROM s JOIN s f ON f.provider = s.provider AND f.ticker = s.ticker AND f.rn BETWEEN s.rn + 1 AND s.rn + 10 WHERE s.atr > 0 AND s.entry - s.atr > 0 GROUP BY ALL)",
        "l AS (SELECT e.*, s.rn, s.last, CASE WHEN f.open <= s.entry - s.atr THEN -1 WHEN f.open >= s.entry + 2 * s.atr THEN 1 WHEN f.low <= s.entry - s.atr THEN -1 ELSE 1 END AS lab FROM e JOIN s USING (provider, ticker, trading_date) LEFT JOIN s f ON f.provider = e.provider AND f.ticker = e.ticker AND f.rn = s.rn + e.k)",
        "h AS (SELECT *, " + ", ".join(f"CASE WHEN k <= {h} THEN lab WHEN last - rn >= {h} THEN 0 END AS lab{h}, CASE WHEN k <= {h} THEN k WHEN last - rn >= {h} THEN {h} END AS at{h}" for h in (5, 10)) + " FROM l)",
        select=f"SELECT b.provider, b.ticker, b.trading_date, " + ", ".join(f"CAST(lab{h} AS INTEGER) AS triple_barrier_label_{h}d, CAST(at{h} AS BIGINT) AS time_to_event_{h}d, d{h}.trading_date AS target_end_date_{h}d" for h in (5, 10)) + " FROM b LEFT JOIN h USING (provider, ticker, trading_date)" + "".join(f" LEFT JOIN s d{h} ON d{h}.provider = b.provider AND d{h}.ticker = b.ticker AND d{h}.rn = h.rn + h.at{h}" for h in (5, 10)),
    ),
)
