"""Indicators against pandas, written from their definitions, and the invariances that all of them have."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.core import ewm, runs
from barloom.operators import candles, cross_section, structure, targets, trend, volatility
from barloom.plans import catalog

DAY = dt.date(2020, 1, 1)


def walk(n=140, tickers=("A", "B"), seed=0, gaps=()):
    rng = np.random.default_rng(seed)
    rows = []
    for k, t in enumerate(tickers):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        for i in range(n):
            o = close[i] * (1 + rng.normal(0, 0.01))
            hi, lo = max(o, close[i]) * (1 + abs(rng.normal(0, 0.01))), min(o, close[i]) * (1 - abs(rng.normal(0, 0.01)))
            c = None if i in gaps else float(close[i])
            rows.append(("p", t, DAY + dt.timedelta(days=i), float(o), float(hi), float(lo), c, None if c is None else c * (0.5 + 0.1 * k), int(rng.integers(1, 1000))))
    return rows


SCHEMA = "provider string, ticker string, trading_date date, open double, high double, low double, close double, adjusted_close double, volume long"


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(), SCHEMA).cache()


def frame_of(df, *names):
    return df.select("ticker", "trading_date", *names).toPandas().sort_values(["ticker", "trading_date"]).reset_index(drop=True)


def expect(df, name, want):
    got = frame_of(df, name)[name].astype("float64")
    np.testing.assert_allclose(got.to_numpy(), np.asarray(want, dtype="float64"), rtol=1e-9, atol=1e-9)


def per_ticker(bars, f):
    pdf = frame_of(bars, "open", "high", "low", "close", "adjusted_close", "volume")
    return pd.concat([f(g.reset_index(drop=True)) for _, g in pdf.groupby("ticker")]).to_numpy()


def wilder(s, n):
    return s.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()


def true_range(g):
    pc = g.close.shift()
    return pd.concat([g.high - g.low, (g.high - pc).abs(), (g.low - pc).abs()], axis=1).max(axis=1)


def test_rsi_atr_and_adx(bars):
    def rsi(g):
        d = g.close.diff()
        a, b = wilder(d.clip(lower=0), 14), wilder((-d).clip(lower=0), 14)
        return 100 * a / (a + b)

    expect(trend.add_rsi(bars, "close"), "rsi", per_ticker(bars, rsi))
    expect(trend.add_atr(bars), "atr", per_ticker(bars, lambda g: wilder(true_range(g), 14)))

    def adx(g):
        up, dn = g.high.diff(), -g.low.diff()
        p, m = up.where((up > dn) & (up > 0), 0.0), dn.where((dn > up) & (dn > 0), 0.0)
        tr = wilder(true_range(g), 14)
        pi, mi = 100 * wilder(p, 14) / tr, 100 * wilder(m, 14) / tr
        return wilder(100 * (pi - mi).abs() / (pi + mi), 14)

    expect(trend.add_adx(bars), "adx", per_ticker(bars, adx))


def test_smoothing_over_interior_gaps(spark):
    df = spark.createDataFrame(walk(60, ("A",), gaps=(0, 1, 20, 21, 40)), SCHEMA)
    got = frame_of(ewm(df, {"y": ("close", 0.2, 5)}), "y", "close")
    want = got["close"].astype("float64").ewm(alpha=0.2, adjust=False, ignore_na=False, min_periods=5).mean()
    np.testing.assert_allclose(got["y"].astype("float64"), want, rtol=1e-12)
    y = got["y"]
    assert y[20] == y[19] == y[21]


def test_percent_b_and_zscore(bars):
    def pb(g):
        m, s = g.close.rolling(20).mean(), g.close.rolling(20).std(ddof=0)
        return (g.close - (m - 2 * s)) / (4 * s)

    expect(bars.withColumn("x", volatility.percent_b("close")), "x", per_ticker(bars, pb))

    def z(g):
        t = g.close * g.volume
        p = t.shift()
        return (t - p.rolling(19).median()) / p.rolling(19).std(ddof=0)

    expect(bars.withColumn("x", volatility.turnover_zscore(20)), "x", per_ticker(bars, z))


def test_flat_prices_give_missing_ratios(spark):
    df = spark.createDataFrame([("p", "A", DAY + dt.timedelta(days=i), 5.0, 5.0, 5.0, 5.0, 5.0, 10) for i in range(40)], SCHEMA)
    df = trend.add_stochastic(trend.add_rsi(df, "close")).withColumns({"b": volatility.percent_b("close"), **candles.geometry()})
    last = df.filter(F.col("trading_date") == DAY + dt.timedelta(days=39)).first()
    assert all(last[c] is None for c in ("rsi", "stochastic_k", "b", "signed_body_fraction", "close_location"))


def test_runs_reset_and_stay_missing(spark):
    on = [True, True, None, True, False, True, True, True]
    df = spark.createDataFrame([("p", "A", DAY + dt.timedelta(days=i), x) for i, x in enumerate(on)], "provider string, ticker string, trading_date date, x boolean")
    got = [r["n"] for r in runs(df, F.col("x"), "n").orderBy("trading_date").collect()]
    assert got == [1, 2, None, 1, 0, 1, 2, 3]


def test_zigzag_rules():
    pivots = []
    for at, (h, lo) in enumerate([(10.0, None), (11.0, None), (None, 10.9), (None, 9.0), (9.2, 8.0), (12.0, 7.0)]):
        structure.step(pivots, at, h, lo, 0.05)
    # the first counts; a higher high replaces; a small reversal is ignored; a lower low replaces; the high goes first
    assert pivots == [(1, 11.0, 1), (3, 9.0, -1), (5, 12.0, 1)] or pivots == [(1, 11.0, 1), (4, 8.0, -1), (5, 12.0, 1)]
    assert structure.kendall([1.0, 2.0, 3.0, 4.0]) == 1.0
    assert structure.kendall([2.0, 2.0]) is None
    assert structure.leg_dynamics([(0, 1.0, -1), (1, 2.0, 1), (2, 1.0, -1)], 2) == (0.0, 0.0)


@pytest.mark.parametrize(
    ("bars_ahead", "policy", "want"),
    [
        ([(100, 103, 99.5, 102)], "stop_loss_first", (1, 1)),
        ([(100, 101, 98.5, 99)], "stop_loss_first", (-1, 1)),
        ([(100, 101, 99.5, 100), (98, 99, 97, 98)], "stop_loss_first", (-1, 2)),
        ([(100, 103, 98, 99)], "stop_loss_first", (-1, 1)),
        ([(100, 103, 98, 99)], "take_profit_first", (1, 1)),
        ([(100, 103, 98, 99)], "candle_path", (1, 1)),
        ([(100, 103, 98, 99)], "exclude", (None, None)),
        ([(100, 100.5, 99.5, 100)] * 2, "stop_loss_first", (0, 2)),
        ([(100, 100.5, 99.5, 100)], "stop_loss_first", (None, None)),
    ],
)
def test_triple_barrier_first_touch(spark, bars_ahead, policy, want):
    past = [(100.0, 100.5, 99.5, 100.0)] * 3
    rows = [("p", "A", DAY + dt.timedelta(days=i), *map(float, b), float(b[3]), 1) for i, b in enumerate([*past, *bars_ahead])]
    df = spark.createDataFrame(rows, SCHEMA)
    out = targets.add_triple_barrier(df, (2,), 2, 1.0, 2.0, policy)
    r = out.filter(F.col("trading_date") == DAY + dt.timedelta(days=2)).first()
    assert (r["triple_barrier_label_2d"], r["time_to_event_2d"]) == want


def test_cross_section_ties_and_calendar(spark):
    rows = []
    for t, closes in {"A": (1, 2, 4), "B": (1, 2, 4), "C": (1, 3, 3), "D": (1, None, 5)}.items():
        rows += [("p", t, DAY + dt.timedelta(days=i), 1.0, 1.0, 1.0, 1.0, float(c), 1) for i, c in enumerate(closes) if c is not None]
    df = cross_section.add_cross_section(spark.createDataFrame(rows, SCHEMA), (1,), 1, 2)
    got = {(r["ticker"], r["trading_date"].day): r for r in df.collect()}
    p = "return_1d_cross_sectional_percentile"
    assert [got[t, 3][p] for t in "ABCD"] == [pytest.approx(2 / 3)] * 2 + [pytest.approx(0.5 / 3), None]
    assert got["A", 3]["market_breadth_positive_1d"] == pytest.approx(2 / 3)


def test_default_features_are_their_families_and_ignore_the_future(spark):
    rows = walk(130, ("A", "B"), 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    every = catalog.add_default_features(df)
    assert len(catalog.FEATURES.outputs) == 92
    assert every.columns == [*df.columns, *catalog.FEATURES.outputs]
    names = [n for n in catalog.FEATURES.outputs if dict(every.dtypes)[n] == "double"]
    whole = frame_of(every, *names)
    part = frame_of(catalog.FEATURES.select(["trend", "volatility"]).apply(df), *[n for b in catalog.FEATURES.blocks if b.name in ("trend", "volatility") for n in b.outputs])
    for n in part.columns[2:]:
        np.testing.assert_allclose(part[n].astype(float), whole[n].astype(float), rtol=1e-9)
    # fewer rows of the future, raw prices split by 2 with adjusted prices kept: nothing changes
    cut = [(p, t, d, o / 2, h / 2, lo / 2, c / 2, a, v * 2) for p, t, d, o, h, lo, c, a, v in rows if d < DAY + dt.timedelta(days=120)]
    again = frame_of(catalog.add_default_features(spark.createDataFrame(cut, SCHEMA)), *names)
    first = whole[whole.trading_date < DAY + dt.timedelta(days=120)].reset_index(drop=True)
    for n in names:
        np.testing.assert_allclose(again[n].astype(float), first[n].astype(float), rtol=1e-7, atol=1e-9, err_msg=n)


def test_bad_arguments_are_refused(bars):
    for call in (
        lambda: trend.sma("close", 0), lambda: trend.add_macd(bars, lengths=(26, 12, 9)), lambda: volatility.bands("close", 5, 0), lambda: targets.add_triple_barrier(bars, intrabar_policy="x"),
        lambda: cross_section.add_returns(bars.withColumn("return_1d", F.lit(1))), lambda: structure.add_zigzag_state(bars, dynamics_legs=5), lambda: catalog.FEATURES.apply(bars.drop("close")),
    ):
        with pytest.raises(ValueError):
            call()
