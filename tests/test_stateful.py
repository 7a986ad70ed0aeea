"""Stateful features over a stream equal those over a table: shuffled and late rows, gaps, a restart."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import candles, structure, trend
from barloom.plans import surface
from barloom.streaming import features as sf

BARS = "provider string, ticker string, trading_date timestamp, open double, high double, low double, close double"
START = dt.datetime(2024, 1, 1)


def some_bars(n=150, seed=3, tickers="AB"):
    rng, out = random.Random(seed), []
    for t in tickers:
        price = 100.0
        for k in range(n):
            o = price
            price = max(5.0, price * math.exp(rng.gauss(0, 0.03)))
            c = o if rng.random() < 0.05 else price
            row = [o, max(o, c) * 1.01, min(o, c) * 0.99, c]
            if rng.random() < 0.03:
                row[rng.randrange(4)] = None
            out.append(("p", t, START + dt.timedelta(hours=k), *row))
    return out


def batch(spark, rows):
    df = spark.createDataFrame(rows, BARS)
    df = trend.add_adx(candles.add_direction_runs(df).select(*df.columns, "direction_run"))
    df = structure.add_zigzag_state(df)
    return {(r["ticker"], r["trading_date"]): r for r in df.collect()}


def same(a, b):
    return a is None and b is None or a is not None and b is not None and a == pytest.approx(b, rel=1e-9, abs=1e-9)


def check(got, want, n):
    assert len(got) == n
    for r in got:
        w = want[r["ticker"], r["trading_date"]]
        assert r["direction_run"] == w["direction_run"]
        for name in sf.ADX:
            assert same(r[name], w[name]), (name, r, w)
        for name in structure.STATE:
            assert same(r[f"zigzag_{name}"], w[f"__z_{name}"]), (name, r["trading_date"])


def test_the_fold_alone_equals_the_table_and_survives_being_stored(spark):
    rows = some_bars(200, 5, "A")
    want, got, fold = batch(spark, rows), [], sf.Fold()
    for r in rows:
        fold = sf.Fold().load(fold.dump())  # as if restarted after every bar
        got.append(dict(zip((*sf.RUNS, *sf.ADX, *sf.ZIGZAG), fold.push(int(r[2].timestamp()), *r[3:]), strict=True)) | {"ticker": "A", "trading_date": r[2]})
    check(got, want, 200)
    assert len(fold.dump()) < 3000
    with pytest.raises(ValueError):
        sf.Fold(dynamics_legs=3)


def test_a_stream_equals_the_table_across_a_restart(spark, tmp_path):
    sf.state_store(spark)
    rng, rows = random.Random(1), some_bars()
    source, checkpoint, out = (str(tmp_path / n) for n in ("in", "checkpoint", "out"))

    def arrive(part):
        part = list(part)
        rng.shuffle(part)
        spark.createDataFrame(part, BARS).coalesce(1).write.mode("append").parquet(source)

    def run():
        bars = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(source)
        q = sf.stateful_features(bars, "6 hours").writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        assert q.awaitTermination(240)

    hour = lambda k: START + dt.timedelta(hours=k)
    within = lambda a, z: [r for r in rows if hour(a) <= r[2] < hour(z)]
    at = lambda *hours: [r for r in rows if r[2] in [hour(h) for h in hours]]
    arrive([r for r in within(0, 60) if r not in at(50, 57, 58)])
    run()
    arrive([*within(60, 80), *at(57, 58), *at(50), *at(3, 55)])  # within the watermark, too late, and repeated
    arrive(within(80, 150))
    run()
    got = spark.read.parquet(out).collect()
    there = [r for r in rows if r not in at(50)]
    used = [r for r in there if r[2] <= hour(149 - 6)]
    check([r.asDict() for r in got], batch(spark, there), len(used))
    assert {(r["ticker"], r["trading_date"]) for r in got} == {(r[1], r[2]) for r in used}
    assert spark.read.parquet(out).agg(F.count("zigzag_last_price")).first()[0] > 100


def test_a_pivot_at_zero_is_left_by_any_other_price(spark):
    pivots = []
    for at, (high, low) in enumerate([(None, 0.0), (0.0, None), (3.0, None), (None, 0.0)]):
        structure.step(pivots, at, high, low, 0.05)
    assert pivots == [(0, 0.0, -1), (2, 3.0, 1), (3, 0.0, -1)]
    rows = [(*r[:5], 0.0 if k % 40 == 20 else r[5], r[6]) for k, r in enumerate(some_bars(150, 7, "A"))]
    want, fold, got = batch(spark, rows), sf.Fold(), []
    for r in rows:
        got.append(dict(zip((*sf.RUNS, *sf.ADX, *sf.ZIGZAG), fold.push(int(r[2].timestamp()), *r[3:]), strict=True)) | {"ticker": "A", "trading_date": r[2]})
    check(got, want, 150)
    df = spark.createDataFrame(rows, BARS)
    found = {r["trading_date"]: r for r in structure.add_zigzag(df).collect()}
    kept = [r for _, r in sorted(found.items()) if r["zigzag_price"] is not None]
    after = [b for a, b in zip(kept, kept[1:], strict=False) if a["zigzag_price"] == 0]
    assert len(after) >= 2 and all(r["zigzag_return"] is None and r["zigzag_bars"] > 0 for r in after)
    surface.register(spark)
    for r in spark.sql("SELECT * FROM zigzag(TABLE({b}) PARTITION BY (provider, ticker) ORDER BY (trading_date), 5.0D, 10)", b=df).collect():
        assert all(r[n] == found[r["trading_date"]][n] for n in ("zigzag_price", "zigzag_direction", "zigzag_return", "zigzag_bars"))
