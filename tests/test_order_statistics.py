"""Selection, counting of earlier values, permutations and reports against plain Python."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import selection
from barloom.operators import evaluation, labeling, studies, trend

KEYS = ["provider", "ticker", "trading_date"]
D = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(700)]


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 0.98, 1.0])
def test_selection_equals_sorting_even_when_few_values_may_be_held(spark, share):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1000.0 - 3e5).alias("spread"), (F.col("id") % 3).cast("double").alias("ties"),
        F.exp(-F.col("id") / 500.0).alias("steep"), F.lit(None).cast("double").alias("none"), F.when(F.col("id") == 5, F.lit(1.5)).alias("one"),
    )
    columns = {c: F.col(c) for c in df.columns}
    want = df.agg(*[F.percentile(c, share).alias(c) for c in df.columns]).first()
    for most in (20_000, 300):
        got = selection.exact_percentiles(df, columns, share, most)
        assert all(got[c] is None and want[c] is None or got[c] == pytest.approx(want[c], rel=1e-12, abs=1e-12) for c in df.columns)
    assert selection.exact_percentiles(df.limit(0), columns, share) == dict.fromkeys(df.columns)
    assert selection.exact_percentiles(df, {}, share) == {}


def test_what_is_held_by_the_driver_is_bounded(spark, monkeypatch):
    seen = []
    collect = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: seen.append(len(out := collect(self))) or out)
    df = spark.range(2_000_000).select(F.xxhash64("id").cast("double").alias("x"))
    got = selection.exact_percentiles(df, {"x": F.col("x")}, 0.5, 2_000)
    assert max(seen) <= 4_000
    x = np.sort(np.array([r[0] for r in collect(df)]))
    assert got["x"] == x[999_999] + (x[1_000_000] - x[999_999]) * 0.5


def test_earlier_values_are_counted_in_blocks_as_in_one_group(spark):
    rng = random.Random(3)
    rows = [("p", t, D[k], None if rng.random() < 0.1 else round(rng.gauss(0, 2), 1)) for t, n in (("A", 600), ("B", 40), ("C", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "provider string, ticker string, trading_date date, x double").repartition(3)
    want = {}
    for t in "ABC":
        seen = []
        for _, _, day, v in (r for r in rows if r[1] == t):
            want[t, day] = None if v is None or len(seen) < 10 else sum(s <= v for s in seen) / len(seen)
            if v is not None:
                seen.append(v)
    for block in (None, 7, 64, 10_000):
        got = {(r["ticker"], r["trading_date"]): r["s"] for r in trend.add_expanding_percentile(df, "x", 10, "s", block).collect()}
        assert got == want, block
    v = np.array([rng.choice([1.0, 2.0, 3.0, np.nan]) for _ in range(3000)])
    assert trend.earlier_at_most(v).tolist() == [int((v[:i] <= v[i]).sum()) for i in range(3000)]


def predictions(spark, days=6, tickers=9, seed=2):
    rng = random.Random(seed)
    rows = [("p", f"T{t}", D[d], int(rng.random() < 0.5), round(rng.random(), 1), 0, rng.gauss(0, 1)) for d in range(days) for t in range(tickers)]
    rows = [(*r[:5], int(r[4] >= 0.5), r[6]) for r in rows]
    return rows, spark.createDataFrame(rows, "provider string, ticker string, trading_date date, target int, score double, predicted_class int, ranking_return double")


def test_permutations_equal_plain_python(spark):
    rows, p = predictions(spark)
    days = sorted({r[2] for r in rows})

    def mean_of(order):
        return sum(sum(r[6] for r in sorted((r for r in rows if r[2] == d), key=order)[:3]) / 3 for d in days) / len(days)

    observed = mean_of(lambda r: (-r[4], r[1]))
    shuffled = [mean_of(lambda r, b=b: (hashlib.sha256(f"{b}\x1f0\x1fp\x1f{r[1]}\x1f{r[2]}".encode()).hexdigest(), r[1])) for b in range(40)]
    got = studies.permutation_test(p.repartition(5), 3, 40).first()
    assert got["observed"] == pytest.approx(observed) and got["p_value"] == pytest.approx((1 + sum(m >= observed for m in shuffled)) / 41)
    assert studies.permutation_test(p.limit(0), 3, 40).count() == 0


def test_a_report_has_missingness_context_and_daily_means(spark):
    rows, p = predictions(spark)
    features = p.select(*KEYS, F.when(F.col("score") > 0.3, F.col("score")).alias("a"), F.lit(1.0).alias("b")).unionByName(spark.createDataFrame([("p", "other", D[0], None, None)], "provider string, ticker string, trading_date date, a double, b double"))
    out = evaluation.evaluate(p, 3, features=features, feature_columns=["a", "b"], context={"model": "m"})
    m, by_date = out["metrics"].first(), out["by_date"].collect()
    assert m["model"] == "m" and m["dates"] == 6
    assert m["mean_daily_spearman"] == pytest.approx(np.mean([r["spearman"] for r in by_date]))
    assert m["mean_top_k_return"] == pytest.approx(np.mean([r["top_k_mean_return"] for r in by_date]))
    gone = {r["feature"]: r["missing"] for r in out["missingness"].collect()}
    assert gone == {"a": sum(r[4] <= 0.3 for r in rows), "b": 0}
    with pytest.raises(ValueError):
        evaluation.evaluate(p, context={"rows": "x"})


def test_context_rows_meet_windows_by_row_number(spark):
    rules = labeling.LabelingRules(window_size=10, step_size=5, forward_horizon=8)
    bars = spark.createDataFrame([("p", t, D[k], float(k)) for t in "AB" for k in range(60)], "provider string, ticker string, trading_date date, close double")
    windows = labeling.plan_windows(bars, 10, 5, 8)
    got = {}
    df = labeling.context_slice(bars, windows, rules)
    for r in df.collect():
        got.setdefault((r["ticker"], r["window"]), []).append((int(r["close"]), r["in_window"]))
    for w in windows.collect():
        a, z = w["first_row"], w["last_row"]
        assert sorted(got[w["ticker"], w["window"]]) == [(k, a <= k <= z) for k in range(max(0, a - 5), min(59, z + 8) + 1)]
    assert "BroadcastNestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()
