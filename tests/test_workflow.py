import datetime as dt

import pytest

from barloom.operators import backtest, dataset, evaluation, models, quality, studies
from barloom.plans import catalog, experiment, workflow
from barloom.plans.contracts import Block, BlockSet, Task, canonical, digest
from barloom.sources import bars as store
from barloom.sources import ingest, sinks, universe
from barloom.streaming import bars as streams

D = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
PRED = "provider string, ticker string, trading_date date, target int, score double, predicted_class int, ranking_return double"


def test_upsert_overwrites_by_key_and_keeps_the_rest(spark):
    row = lambda t, c, at, r: ("p", t, D[0], *[c] * 4, c, 0.0, 0.0, 5, dt.datetime(2024, 1, at), r)
    names = ["provider", "ticker", "trading_date", "open", "high", "low", "close", "adjusted_close", "dividends", "stock_splits", "volume", "fetched_at", "request_id"]
    old = store.upsert(None, spark.createDataFrame([row("A", 1.0, 1, "r1"), row("B", 2.0, 1, "r1")], names))
    new = store.upsert(old, spark.createDataFrame([row("B", 3.0, 2, "r2"), row("B", 4.0, 3, "r3"), row("C", 5.0, 2, "r2")], names))
    assert {(r["ticker"], float(r["close"]), r["request_id"]) for r in new.collect()} == {("A", 1.0, "r1"), ("B", 4.0, "r3"), ("C", 5.0, "r2")}
    with pytest.raises(ValueError):
        store.upsert(old, new.drop("volume"))


def test_a_failing_ticker_does_not_stop_the_others(spark):
    class Half:
        def fetch(self, ticker, start, end):
            if ticker == "B":
                raise OSError("gone")
            return None

    plan = [(t, D[0], D[1]) for t in "ABC"]
    out = ingest.ingest(None, Half(), plan)
    assert (out.tickers, out.failures) == (2, {"B": "OSError: gone"})
    with pytest.raises(OSError):
        ingest.ingest(None, Half(), plan, strict=True)


def test_universe_files(tmp_path):
    universe.write_universe(tmp_path / "u.yml", "u", [{"symbol": s} for s in ("B", "A", "C")])
    (tmp_path / "a.yml").write_text("kind: active_tickers\nuniverses:\n- {universe: u, include: all, exclude: [C]}\n")
    assert universe.active_tickers(tmp_path / "a.yml", {"u": tmp_path / "u.yml"}) == ["A", "B"]
    with pytest.raises(FileExistsError):
        universe.write_universe(tmp_path / "u.yml", "u", [])
    assert universe.requested_tickers([" A ", "", "B", "A"], 1) == ["A"]


def test_gates_name_their_reasons(spark):
    t = quality.Thresholds(inference_rows=5, training_rows=10, turnover_rows=4, turnover=100)
    rows = [("p", "GOOD", D[i], 10.0, 10.0, 100) for i in range(12)] + [("p", "THIN", D[i], 10.0, None if i == 3 else 10.0, 0 if i < 6 else 1) for i in range(8)]
    df = spark.createDataFrame(rows, "provider string, ticker string, trading_date date, close double, adjusted_close double, volume long")
    asked = spark.createDataFrame([("GOOD",), ("THIN",), ("NONE",)], "ticker string")
    ready = {r["ticker"]: r for r in quality.inference_readiness(df, asked, D[14], t=t).collect()}
    assert ready["GOOD"]["ok"] and ready["NONE"]["reasons"] == ["missing"]
    assert ready["THIN"]["reasons"] == ["missing_adjusted_close", "sparse_volume", "insufficient_turnover_observations", "stale"]
    able = {r["ticker"]: r["ok"] for r in quality.training_eligibility(df, asked, D[8], t=t).collect()}
    assert able == {"GOOD": False, "THIN": False, "NONE": False}


def samples(spark, n=40):
    rows = [("p", t, D[i], D[i + 5], i % 3 == 0) for i in range(n) for t in "AB"]
    return spark.createDataFrame(rows, "provider string, ticker string, trading_date date, target_end_date date, y boolean")


def test_split_purges_and_embargoes(spark):
    spec = dataset.SplitSpec((D[0], D[19]), (D[20], D[29]), (D[30], D[50]), embargo=2)
    got = {r["trading_date"]: (r["split"], r["split_exclusion_reason"]) for r in dataset.split(samples(spark), spec).collect()}
    assert got[D[14]] == (None, "embargo") and got[D[13]] == (None, "embargo") and got[D[12]] == ("train", None)
    assert got[D[15]] == (None, "purge") and got[D[25]] == (None, "purge") and got[D[24]] == (None, "embargo")
    assert got[D[39]] == ("test", None)
    with pytest.raises(ValueError):
        dataset.SplitSpec((D[5], D[9]), (D[0], D[1]), (D[2], D[3]))


def test_folds_expand_and_purge(spark):
    rows = dataset.expanding_folds(samples(spark), 2, 8).filter("ticker = 'A'").collect()
    dates = lambda f, role: sorted(r["trading_date"] for r in rows if (r["fold"], r["role"]) == (f, role))
    assert dates(1, "validation") == D[24:27] and dates(2, "validation") == D[32:35]
    assert dates(1, "train") == D[:19] and dates(2, "train") == D[:27]


def predictions(spark, rows):
    return spark.createDataFrame([("p", t, D[d], y, s, int(s >= 0.5), r) for d, t, y, s, r in rows], PRED)


def test_metrics_with_ties_by_hand(spark):
    p = predictions(spark, [(0, "A", 1, 0.9, 0.1), (0, "B", 0, 0.9, 0.0), (0, "C", 1, 0.4, 0.2), (0, "D", 0, 0.1, None)])
    m = evaluation.classification(p).first()
    assert m["roc_auc"] == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    assert m["average_precision"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert (m["precision"], m["recall"], m["prevalence"]) == (0.5, 0.5, 0.5)
    one = evaluation.classification(p.filter("target = 1")).first()
    assert one["roc_auc"] is None and one["log_loss"] is None
    assert evaluation.prediction_violations(p).first().asDict() == {"target_not_binary": 0, "score_out_of_range": 0, "class_disagrees": 0}
    assert evaluation.calibration(p, 10).filter("rows > 0").count() == 3


def test_ndcg_shares_the_discount_of_ties(spark):
    rows = [(0, "A", 1, 0.5, 3.0), (0, "B", 0, 0.5, 0.0), (0, "C", 0, 0.1, 1.0)]
    r = evaluation.ranking_by_date(predictions(spark, rows), "ranking_return", 2).first()
    share = (1 + 1 / 1.584962500721156) / 2
    assert r["ndcg"] == pytest.approx(3 * share / (3 + 1 / 1.584962500721156))


def test_kendall_and_studies(spark):
    p = predictions(spark, [(0, "A", 1, 0.1, 1.0), (0, "B", 0, 0.2, 2.0), (0, "C", 1, 0.3, 3.0), (1, "A", 1, 0.1, 1.0), (1, "B", 1, 0.1, 2.0)])
    got = {r["trading_date"]: r["kendall"] for r in studies.kendall_by_date(p).collect()}
    assert got[D[0]] == 1.0 and got[D[1]] is None
    assert studies.top_bucket(p, 1).count() == 1
    assert studies.permutation_test(p, 1, 20).first()["p_value"] <= 1
    r = studies.bootstrap_spreads(studies.top_bucket(p, 1), resamples=10).first()
    assert r["low"] == r["high"] == pytest.approx(1.0)


def test_logistic_regression_finds_the_penalised_minimum(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (x @ [1.0, -2.0] + rng.normal(size=300) > 0).astype(int)
    rows = [("p", f"t{i}", D[0], float(a), None if i == 7 else float(b), int(v)) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "provider string, ticker string, trading_date date, a double, b double, y int")
    f = models.fit("logistic_regression", df, ["a", "b"], "y", penalty=0.1)
    z = np.array([[0.0 if v is None else v for v in (r["a"], r["b"])] for r in df.select(*[c.alias(n) for n, c in f.preprocessing.columns().items()]).collect()])
    w, b = np.array([f.parameters["weights"][c] for c in ("a", "b")]), f.parameters["intercept"]
    p = 1 / (1 + np.exp(-(z @ w + b)))
    assert np.abs(z.T @ (p - y) / len(y) + 0.1 * w).max() < 1e-4
    assert abs((p - y).mean()) < 1e-4
    with pytest.raises(ValueError):
        models.fit("constant_prior", df, ["a"], "y", seed=1)


def bar(t, d, o, h, lo, c, place=None, atr=None):
    return {"provider": "p", "ticker": t, "trading_date": D[d], "open": o, "high": h, "low": lo, "close": c, "place": place, "atr": atr}


RULES = backtest.Rules(1000.0, 0.01, 1, 2, 0.5, commission_rate=0.0)


@pytest.mark.parametrize(
    ("days", "exit_price", "why"),
    [
        ([(10, 13, 10, 12)], 12.0, "take_profit"),
        ([(10, 10, 8, 9)], 9.0, "stop_loss"),
        ([(10, 13, 8, 9)], 9.0, "stop_loss"),
        ([(10, 11, 9.5, 10), (8, 9, 7, 8)], 8.0, "stop_loss"),
        ([(10, 11, 9.5, 10), (10, 11, 9.5, 10), (10.5, 11, 10, 10)], 10.5, "timeout"),
        ([(10, 11, 9.5, 10.2)], 10.2, "end_of_data"),
    ],
)
def test_backtest_exits(days, exit_price, why):
    rows = [bar("A", 0, 10, 10, 10, 10, 1, 1.0)] + [bar("A", i + 1, *map(float, d)) for i, d in enumerate(days)]
    trades, curve = backtest.replay(rows, RULES)
    assert [(t["exit_price"], t["exit_reason"], t["quantity"]) for t in trades] == [(exit_price, why, 10)]
    assert curve[-1][1] == pytest.approx(1000 + (exit_price - 10) * 10)


def test_backtest_slots_and_runs(spark):
    rows = [bar(t, d, 10.0, 10.5, 9.5, 10.0) for d in range(4) for t in "AB"]
    prices = spark.createDataFrame([{k: r[k] for k in ("provider", "ticker", "trading_date", "open", "high", "low", "close")} for r in rows])
    signals = spark.createDataFrame([("p", t, D[0], s, 1.0) for t, s in (("A", 0.8), ("B", 0.9))], "provider string, ticker string, trading_date date, score double, atr double")
    out = backtest.run_backtest(prices, signals, {"one": RULES, "two": backtest.Rules(1000.0, 0.01, 2, 2, 0.5)})
    assert sorted((r["run"], r["ticker"]) for r in out.collect()) == [("one", "B"), ("two", "A"), ("two", "B")]
    assert backtest.summarize(out, 1000.0).count() == 2
    assert {r["kind"]: r["n"] for r in backtest.violations(prices, signals).collect()} == {"signal_without_bar": 0, "invalid_bar": 0}


def test_contracts_and_digests():
    assert canonical({"b": (1, 2), "a": frozenset({"y", "x"})}) == '{"a":["x","y"],"b":[1,2]}'
    assert digest({"a": 1}) == digest({"a": 1})
    assert catalog.FEATURES.digest() == catalog.FEATURES.select([b.name for b in catalog.FEATURES.blocks]).digest()
    with pytest.raises(ValueError):
        BlockSet("x", "1", (Block("a", None, ("c",), frozenset()), Block("b", None, ("c",), frozenset())))
    with pytest.raises(ValueError):
        Task("y", "text", 5)


def test_experiment_end_to_end(spark, data, tmp_path):
    from barloom.plans.workflow import _FEATURES, _TARGETS, _TASK, SPLIT
    from barloom.sources.bars import bars_week

    spec = experiment.ExperimentSpec(dataset.DatasetSpec(dataset.Universe("tpch", ("B", "A", "A")), D[0], D[1], _FEATURES, _TARGETS, _TASK), SPLIT, "constant_prior")
    assert spec.dataset.universe.tickers == ("A", "B")
    out = experiment.run(spec, bars_week(spark, data))
    assert [r["split"] for r in out.metrics.collect()] == ["validation"]
    m = dataset.manifest(dataset.construct(bars_week(spark, data), _FEATURES, _TARGETS, _TASK), _FEATURES, _TASK)
    assert set(m["target"]) == {"true", "false"} and m["missing"]["return_1d"] == 25
    sinks.write_report(str(tmp_path / "r"), out.metrics.drop("split"), {"calibration": evaluation.calibration(out.predictions)}, out.predictions)
    sinks.RunLog(spark, str(tmp_path / "log")).put("metrics", a=1.0, b=float("nan")).close()
    assert spark.read.text(str(tmp_path / "log/run.json")).first()[0] == '{"metrics":{"a":1.0},"params":{},"tags":{}}'


def test_streamed_bars_and_running_mean(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    batches = [[(1, at(0, 1), 1, "a", 1.0, ""), (2, at(0, 50), 1, "a", 3.0, "")], [(3, at(1, 5), 1, "a", 2.0, ""), (2, at(0, 50), 1, "a", 3.0, "")], [(4, at(6, 0), 1, "a", 9.0, "")], [(5, at(0, 30), 1, "a", 99.0, "")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, streams.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = (
            streams.event_bars(streams.distinct_events(streams.read_events(spark, str(tmp_path / "in"))), late=None)
            .writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        )
        q.awaitTermination()
    got = sorted((r["trading_date"].hour, r["open"], r["close"], r["volume"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 1.0, 3.0, 2), (1, 2.0, 2.0, 1)]


def test_running_ema_keeps_its_state_between_batches(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, h), float(h * h)) for h in range(6)]
    shape = "ticker string, trading_date timestamp, close double"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        bars = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        q = streams.running_ema(bars, 3).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    import pandas as pd

    want = pd.Series([r[2] for r in rows]).ewm(span=3, adjust=False, min_periods=3).mean()
    got = [r["ema"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("trading_date").collect()]
    assert got[:2] == [None, None]
    assert got[2:] == pytest.approx(list(want[2:]))


def test_upserted_batches_keep_the_fullest_bar(spark):
    kept = []
    df = spark.createDataFrame([("p", "a", D[0], 1, 1.0), ("p", "a", D[0], 3, 2.0)], "provider string, ticker string, trading_date date, volume long, close double")
    streams.upsert_batches(lambda d: kept.extend(d.collect()))(df, 0)
    assert [(r["volume"], r["close"]) for r in kept] == [(3, 2.0)]


@pytest.mark.parametrize("name", ["e01_preprocessing", "e02_constant_prior", "e05_logistic_regression", "e17_cross_validation"])
def test_fits_compute_the_bars_once(spark, data, monkeypatch, name):
    seen, plain = spark.sparkContext.accumulator(0), workflow.bars_week

    def counted(spark, d):
        df = plain(spark, d)

        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(count, df.schema)

    monkeypatch.setattr(workflow, "bars_week", counted)
    assert workflow.QUERIES[name](spark, data).count() > 0
    assert seen.value == plain(spark, data).count()
