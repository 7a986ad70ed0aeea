"""The calls that join several steps: datasets, experiments, labelling sessions, onboarding; and fields folded by state, by brute force."""

import datetime as dt
import itertools
import math
import random

import pytest

from barloom.operators import backtest, dataset, evaluation, labeling, models, structure, studies
from barloom.plans import experiment
from barloom.sources import ingest
from barloom.sources.bars import BRONZE, bars_week

D = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(400)]
PRED = "provider string, ticker string, trading_date date, target int, score double, predicted_class int, ranking_return double"


def _bars(spark, tickers="AB", n=60, seed=3):
    rng, rows = random.Random(seed), []
    for t in tickers:
        p = 100.0
        for i in range(n):
            o = p
            p = max(5.0, p * (1 + rng.uniform(-0.06, 0.06)))
            rows.append(("p", t, D[i], o, max(o, p) * 1.01, min(o, p) * 0.99, p, p, 1000))
    return spark.createDataFrame(rows, "provider string, ticker string, trading_date date, open double, high double, low double, close double, adjusted_close double, volume long")


def _spec(spark, data, model="constant_prior"):
    from barloom.plans.workflow import _FEATURES, _TARGETS, _TASK, SPLIT

    tickers = tuple(r[0] for r in bars_week(spark, data).select("ticker").distinct().collect())
    return experiment.ExperimentSpec(dataset.DatasetSpec(dataset.Universe("tpch", tickers), dt.date(1992, 1, 1), dt.date(2030, 1, 1), _FEATURES, _TARGETS, _TASK), SPLIT, model)


def test_one_call_experiment_writes_its_artifacts(spark, data, tmp_path):
    spec, root = _spec(spark, data), str(tmp_path)
    with pytest.raises(ValueError, match="digest"):
        experiment.run_experiment(spec, bars_week(spark, data), root, expected_digest="no")
    out = experiment.run_experiment(spec, bars_week(spark, data), root, ranking_return=None, expected_digest=spec.digest())
    assert {r["split"] for r in out.predictions.select("split").distinct().collect()} == {"validation"}
    assert '"validation_brier"' in spark.read.text(f"{root}/run.json").first()[0]
    assert spark.read.option("header", True).csv(f"{root}/validation/calibration").count() == 10
    assert spark.read.option("header", True).csv(f"{root}/splits").count() == 3
    assert '"prior"' in spark.read.text(f"{root}/model.json").first()[0]


def test_build_dataset_refuses_what_is_outside(spark, data):
    from barloom.plans.workflow import _FEATURES, _TARGETS, _TASK

    spec = _spec(spark, data).dataset
    bundle = experiment.build_dataset(bars_week(spark, data), spec)
    bad = dataset.DatasetSpec(dataset.Universe("tpch", (*spec.universe.tickers, "NONE")), spec.start_date, spec.end_date, _FEATURES, _TARGETS, _TASK)
    with pytest.raises(ValueError, match="missing_ticker"):
        experiment.build_dataset(bars_week(spark, data), bad)
    kinds = {r["kind"] for r in dataset.scope_violations(bars_week(spark, data), dataset.Universe("other", ("x",)), dt.date(2030, 1, 1), dt.date(2031, 1, 1)).collect()}
    assert kinds == {"provider", "unexpected_ticker", "missing_ticker", "date"}
    with pytest.raises(ValueError, match="repeated_key"):
        dataset.check_bundle(bundle.unionByName(bundle), _FEATURES, _TARGETS, _TASK)
    with pytest.raises(ValueError, match="ends_after_data"):
        dataset.check_bundle(bundle, _FEATURES, _TARGETS, _TASK, dt.date(1995, 1, 1))
    x = dataset.tabular(bundle, _FEATURES.outputs, "up").first()
    assert len(x["x"]) == 2 and x["y"] in (0.0, 1.0)
    with pytest.raises(ValueError):
        dataset.tabular(bundle, ["no"], "up")


def test_inconsistent_predictions_are_refused(spark):
    good = ("p", "A", D[0], 1, 0.7, 1, 0.1)
    for bad in (("p", "B", D[0], 2, 0.7, 1, 0.1), ("p", "B", D[0], 1, 1.7, 1, 0.1), ("p", "B", D[0], 1, 0.7, 0, 0.1), good):
        with pytest.raises(ValueError, match="not valid"):
            evaluation.checked(spark.createDataFrame([good, bad], PRED))
    assert evaluation.checked(spark.createDataFrame([good], PRED)).count() == 1
    assert evaluation.evaluate(spark.createDataFrame([good, ("p", "B", D[0], 0, 0.2, 0, -0.1)], PRED), 1)["by_date"].count() == 1


def test_classification_in_ranges_equals_one_group(spark):
    rng = random.Random(5)
    rows = [("p", f"t{i}", D[0], rng.randint(0, 1), s := round(rng.random() ** 3, 3), int(s >= 0.5), 0.0) for i in range(3000)]
    p = spark.createDataFrame(rows, PRED)
    whole, by = evaluation.classification(p).first(), evaluation.classification(p, ("provider",)).first()
    for c in ("rows", "average_precision", "pr_auc", "roc_auc", "log_loss", "precision", "recall"):
        assert whole[c] == pytest.approx(by[c], rel=1e-12)
    pos, neg = [r[4] for r in rows if r[3]], [r[4] for r in rows if not r[3]]
    auc = sum((a > b) + (a == b) / 2 for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert whole["roc_auc"] == pytest.approx(auc)
    plan = evaluation.classification(p)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # of the final sums
    assert evaluation.classification(p.limit(0)).first()["rows"] in (None, 0)


@pytest.mark.parametrize("seed", range(5))
def test_kendall_counts_inversions(spark, seed):
    rng = random.Random(seed)
    rows = [("p", f"t{i}", D[d], 0, float(rng.randint(0, 12)), 0, float(rng.randint(0, 9))) for d in range(3) for i in range(40)] + [("p", "z", D[9], 0, 1.0, 0, 1.0)]
    got = {r["trading_date"]: r["kendall"] for r in studies.kendall_by_date(spark.createDataFrame(rows, PRED)).collect()}
    assert set(got) == set(D[:3])
    for day, tau in got.items():
        own = [(r[4], r[6]) for r in rows if r[2] == day]
        sign = lambda a, b: (a > b) - (a < b)
        pairs = [(sign(a[0], b[0]), sign(a[1], b[1])) for a, b in itertools.combinations(own, 2)]
        assert tau == pytest.approx(sum(x * y for x, y in pairs) / math.sqrt(sum(x * x for x, _ in pairs) * sum(y * y for _, y in pairs)))
    assert studies.inversions([3, 1, 2, 0]) == 5 and studies.inversions([]) == 0
    daily = studies.daily_ic(spark.createDataFrame(rows, PRED))
    assert set(daily.columns) == {"provider", "trading_date", "spearman", "kendall"}


def test_tails_trials_and_ranking_summaries(spark):
    rows = [("p", t, D[0], 1, s, 1, s / 10) for t, s in (("A", 0.9), ("B", 0.8), ("C", 0.1))]
    p = spark.createDataFrame(rows, PRED).withColumn("pct", evaluation.F.col("score"))
    daily = studies.tail_by_date(p, "pct", 2).collect()
    assert (daily[0]["mean_percentile"], daily[0]["top_fifth_share"]) == (pytest.approx(0.85), 1.0)
    assert studies.tail_summary(studies.tail_by_date(p, "pct", 2)).first()["dates"] == 1
    trials = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 4.0), ("c", 2.0, 3.0)], "trial string, m double, n double")
    assert {r["trial"]: r["mean_rank"] for r in studies.rank_trials(trials, ("m", "n")).collect()} == {"a": 2.0, "b": 1.5, "c": 2.0}
    assert evaluation.ranking_summary(evaluation.ranking_by_date(p, "score", 2)).first()["mean_ndcg"] == pytest.approx(1.0)
    fitted = models.fit("random_ranker", p, [], "target", seed=3)
    first, again = ([r["score"] for r in fitted.score(p.drop("score")).orderBy("ticker").collect()] for _ in range(2))
    assert first == again and all(0 < s < 1 for s in first) and len(set(first)) == 3


def test_feature_pruning():
    kept, dropped, added = studies.prune_features(("a", "b", "c", "d"), {"a": 0.5, "b": 0.1, "c": 0.4}, ("a", "b", "c", "d", "e"), 1, protected=("d",), least=2, drop_share=0.25, add=1)
    assert dropped == ("b",) and len(added) == 1 and set(added) <= {"b", "e"} and set(kept) == {"a", "c", "d", *added}
    assert studies.prune_features(("a", "b"), {}, ("a", "b"), 1, least=2) == (("a", "b"), (), ())


def test_labelling_sessions_refuse_what_does_not_fit(spark):
    now, rules = dt.datetime(2024, 5, 1), labeling.LabelingRules(window_size=3, step_size=3, forward_horizon=1)
    session = labeling.create_session("p", [" A ", "B", "A"], rules, now)
    assert session.tickers == ("A", "B") and session.ticker == "A"
    window = spark.createDataFrame([(d,) for d in D[:3]], "trading_date date")
    save = lambda labels, s, **k: labeling.save_window(labels, s, k.pop("rules", rules), window, k.pop("at", s.window_position), k.pop("dates", [D[1]]), now, **k)
    for bad in ({"at": 4}, {"dates": [D[7]]}, {"rules": labeling.LabelingRules(window_size=4, step_size=3)}, {"next_ticker": 9}, {"next_window": -1}):
        with pytest.raises(ValueError):
            save(None, session, **bad)
    labels, moved = save(None, session, next_window=1, rules=labeling.LabelingRules(window_size=3, step_size=3, forward_horizon=1, reward_risk_ratio=3.0))
    assert moved.window_position == 1 and moved.rules.reward_risk_ratio == 3.0
    assert {r["trading_date"]: r["label"] for r in labeling.load_labels(labels, session.session_id, "p", "A", D[0], D[1]).collect()} == {D[0]: 0, D[1]: 1}
    again, done = save(labels, moved, dates=[D[0]], completed=True)
    assert sorted((r["trading_date"], r["label"]) for r in again.collect()) == [(D[0], 1), (D[1], 0), (D[2], 0)]
    with pytest.raises(ValueError):
        save(again, done)
    with pytest.raises(ValueError):
        done.ticker  # noqa: B018
    with pytest.raises(ValueError):
        labeling.create_session("p", [" "], rules, now)
    sessions = spark.createDataFrame([("a", "p", now, now), ("b", "p", now, now), ("c", "q", now, dt.datetime(2025, 1, 1))], "session_id string, provider string, created_at timestamp, updated_at timestamp")
    assert labeling.latest_session(sessions, provider="p").first()["session_id"] == "b"


def test_labelling_universe_skips_short_histories(spark):
    rules = labeling.LabelingRules(window_size=20, step_size=10, forward_horizon=5, pivot_high_left=2, pivot_high_right=2, pivot_low_left=2, pivot_low_right=2)
    bars = _bars(spark, "A").unionByName(_bars(spark, "B", 10))
    frames, windows, skipped = labeling.prepare_universe(bars, "p", ["A", "B", "C"], D[300], rules)
    assert {r["ticker"]: r["reason"].split(" ")[0] for r in skipped.collect()} == {"B": "insufficient", "C": "no"}
    assert {"ema_10", "ema_20", "ema_50", "atr", "pivot_high", "pivot_low"} <= set(frames.columns) and frames.select("ticker").distinct().count() == 1
    n = frames.count()
    slices = labeling.context_slice(frames, windows, rules).groupBy("window").agg(evaluation.F.count(evaluation.F.lit(1)).alias("n"), evaluation.F.count_if("in_window").alias("w")).collect()
    for r, w in zip(sorted(slices), sorted(windows.collect(), key=lambda x: x["window"]), strict=True):
        assert r["w"] == 20 and r["n"] == min(n, w["last_row"] + 11) - max(0, w["first_row"] - 10)
    dates = sorted(r["trading_date"] for r in frames.collect())
    for r in labeling.viewport(frames, windows.filter("window = 0"), 60).collect():
        assert r["first_date"] == _business(dates[0], 9 - 30) and r["last_date"] == dates[9 + 30]


def _business(day, n):
    import pandas as pd

    return (pd.Timestamp(day) + pd.tseries.offsets.BDay(n)).date()


def test_business_days_equal_pandas(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(D[i], n) for i in range(10) for n in range(-13, 14) if n], "d date, n int")
    for r in df.select("d", "n", labeling._business_days("d", F.col("n")).alias("x")).collect():
        assert r["x"] == _business(r["d"], r["n"]), r


def test_onboarding_fetches_what_is_missing(spark):
    row = lambda t: ("p", t, D[0], *[1] * 5, 0, 0, 5, dt.datetime(2024, 1, 1), "r")

    class One:
        def fetch(self, ticker, start, end):
            if ticker == "C":
                raise OSError("gone")
            names = ["provider", "ticker", "trading_date", "open", "high", "low", "close", "adjusted_close", "dividends", "stock_splits", "volume", "fetched_at", "request_id"]
            return spark.createDataFrame([row(ticker)], names)

    active = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    first = ingest.onboard(None, One(), active.filter("ticker = 'A'"), D[0], D[9])
    out = ingest.onboard(first.ingested.table, One(), active, D[0], D[9])
    assert {r["ticker"]: r["status"] for r in out.before.collect()} == {"A": "onboarded", "B": "missing", "C": "missing"}
    assert {r["ticker"]: r["status"] for r in out.after.collect()} == {"A": "onboarded", "B": "onboarded", "C": "missing"}
    assert set(out.ingested.failures) == {"C"} and BRONZE.fieldNames()[0] == "provider"
    assert ingest.onboard(None, One(), active, D[0], D[9], backfill=False).after.filter("status = 'missing'").count() == 3


def test_equity_curve_adds_up(spark):
    bars = _bars(spark)
    signals = spark.createDataFrame([("p", t, D[i], 0.9, 3.0) for i in range(0, 50, 5) for t in "AB"], "provider string, ticker string, trading_date date, score double, atr double")
    rules = {"x": backtest.Rules(10_000.0, 0.02, 2, 4)}
    trades, curve = backtest.run_backtest(bars, signals, rules), backtest.equity_curves(bars, signals, rules)
    rows = sorted((r["trading_date"], r["equity"]) for r in curve.collect())
    assert len(rows) == 60 and rows[-1][1] == pytest.approx(10_000 + sum(r["pnl"] for r in trades.collect()))
    assert trades.count() > 3


def _zigzag(high, low, legs, deviation, upto):
    """Pivots known at the end of row ``upto``, from candidates that ``legs`` rows after them confirm."""
    pivots = []
    for i in range(upto + 1):
        at = i - legs
        if at < legs:
            continue
        before, after = slice(at - legs, at), slice(at + 1, at + legs + 1)
        h, lo = high[at], low[at]
        done = False
        for price, side, ok in ((h, 1, h > max(high[before]) and h >= max(high[after])), (lo, -1, lo < min(low[before]) and lo <= min(low[after]))):
            if done or not ok:
                continue
            if not pivots:
                pivots.append([at, price, side])
                done = True
            elif pivots[-1][2] == side:
                if (price > pivots[-1][1]) if side == 1 else (price < pivots[-1][1]):
                    pivots[-1] = [at, price, side]
                    done = True
            elif abs(price / pivots[-1][1] - 1) >= deviation:
                pivots.append([at, price, side])
                done = True
    return pivots


def test_zigzag_equals_brute_force(spark):
    bars = _bars(spark, "AB", 120, 9)
    got = structure.add_zigzag(bars, 5.0, 6).collect()
    for t in "AB":
        own = sorted((r for r in got if r["ticker"] == t), key=lambda r: r["trading_date"])
        high, low = [r["high"] for r in own], [r["low"] for r in own]
        pivots = _zigzag(high, low, 3, 0.05, len(own) - 1)
        assert len(pivots) > 5
        assert [(i, r["zigzag_price"], r["zigzag_direction"]) for i, r in enumerate(own) if r["zigzag_price"] is not None] == [(a, p, d) for a, p, d in pivots]
        for before, after in itertools.pairwise(pivots):
            r = own[after[0]]
            assert r["zigzag_bars"] == after[0] - before[0] and r["zigzag_return"] == pytest.approx(after[1] / before[1] - 1)


def _tau(values):
    signs = [(b > a) - (b < a) for a, b in itertools.combinations(values, 2)]
    untied = sum(s != 0 for s in signs)
    return sum(signs) / math.sqrt(len(signs) * untied) if untied else None


def _middle(values):
    values = sorted(values)
    n = len(values)
    return (values[(n - 1) // 2] + values[n // 2]) / 2


def test_zigzag_state_and_features_equal_brute_force(spark):
    bars = _bars(spark, "AB", 150, 12)
    state = {(r["ticker"], r["trading_date"]): r for r in structure.add_zigzag_state(bars, 5.0, 6).collect()}
    feats = {(r["ticker"], r["trading_date"]): r for r in structure.add_zigzag_features(bars, 5.0, 6).collect()}
    same = lambda got, want: got is None if want is None else got == pytest.approx(want)
    seen = 0
    for t in "AB":
        own = sorted((r for k, r in state.items() if k[0] == t), key=lambda r: r["trading_date"])
        high, low, close = ([r[c] for r in own] for c in ("high", "low", "close"))
        for i, r in enumerate(own):
            p = _zigzag(high, low, 3, 0.05, i)
            f = feats[t, r["trading_date"]]
            if not p:
                assert r["__z_last_price"] is None and f["zigzag_last_direction"] is None
                continue
            at, price, side = p[-1]
            assert (r["__z_last_position"], r["__z_last_price"], r["__z_last_direction"]) == (at, price, side)
            assert (f["zigzag_last_direction"], f["zigzag_bars_since_pivot"]) == (side, i - at)
            if len(p) > 1:
                move, n = price / p[-2][1] - 1, at - p[-2][0]
                assert f["zigzag_last_swing_return"] == pytest.approx(move) and f["zigzag_last_swing_bars"] == n
                assert same(f["zigzag_swing_return_per_bar"], (1 + move) ** (1 / n) - 1)
                assert same(f["zigzag_retracement"], -(close[i] - price) / (price - p[-2][1]))
            for name, way in (("high", 1), ("low", -1)):
                prices = [x for x in p if x[2] == way]
                assert same(r[f"__z_last_{name}_price"], prices[-1][1] if prices else None)
                if len(prices) > 1:
                    assert same(f[f"market_structure_{name}_change"], math.log(prices[-1][1] / prices[-2][1]))
                    assert same(f[f"market_structure_{name}_rate"], math.log(prices[-1][1] / prices[-2][1]) / (prices[-1][0] - prices[-2][0]))
                if len(prices) >= 4:
                    assert same(f[f"market_structure_{name}_consistency"], _tau([x[1] for x in prices[-4:]]))
            if len(p) >= 7:
                legs = [math.log(b[1] / a[1]) for a, b in itertools.pairwise(p[-7:])]
                up, down = _middle([x for x in legs if x > 0]), _middle([-x for x in legs if x < 0])
                assert same(f["market_structure_leg_balance"], (up - down) / (up + down))
                assert same(f["market_structure_efficiency"], sum(legs) / sum(map(abs, legs)))
                seen += 1
    assert seen > 20


def test_trimmed_backtest_equals_the_replay_of_all_bars(spark):
    bars = _bars(spark, "ABCD", 90, 21)
    rng = random.Random(2)
    signals = spark.createDataFrame([("p", t, D[i], rng.random(), 4.0) for i in range(85) for t in "ABCD" if rng.random() < 0.2], "provider string, ticker string, trading_date date, score double, atr double")
    rules = {"a": backtest.Rules(10_000.0, 0.02, 2, 3), "b": backtest.Rules(5_000.0, 0.05, 3, 8, 0.7, 0.5)}
    got = backtest.run_backtest(bars, signals, rules).collect()
    for name, rule in rules.items():
        placed = {(r["ticker"], r["trading_date"]): r for r in backtest.ranked_candidates(signals, rule.minimum_score).collect()}
        rows = [{**r.asDict(), "place": placed[k]["place"] if (k := (r["ticker"], r["trading_date"])) in placed else None, "atr": 4.0} for r in bars.collect()]
        want, _ = backtest.replay(sorted(rows, key=lambda r: (r["trading_date"], r["ticker"])), rule)
        key = lambda t: (t["ticker"], t["entry_date"], t["exit_date"], t["exit_reason"], t["quantity"], round(t["pnl"], 6))
        assert sorted(key(t) for t in want) == sorted(key(t) for t in got if t["run"] == name) and len(want) > 5
