"""The boosted ranker against a plain-Python build, and what it must be able to do."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import boosting as bo

UNIT = 2**24
ROWS = "fold int, train boolean, provider string, ticker string, trading_date date, rel double, a double, b double, c double"


def some_rows(n_days=20, n_tickers=25, folds=(1,), seed=5, noise=0.3):
    rng = random.Random(seed)
    out = []
    for f in folds:
        for d in range(n_days):
            day = dt.date(2024, 1, 1) + dt.timedelta(days=d)
            for t in range(n_tickers):
                a, b = round(rng.gauss(0, 1), 2), rng.choice([None, 0.0, 1.0, 2.0, float("nan")])
                c = round(rng.random(), 1)
                worth = a * (1 if (b is None or b != b or b > 0.5) else -1) + rng.gauss(0, noise)
                rel = sum(worth > x for x in (0, 0.7, 1.4, 2.0))
                out.append((f, d < n_days * 3 // 4, "p", f"T{t:02d}", day, float(rel), a, b, c))
    return out


def plain_gradients(scores, rel, pairs, normalize):
    n = len(scores)
    g, h = [0.0] * n, [0.0] * n
    disc = [1 / math.log2(k + 2) for k in range(n)]
    ideal = sum((2**r - 1) * disc[k] for k, r in enumerate(sorted(rel, reverse=True)))
    order = sorted(range(n), key=lambda i: -scores[i])
    total = 0.0
    if ideal <= 0:
        return [0] * n, [0] * n
    for x in range(min(pairs, n - 1)):
        for y in range(x + 1, n):
            i, j = order[x], order[y]
            if rel[i] == rel[j]:
                continue
            delta = abs(2 ** rel[i] - 2 ** rel[j]) * (disc[x] - disc[y]) / ideal
            good, bad = (i, j) if rel[i] > rel[j] else (j, i)
            p = 1 / (1 + math.exp(scores[good] - scores[bad]))
            g[good] -= p * delta
            g[bad] += p * delta
            for k in (i, j):
                h[k] += 2 * max(p * (1 - p), 1e-16) * delta
            total += 2 * p * delta
    by = math.log2(1 + total) / total if normalize and total else 1.0
    return [round(x * by * UNIT) for x in g], [round(x * by * UNIT) for x in h]


def plain_fit(rows, edges, p):
    """Trees as {node: (feature, cut, missing_left)} and {leaf: weight}, by sorting rows into nodes one at a time."""
    rows = [r for r in rows if r[1]]
    days = sorted({r[4] for r in rows})
    per_day = [sorted((r for r in rows if r[4] == d), key=lambda r: r[3]) for d in days]
    flat = [r for day in per_day for r in day]
    bins = [[0 if v is None or v != v else 1 + sum(e < v for e in edges[k]) for k, v in enumerate(r[6:])] for r in flat]
    scores, trees = [0.0] * len(flat), []
    weight = lambda g, h: -math.copysign(max(abs(g) - p.alpha, 0), g) / (h + p.lam)
    part = lambda g, h: max(abs(g) - p.alpha, 0) ** 2 / (h + p.lam)
    for _ in range(p.trees):
        g, h, at = [], [], 0
        for day in per_day:
            one = plain_gradients(scores[at : at + len(day)], [r[5] for r in day], p.pairs, p.normalize)
            g, h, at = g + one[0], h + one[1], at + len(day)
        node, splits, leaves = [0 if h[i] else None for i in range(len(flat))], {}, {}
        for level in range(p.depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = [i for i in range(len(flat)) if node[i] == k]
                if not own:
                    continue
                gs, hs = sum(g[i] for i in own) / UNIT, sum(h[i] for i in own) / UNIT
                leaves.setdefault(k, weight(gs, hs))
                best = None
                for f in range(3):
                    for cut in sorted({bins[i][f] for i in own} - {0}):
                        for missing_left in (False, True):
                            left = [i for i in own if (missing_left if bins[i][f] == 0 else bins[i][f] <= cut)]
                            if not 0 < len(left) < len(own):
                                continue
                            gl, hl = sum(g[i] for i in left) / UNIT, sum(h[i] for i in left) / UNIT
                            gr, hr = gs - gl, hs - hl
                            gain = (part(gl, hl) + part(gr, hr) - part(gs, hs)) / 2 - p.gamma
                            key = (round(gain, 10), -f, -cut, missing_left)
                            if gain > 0 and hl >= p.min_child_weight and hr >= p.min_child_weight and (best is None or key > best[0]):
                                best = (key, f, cut, missing_left, weight(gl, hl), weight(gr, hr))
                if best:
                    splits[k] = best[1:4]
                    leaves[2 * k + 1], leaves[2 * k + 2] = best[4:]
                    for i in own:
                        f, cut, m = best[1:4]
                        node[i] = 2 * k + (1 if (m if bins[i][f] == 0 else bins[i][f] <= cut) else 2)
        trees.append((splits, leaves))
        for i in range(len(flat)):
            k = 0
            while k in splits:
                f, cut, m = splits[k]
                k = 2 * k + (1 if (m if bins[i][f] == 0 else bins[i][f] <= cut) else 2)
            scores[i] += p.learning_rate * leaves.get(k, 0.0)
    return trees


@pytest.mark.parametrize("p", [bo.RankerParams(trees=3, depth=3, lam=1.0, min_child_weight=0.5), bo.RankerParams(trees=2, depth=2, lam=3.0, alpha=0.2, gamma=0.05, min_child_weight=0.1, normalize=False, pairs=4)])
def test_trees_equal_a_plain_build(spark, p):
    rows = some_rows()
    assert len(rows) == 500
    boosters, scored = bo.fit_runs(spark.createDataFrame(rows, ROWS).repartition(5), ["a", "b", "c"], "rel", [p], bins=16)
    b = boosters[0, 1]
    want = plain_fit(rows, b.edges, p)
    for tree, (splits, leaves) in zip(b.trees, want, strict=True):
        assert {k: (f, tree.cut[k], tree.missing_left[k]) for k, f in enumerate(tree.feature) if f >= 0} == splits
        for k, v in leaves.items():
            assert tree.value[k] == pytest.approx(p.learning_rate * v, abs=1e-9)
    # the score of the model's expression is the score that the fit has kept, on rows it has trained on and on others
    again = {(r["ticker"], r["trading_date"]): r["score"] for r in b.score(spark.createDataFrame(rows, ROWS)).collect()}
    kept = scored.collect()
    assert len(kept) == 500 and sum(not r["train"] for r in kept) == 125
    assert all(r["score"] == pytest.approx(again[r["ticker"], r["trading_date"]], abs=1e-9) for r in kept)
    assert sum(b.importance().values()) == pytest.approx(1.0)


def test_runs_do_not_mix_and_a_fit_can_be_repeated(spark):
    rows = some_rows(folds=(1, 2))
    rows = [r if r[0] == 1 else (*r[:5], 4.0 - r[5], *r[6:]) for r in rows]  # fold 2 learns the opposite
    params = [bo.RankerParams(trees=4, depth=2), bo.RankerParams(trees=2, depth=3, subsample=0.7, colsample=0.67, seed=3)]
    boosters, _ = bo.fit_runs(spark.createDataFrame(rows, ROWS), ["a", "b", "c"], "rel", params, bins=16)
    assert sorted(boosters) == [(0, 1), (0, 2), (1, 1), (1, 2)] and [len(boosters[k].trees) for k in sorted(boosters)] == [4, 4, 2, 2]
    alone, _ = bo.fit_runs(spark.createDataFrame([r for r in rows if r[0] == 2], ROWS).repartition(7), ["a", "b", "c"], "rel", params[1:], bins=16)
    assert bo.describe(alone[0, 2]) == bo.describe(boosters[1, 2])
    for t, tree in enumerate(boosters[1, 1].trees):
        assert set(tree.feature) - {-1} <= set(bo.drawn_features(params[1], t, 3))


def test_it_ranks_better_than_chance_and_reports_by_fold(spark):
    rows = some_rows(n_days=40)
    df = spark.createDataFrame(rows, ROWS)
    keys = ["provider", "ticker", "trading_date"]
    roles = df.select("fold", F.when(F.col("train"), "train").otherwise("validation").alias("role"), *keys)
    boosters, scored = bo.tune(df.select(*keys, "rel", "a", "b", "c"), roles, ["a", "b", "c"], "rel", [bo.RankerParams(trees=1, depth=1), bo.RankerParams(trees=15, depth=3)])
    outcomes = df.select(*keys, (F.col("rel") / 4).alias("pct"), (F.col("rel") - 1).alias("ret"))
    report = bo.tail_by_fold(scored, outcomes, "pct", "ret", k=5).cache()
    by = {(r["trial"], r["role"]): r for r in report.collect()}
    chance = bo.tail_by_fold(scored.withColumn("score", F.lit(0.0)), outcomes, "pct", "ret", k=5).filter("trial = 1 AND role = 'validation'").first()
    assert by[1, "validation"]["dates"] == 10 and by[1, "validation"]["ndcg"] > chance["ndcg"] + 0.2
    got = {r["trial"]: r for r in bo.trial_summary(report).collect()}
    assert got[1]["selection_rank"] == 1.0 and got[0]["selection_rank"] == 2.0
    assert got[1]["percentile_gap"] == pytest.approx(by[1, "train"]["top_k_percentile"] - by[1, "validation"]["top_k_percentile"])
    weights = bo.mean_importance(boosters)[1]
    assert weights["a"] > weights["c"] and sum(weights.values()) == pytest.approx(1.0)


def test_refusals_and_edges(spark):
    with pytest.raises(ValueError):
        bo.RankerParams(depth=0)
    df = spark.createDataFrame(some_rows(4, 5), ROWS)
    with pytest.raises(ValueError):
        bo.fit_ranker(df.drop("a"), ["a"], "rel")
    with pytest.raises(ValueError):
        bo.fit_ranker(df.limit(0), ["a"], "rel")
    flat = bo.fit_ranker(df.withColumn("rel", F.lit(1.0)), ["a", "b"], "rel", bo.RankerParams(trees=1))  # no pair differs
    assert {r["score"] for r in flat.score(df).collect()} == {0.0}
    one = bo.fit_ranker(df.withColumn("b", F.lit(None).cast("double")), ["a", "b"], "rel", bo.RankerParams(trees=2, depth=2, min_child_weight=0.01))
    assert set(f for t in one.trees for f in t.feature) <= {-1, 0}
    drawn = bo.random_params(3, 20)
    assert len(set(drawn)) == 20 and all(3 <= p.depth <= 8 and 0.02 <= p.learning_rate <= 0.12 for p in drawn)


def test_the_query_beats_random_scores_on_every_fold(spark, data):
    from barloom.operators import dataset
    from barloom.plans import workflow

    got = {(r["trial"], r["fold"], r["role"]): r["ndcg"] for r in workflow.QUERIES["n04_boosted_ranker"](spark, data).collect()}
    assert set(got) == {(t, f, r) for t in (0, 1) for f in (1, 2, 3) for r in ("train", "validation")}
    samples = workflow.ranking_samples(spark, data).cache()
    roles = dataset.expanding_folds(samples, 3, 20).filter("role = 'validation'")
    at_random = samples.join(roles, ["provider", "ticker", "trading_date"]).select(F.lit(0).alias("trial"), "fold", F.lit(False).alias("train"), "provider", "trading_date", "ticker", "relevance", F.lit(0.0).alias("score"))
    for r in bo.tail_by_fold(at_random, samples, "percentile", "relative_return").collect():  # ties are broken at random
        assert all(got[t, r["fold"], "validation"] > r["ndcg"] for t in (0, 1))
