"""Learning to rank with boosted trees, fitted by Spark for many folds and parameter sets side by side.

A query is a date of a provider: its rows are packed once into one row (a date has a row an instrument, so its size is
the universe's), features as bins of a byte. After that nothing is shuffled by row any more: a round computes gradients
in a narrow pass over the packed queries, and each level of a tree is one more pass that sums gradients by (run, node, feature,
bin) within each task; only those sums, whose number the parameters bound, are shuffled, added up and searched for the
best split, in Spark; the driver gets one row a node. A run is a fold with a parameter set: all runs grow their trees
in the same passes, so the number of jobs is trees x (depth + 1), however many folds and trials there are.

Gradients are whole multiples of 2^-24, so sums do not depend on the order in which tasks finish and a fit can be repeated.

Objective: pairs of the ``pairs`` best rows by current score with all rows below them, weighted by how much swapping the two
would change NDCG. Missing values (null, NaN, infinite) have a bin of their own and go to the side that gains more.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import ORDER, check_has, finite
from barloom.functions.stored import stored
from barloom.operators.evaluation import random_score

UNIT = float(1 << 24)
_PACKED = "fold int, provider string, day string, n int, ticker array<string>, train binary, relevance binary, bins binary"
_STATE = "run int, " + _PACKED + ", score binary, g binary, h binary"


@dataclass(frozen=True)
class RankerParams:
    """Of one parameter set. ``bins`` is the same for all sets of a fit."""

    trees: int = 100
    depth: int = 4
    learning_rate: float = 0.1
    min_child_weight: float = 1.0
    subsample: float = 1.0
    colsample: float = 1.0
    gamma: float = 0.0
    alpha: float = 0.0
    lam: float = 1.0
    pairs: int = 10
    normalize: bool = True
    seed: int = 0

    def __post_init__(self):
        if self.trees < 1 or not 1 <= self.depth <= 12 or self.pairs < 1:
            raise ValueError("trees, depth (at most 12) and pairs must be positive")
        if not (0 < self.subsample <= 1 and 0 < self.colsample <= 1 and self.learning_rate > 0):
            raise ValueError("subsample and colsample must be in (0, 1], learning_rate positive")
        if min(self.min_child_weight, self.gamma, self.alpha, self.lam) < 0:
            raise ValueError("penalties must not be negative")


@dataclass
class Tree:
    """A node's children are 2k + 1 and 2k + 2; feature -1 is a leaf. A row goes left if its bin is at most ``cut``."""

    feature: list[int]
    cut: list[int]
    missing_left: list[bool]
    value: list[float]
    gain: list[float]

    @classmethod
    def of_depth(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls([-1] * n, [0] * n, [False] * n, [0.0] * n, [0.0] * n)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        feature, cut, left_if = np.array(self.feature), np.array(self.cut), np.array(self.missing_left)
        while True:
            f = feature[at]
            on = np.flatnonzero(f >= 0)
            if not len(on):
                return at
            b = bins[on, f[on]]
            left = np.where(b == 0, left_if[at[on]], b <= cut[at[on]])
            at[on] = 2 * at[on] + np.where(left, 1, 2)

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Booster:
    """What one run learned: trees over the features' cut points. ``score`` adds a column score to any bars with the features."""

    features: tuple[str, ...]
    edges: list[list[float]]
    trees: list[Tree] = field(default_factory=list)
    params: RankerParams = field(default_factory=RankerParams)

    def _tree(self, t: Tree, at: int) -> Column:
        f = t.feature[at]
        if f < 0:
            return F.lit(t.value[at])
        x = finite(F.col(self.features[f]))
        below = F.lit(True) if t.cut[at] > len(self.edges[f]) else x <= self.edges[f][t.cut[at] - 1]
        left = F.when(x.isNull(), F.lit(t.missing_left[at])).otherwise(below)
        return F.when(left, self._tree(t, 2 * at + 1)).otherwise(self._tree(t, 2 * at + 2))

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        check_has(df, self.features)
        return df.withColumn(name, reduce(lambda a, b: a + b, [self._tree(t, 0) for t in self.trees], F.lit(0.0)))

    def importance(self) -> dict[str, float]:
        """Each feature's share of the gain of all splits."""
        total = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for f, gain in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[self.features[f]] += gain
        every = sum(total.values())
        return {f: v / every if every else 0.0 for f, v in total.items()}


def cut_points(rows: DataFrame, features, bins: int) -> dict[int, list[list[float]]]:
    """fold -> for each feature at most bins - 1 cut points: quantiles of the fold's training rows. One aggregate."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.filter("train").groupBy("fold").agg(*[F.percentile_approx(finite(F.col(f)), shares, 10_000).alias(f"f{k}") for k, f in enumerate(features)])
    return {r["fold"]: [sorted(set(r[f"f{k}"] or [])) for k in range(len(features))] for r in found.collect()}  # folds x features x bins


def packed(rows: DataFrame, features, relevance: str, edges: dict[int, list[list[float]]]) -> DataFrame:
    """rows (fold, train, keys, features, relevance) -> a row a query. Instruments are in the order of their names."""
    cuts = {fold: [np.array(e) for e in es] for fold, es in edges.items()}

    def run(key, t):
        fold = key[0].as_py()
        t = t.sort_by("ticker")
        bins = np.zeros((t.num_rows, len(features)), np.uint8)
        for k in range(len(features)):
            x = t.column(f"f{k}").to_numpy().astype(np.float64)
            here = np.isfinite(x)
            # bin b holds what is above cut b - 1 and at most cut b
            bins[here, k] = 1 + np.searchsorted(cuts[fold][k], x[here], side="left")
        train = t.column("train").to_numpy().astype(np.uint8)
        rel = t.column("relevance").to_numpy().astype(np.float64)
        return pa.table(
            {
                "fold": pa.array([fold], pa.int32()), "provider": [key[1].as_py()], "day": [key[2].as_py()], "n": pa.array([t.num_rows], pa.int32()), "ticker": [t.column("ticker").to_pylist()],
                "train": [train.tobytes()], "relevance": [rel.tobytes()], "bins": [bins.tobytes()],
            }
        )

    one = rows.select("fold", "provider", F.col(ORDER).cast("string").alias("day"), "ticker", "train", F.col(relevance).cast("double").alias("relevance"), *[finite(F.col(f)).alias(f"f{k}") for k, f in enumerate(features)])
    one = one.filter(F.col("relevance").isNotNull() & F.col("fold").isin(list(edges)))
    return one.groupBy("fold", "provider", "day").applyInArrow(run, _PACKED)


def gradients(score: np.ndarray, relevance: np.ndarray, pairs: int, normalize: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of one query, in units of 2^-24: gradient and hessian of each row."""
    n = len(score)
    g, h = np.zeros(n), np.zeros(n)
    gain = np.exp2(relevance) - 1
    place = 1 / np.log2(np.arange(n) + 2.0)
    ideal = (np.sort(gain)[::-1] * place).sum()
    if n < 2 or ideal <= 0:
        return g.astype(np.int64), h.astype(np.int64)
    order = np.argsort(-score, kind="stable")
    s, rel, y = score[order], relevance[order], gain[order]
    total = 0.0
    for i in range(min(pairs, n - 1)):
        j = np.arange(i + 1, n)
        j = j[rel[j] != rel[i]]
        delta = np.abs(y[i] - y[j]) * (place[i] - place[j]) / ideal
        up = np.where(rel[i] > rel[j], 1.0, -1.0)  # the upper row is the better one
        p = 1 / (1 + np.exp(up * (s[i] - s[j])))  # chance that the pair is the wrong way round
        force, bend = p * delta, 2 * np.maximum(p * (1 - p), 1e-16) * delta
        g[order[i]] -= (up * force).sum()
        g[order[j]] += up * force
        h[order[i]] += bend.sum()
        h[order[j]] += bend
        total += 2 * force.sum()
    if normalize and total > 0:
        by = np.log2(1 + total) / total
        g, h = g * by, h * by
    return np.rint(g * UNIT).astype(np.int64), np.rint(h * UNIT).astype(np.int64)


def _hash01(*parts) -> float:
    from hashlib import blake2b

    return int.from_bytes(blake2b("\x1f".join(map(str, parts)).encode(), digest_size=8).digest(), "big") / 2.0**64


def drawn_features(p: RankerParams, tree: int, n: int) -> list[int]:
    """The features that a tree may split by: the first by hash, at least one."""
    keep = max(1, round(p.colsample * n))
    return sorted(sorted(range(n), key=lambda f: (_hash01(p.seed, tree, f), f))[:keep])


def _round(params: list[RankerParams], runs: dict[int, int], tree: int, before: dict[int, Tree], width: int):
    """A narrow pass: adds the tree before to the scores, then computes the gradients for the next one."""

    def one(r: dict) -> dict:
        p, n = params[runs[r["run"]]], r["n"]
        score = np.frombuffer(r["score"], np.float64)
        if r["run"] in before:
            score = score + p.learning_rate * before[r["run"]].values(np.frombuffer(r["bins"], np.uint8).reshape(n, width))
        on = np.frombuffer(r["train"], np.uint8) > 0
        g, h = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if on.any() and tree < p.trees:
            g[on], h[on] = gradients(score[on], np.frombuffer(r["relevance"], np.float64)[on], p.pairs, p.normalize)
            if p.subsample < 1:
                out = [_hash01(p.seed, tree, r["provider"], r["day"], t) >= p.subsample for t in r["ticker"]]
                g[out], h[out] = 0, 0
        return {"score": score.tobytes(), "g": g.tobytes(), "h": h.tobytes()}

    def run(batches):
        for batch in batches:
            rows = [one(r) for r in batch.to_pylist()]
            for name in ("score", "g", "h"):
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array([r[name] for r in rows], pa.binary()))
            yield batch

    return run


def _histograms(trees: dict[int, Tree], level: int, drawn: dict[int, list[int]], width: int, bins: int):
    """A narrow pass: sums of gradients by (run, node, feature, bin) of all rows that a task has read."""
    first, nodes = 2**level - 1, 2**level

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.select(["run", "n", "bins", "g", "h"]).to_pylist():
                if r["run"] not in trees:
                    continue
                h = np.frombuffer(r["h"], np.int64)
                on = np.flatnonzero(h)
                b = np.frombuffer(r["bins"], np.uint8).reshape(r["n"], width)[on]
                at = trees[r["run"]].nodes(b) - first
                on, b, at = on[at >= 0], b[at >= 0], at[at >= 0]
                own = sums.setdefault(r["run"], np.zeros((3, nodes * width * bins), np.int64))
                g, h = np.frombuffer(r["g"], np.int64)[on], h[on]
                for f in drawn[r["run"]]:
                    cell = (at * width + f) * bins + b[:, f]
                    np.add.at(own[0], cell, g)
                    np.add.at(own[1], cell, h)
                    np.add.at(own[2], cell, 1)
        for r, own in sums.items():
            cell = np.flatnonzero(own[2])
            columns = [np.full(len(cell), r, np.int32), (cell // (width * bins) + first).astype(np.int32), (cell // bins % width).astype(np.int32), (cell % bins).astype(np.int32), own[0][cell], own[1][cell], own[2][cell]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["run", "node", "feature", "bin", "g", "h", "n"])

    return run


def _weight(g: Column, h: Column, alpha: Column, lam: Column) -> Column:
    return -F.signum(g) * F.greatest(F.abs(g) - alpha, F.lit(0.0)) / (h + lam)


def best_splits(sums: DataFrame, runs: DataFrame) -> DataFrame:
    """sums by task -> a row a node: its best split if it has one (gain), and the weights of the node and both sides."""
    cells = sums.groupBy("run", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"]).join(F.broadcast(runs), "run")  # runs x parameters
    own = Window.partitionBy("run", "node", "feature")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    for c in "ghn":
        cells = cells.withColumns({f"{c}_all": F.sum(c).over(own), f"{c}_upto": F.sum(c).over(upto), f"{c}_none": F.sum(F.when(F.col("bin") == 0, F.col(c)).otherwise(0)).over(own)})
    sides = F.explode(F.array(F.lit(True), F.lit(False))).alias("missing_left")
    cells = cells.select("*", sides)
    left = {c: F.when(F.col("missing_left"), F.col(f"{c}_upto")).otherwise(F.col(f"{c}_upto") - F.col(f"{c}_none")) for c in "ghn"}
    cells = cells.withColumns({f"{c}_left": v for c, v in left.items()})
    real = lambda c: F.col(c) / UNIT
    gl, hl, g, h = real("g_left"), real("h_left"), real("g_all"), real("h_all")
    gr, hr = (F.col("g_all") - F.col("g_left")) / UNIT, (F.col("h_all") - F.col("h_left")) / UNIT

    def part(g: Column, h: Column) -> Column:
        rest = F.greatest(F.abs(g) - F.col("alpha"), F.lit(0.0))
        return rest * rest / (h + F.col("lam"))

    gain = (part(gl, hl) + part(gr, hr) - part(g, h)) / 2 - F.col("gamma")
    fits = (F.col("n_left") > 0) & (F.col("n_left") < F.col("n_all")) & (hl >= F.col("min_child_weight")) & (hr >= F.col("min_child_weight")) & (gain > 0)
    # ties: the first feature, then the first cut; without missing values both directions are the same split
    rank = F.when(fits & (F.col("bin") > 0), F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), F.col("missing_left").alias("m")))
    w = lambda a, b: _weight(a, b, F.col("alpha"), F.col("lam"))
    row = F.struct(rank.alias("rank"), w(g, h).alias("own"), w(gl, hl).alias("left"), w(gr, hr).alias("right"))
    best = cells.groupBy("run", "node").agg(F.max_by(row, F.coalesce(rank, F.struct(F.lit(-1.0).alias("gain"), F.lit(0).alias("f"), F.lit(0).alias("b"), F.lit(False).alias("m")))).alias("best"))
    return best.select("run", "node", "best.*")


def fit_runs(rows: DataFrame, features, relevance: str, params: list[RankerParams], bins: int = 32) -> tuple[dict[tuple[int, int], Booster], DataFrame]:
    """rows (fold, train, keys, features, relevance) -> {(parameter set, fold): booster}, and the score of every row (trained
    on or not) in every run: (trial, fold, train, provider, trading_date, ticker, relevance, score)."""
    features = tuple(features)
    check_has(rows, ("fold", "train", "provider", "ticker", ORDER, relevance, *features))
    if not 2 <= bins <= 254:
        raise ValueError("bins must be 2 to 254")
    spark, width = rows.sparkSession, len(features)
    edges = cut_points(rows, features, bins)
    folds = sorted(edges)
    runs = {k * len(folds) + i: k for k in range(len(params)) for i in range(len(folds))}
    fold_of = {r: folds[r % len(folds)] for r in runs}
    boosters = {(runs[r], fold_of[r]): Booster(features, edges[fold_of[r]], [], params[runs[r]]) for r in runs}
    table = spark.createDataFrame([(r, fold_of[r], *[float(getattr(params[k], f)) for f in ("alpha", "lam", "gamma", "min_child_weight")]) for r, k in runs.items()], "run int, fold int, alpha double, lam double, gamma double, min_child_weight double")
    queries = packed(rows, features, relevance, edges)
    zeros = F.expr("unhex(repeat('00', 8 * n))")
    state = queries.join(F.broadcast(table.select("run", "fold")), "fold").select("run", *queries.columns, *[zeros.alias(c) for c in ("score", "g", "h")])
    state, grown = stored(state, "queries"), {}
    for tree in range(max(p.trees for p in params) + 1):
        state = stored(state.mapInArrow(_round(params, runs, tree, grown, width), _STATE), "boosting")
        open_ = {r: Tree.of_depth(params[k].depth) for r, k in runs.items() if tree < params[k].trees}
        if not open_:
            break
        drawn = {r: drawn_features(params[runs[r]], tree, width) for r in open_}
        growing = dict(open_)
        for level in range(max(params[runs[r]].depth for r in open_)):
            growing = {r: t for r, t in growing.items() if level < params[runs[r]].depth}
            sums = state.mapInArrow(_histograms(growing, level, drawn, width, bins + 1), "run int, node int, feature int, bin int, g long, h long, n long")
            for s in best_splits(sums, table.drop("fold")).collect():  # a row a node
                t, k = open_[s["run"]], s["node"]
                if level == 0:
                    t.value[0] = s["own"]
                if s["rank"] is not None:
                    t.feature[k], t.cut[k], t.missing_left[k], t.gain[k] = -s["rank"]["f"], -s["rank"]["b"], s["rank"]["m"], s["rank"]["gain"]
                    t.value[2 * k + 1], t.value[2 * k + 2] = s["left"], s["right"]
        grown = open_
        for r, t in grown.items():
            rate = params[runs[r]].learning_rate
            boosters[runs[r], fold_of[r]].trees.append(Tree(t.feature, t.cut, t.missing_left, [rate * v for v in t.value], t.gain))
    return boosters, _unpacked(state, runs)


def _unpacked(state: DataFrame, runs: dict[int, int]) -> DataFrame:
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n = r["n"]
                one = lambda v, kind: pa.array([v] * n, kind)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        one(runs[r["run"]], pa.int32()), one(r["fold"], pa.int32()), pa.array(np.frombuffer(r["train"], np.uint8) > 0), one(r["provider"], pa.string()), one(r["day"], pa.string()),
                        pa.array(r["ticker"], pa.string()), pa.array(np.frombuffer(r["relevance"], np.float64)), pa.array(np.frombuffer(r["score"], np.float64)),
                    ],
                    names=["trial", "fold", "train", "provider", "day", "ticker", "relevance", "score"],
                )

    out = state.mapInArrow(run, "trial int, fold int, train boolean, provider string, day string, ticker string, relevance double, score double")
    return out.select("trial", "fold", "train", "provider", F.col("day").cast("date").alias(ORDER), "ticker", "relevance", "score")


def fit_ranker(train: DataFrame, features, relevance: str, params: RankerParams | None = None, bins: int = 32) -> Booster:
    """One model on all rows."""
    params = params or RankerParams()
    boosters, _ = fit_runs(train.withColumns({"fold": F.lit(0), "train": F.lit(True)}), features, relevance, [params], bins)
    if not boosters:
        raise ValueError("there is no row to learn from")
    return boosters[0, 0]


def tune(samples: DataFrame, roles: DataFrame, features, relevance: str, params: list[RankerParams], bins: int = 32) -> tuple[dict[tuple[int, int], Booster], DataFrame]:
    """Every parameter set on every fold. roles: (fold, role, keys), as from expanding_folds."""
    keys = ["provider", "ticker", ORDER]
    rows = samples.join(roles, keys).withColumn("train", F.col("role") == "train").drop("role")
    return fit_runs(stored(rows.select("fold", "train", *keys, relevance, *features), "folds"), features, relevance, params, bins)


def tail_by_fold(scored: DataFrame, outcomes: DataFrame, percentile: str, relative_return: str, k: int = 10, seed: int = 0, top: float = 0.8) -> DataFrame:
    """(trial, fold, role, ndcg, and of the k rows of each date with the highest score, ties in random order: means over dates).
    outcomes: (keys, percentile, relative_return)."""
    keys = ["provider", "ticker", ORDER]
    rows = scored.join(outcomes.select(*keys, percentile, relative_return), keys).withColumn("__tie", random_score(seed, *keys))
    by = ["trial", "fold", "train", "provider", ORDER]
    day = Window.partitionBy(*by)
    rows = rows.withColumns({"__p": F.row_number().over(day.orderBy(F.desc("score"), F.desc("__tie"))), "__i": F.row_number().over(day.orderBy(F.desc("relevance"), "ticker"))})
    gain = lambda at: F.sum(F.when(F.col(at) <= k, (F.pow(F.lit(2.0), "relevance") - 1) / F.log2(F.col(at) + 1.0)))
    best = lambda x: F.avg(F.when(F.col("__p") <= k, x))
    daily = rows.groupBy(*by).agg(
        F.try_divide(gain("__p"), gain("__i")).alias("ndcg"), best(F.col(percentile)).alias("percentile"), best(F.col(relative_return)).alias("relative_return"),
        best((F.col(percentile) >= top).cast("double")).alias("top_quantile"),
    )
    out = daily.groupBy("trial", "fold", F.when(F.col("train"), "train").otherwise("validation").alias("role")).agg(
        F.count(F.lit(1)).alias("dates"), F.avg("ndcg").alias("ndcg"), F.avg("percentile").alias("top_k_percentile"), F.avg("relative_return").alias("top_k_relative_return"),
        F.percentile("relative_return", 0.5).alias("median_top_k_relative_return"), F.avg("top_quantile").alias("top_quantile_fraction"), F.avg((F.col("relative_return") > 0).cast("double")).alias("positive_date_fraction"),
    )
    return out


def trial_summary(folds: DataFrame) -> DataFrame:
    """A row a trial from tail_by_fold: means over folds, what training promises beyond validation, the worst fold, and ranks."""
    on = lambda role, c: F.when(F.col("role") == role, F.col(c))
    names = ("top_k_percentile", "top_k_relative_return")
    out = folds.groupBy("trial").agg(
        *[F.avg(on(role, c)).alias(f"mean_{prefix}{c}") for c in names for role, prefix in (("train", "train_"), ("validation", ""))],
        F.avg(on("validation", "median_top_k_relative_return")).alias("mean_fold_median_top_k_relative_return"), F.stddev_pop(on("validation", "top_k_relative_return")).alias("std_fold_top_k_relative_return"),
        F.min(on("validation", "top_k_relative_return")).alias("worst_fold_top_k_relative_return"), F.avg(on("validation", "top_quantile_fraction")).alias("mean_top_quantile_fraction"),
        F.avg(on("validation", "positive_date_fraction")).alias("mean_positive_date_fraction"),
    )
    out = out.withColumns({"percentile_gap": F.col("mean_train_top_k_percentile") - F.col("mean_top_k_percentile"), "relative_return_gap": F.col("mean_train_top_k_relative_return") - F.col("mean_top_k_relative_return")})
    ranks = {"return_rank": "mean_top_k_relative_return", "percentile_rank": "mean_top_k_percentile", "worst_fold_rank": "worst_fold_top_k_relative_return"}
    out = out.withColumns({r: F.rank().over(Window.orderBy(F.desc(c))) for r, c in ranks.items()})  # a row a trial
    return out.withColumn("selection_rank", (F.col("return_rank") + F.col("percentile_rank") + F.col("worst_fold_rank")) / 3.0)


def mean_importance(boosters: dict[tuple[int, int], Booster]) -> dict[int, dict[str, float]]:
    """trial -> feature -> mean over folds of its share of gain: what pruning features goes by."""
    out: dict[int, list[dict[str, float]]] = {}
    for (trial, _), b in sorted(boosters.items()):
        out.setdefault(trial, []).append(b.importance())
    return {t: {f: sum(x[f] for x in every) / len(every) for f in every[0]} for t, every in out.items()}


def random_params(seed: int, n: int) -> list[RankerParams]:
    """n parameter sets drawn by hash from the ranges that tuning looks at."""
    # Range and step of each parameter.
    grid = {
        "trees": (150, 450, 20), "learning_rate": (0.02, 0.12, 0.01), "depth": (3, 8, 1), "min_child_weight": (1, 12, 1), "subsample": (0.65, 1.0, 0.05),
        "colsample": (0.5, 1.0, 0.05), "gamma": (0.0, 1.0, 0.05), "alpha": (0.0, 2.0, 0.1), "lam": (1.0, 15.0, 1.0), "normalize": (0, 1, 1),
    }
    kinds = {f.name: f.type for f in fields(RankerParams)}
    out = []
    for k in range(n):
        drawn = {}
        for name, (low, high, step) in grid.items():
            v = low + step * int(_hash01(seed, k, name) * (int((high - low) / step + 1e-9) + 1))
            drawn[name] = bool(v) if kinds[name] == "bool" else int(v) if kinds[name] == "int" else round(float(v), 4)
        out.append(RankerParams(**drawn, seed=seed))
    return out


def describe(b: Booster) -> dict:
    """The model as plain values, for a model file."""
    return {"features": list(b.features), "edges": b.edges, "params": asdict(b.params), "trees": [asdict(t) for t in b.trees]}
