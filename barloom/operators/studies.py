"""Analyses around a ranking study: tails, trials, ties, regression errors, resampling tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import ORDER, divide
from barloom.operators.evaluation import random_score, spearman


def tail_by_date(p: DataFrame, percentile: str, k: int = 10) -> DataFrame:
    """Top k of each date: mean percentile, mean return, share in the top fifth."""
    place = F.row_number().over(Window.partitionBy(ORDER).orderBy(F.desc("score"), "ticker"))
    best = p.withColumn("__p", place).filter(F.col("__p") <= k)
    return best.groupBy(ORDER).agg(F.avg(percentile).alias("mean_percentile"), F.avg("ranking_return").alias("mean_return"), F.avg((F.col(percentile) >= 0.8).cast("double")).alias("top_fifth_share"))


def tail_summary(daily: DataFrame) -> DataFrame:
    names = ("mean_percentile", "mean_return", "top_fifth_share")
    return daily.agg(F.count(F.lit(1)).alias("dates"), *[F.avg(c).alias(f"{c}_mean") for c in names], *[F.percentile(c, 0.5).alias(f"{c}_median") for c in names])


def rank_trials(trials: DataFrame, metrics) -> DataFrame:
    """Trials by the mean of their ranks on each metric (higher is better; ties share the best rank). One row a trial."""
    ranked = trials.withColumns({f"rank_{m}": F.rank().over(Window.orderBy(F.desc(m))) for m in metrics})
    return ranked.withColumn("mean_rank", reduce(lambda a, b: a + b, [F.col(f"rank_{m}") for m in metrics]) / float(len(metrics)))


def relevance_by_cut(df: DataFrame, x: str, cuts=(0.50, 0.75, 0.90, 0.97), name: str = "relevance") -> DataFrame:
    """Number of cuts that the row's percent rank on its date (average rank over count) is above."""
    day = Window.partitionBy("provider", ORDER)
    v = F.col(x)
    rank = F.rank().over(day.orderBy(v.asc_nulls_last())) + (F.count(v).over(Window.partitionBy("provider", ORDER, v)) - 1) / 2.0
    share = F.when(v.isNotNull(), rank / F.count(v).over(day))
    return df.withColumn(name, F.when(share.isNotNull(), sum((share > c).cast("int") for c in cuts)))


def _pairs_alike(sorted_values) -> int:
    """Pairs of equal values of a sorted array."""
    import numpy as np

    _, n = np.unique(sorted_values, return_counts=True)
    return int((n * (n - 1) // 2).sum())


def inversions(rank) -> int:
    """Pairs i < j with rank[i] > rank[j], by merging sorted runs of doubling length: all runs of a length at once."""
    import numpy as np

    rank = np.asarray(rank, np.int64)
    n, total, width = len(rank), 0, 1
    top = int(rank.max(initial=0)) + 1
    while width < n:
        pair = np.arange(n) // (2 * width)
        right = (np.arange(n) // width) % 2 == 1
        key = pair * top + rank
        left_keys = np.sort(key[~right])
        upto = np.searchsorted(left_keys, key[right], side="right")
        ends = np.searchsorted(left_keys, (pair[right] + 1) * top, side="left")
        total += int((ends - upto).sum())
        width *= 2
    return total


def kendall_by_date(p: DataFrame, x: str = "score", y: str = "ranking_return", by=("provider", ORDER)) -> DataFrame:
    """Tau-b by date: the rows of a date are sorted and inversions counted, n log n steps; a date has one row an instrument."""
    rows = p.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def tau(key, t):
        import numpy as np
        import pyarrow as pa

        a, b = (np.unique(t.column(c).to_numpy(), return_inverse=True)[1] for c in ("x", "y"))
        a, b = a[order := np.lexsort((b, a))], b[order]
        n = len(a)
        every, same_x, same_y = n * (n - 1) // 2, _pairs_alike(a), _pairs_alike(np.sort(b))
        same_both = _pairs_alike(np.sort(a.astype(np.int64) * (n + 1) + b))
        against = inversions(b)  # within equal x, y ascends, so those pairs don't count
        s = every - same_x - same_y + same_both - 2 * against
        whole = float(every - same_x) * float(every - same_y)
        return pa.table({**{c: [k.as_py()] for c, k in zip(by, key, strict=True)}, "kendall": pa.array([s / whole**0.5 if whole else None], pa.float64()), "pairs": pa.array([every], pa.int64())})

    keys = ", ".join(f"{c} {dict(p.dtypes)[c]}" for c in by)
    return rows.groupBy(*by).applyInArrow(tau, f"{keys}, kendall double, pairs long").filter("pairs > 0").drop("pairs")


def daily_ic(p: DataFrame) -> DataFrame:
    by = ("provider", ORDER)
    return spearman(p, by).join(kendall_by_date(p), list(by), "left")


def score_ties(p: DataFrame) -> DataFrame:
    """By date: distinct scores, rows that share the top score, whether all are the same."""
    top = p.withColumn("__top", F.max("score").over(Window.partitionBy(ORDER)))
    return top.groupBy(ORDER).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("score").alias("distinct_scores"), F.count_if(F.col("score") == F.col("__top")).alias("top_rows")).withColumn("flat", F.col("distinct_scores") == 1)


def regression_metrics(p: DataFrame, y: str = "ranking_return", x: str = "score") -> DataFrame:
    e, rows = F.col(y) - F.col(x), p.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1.0 - divide(F.sum(e * e), F.var_pop(y) * F.count(F.lit(1)))).alias("r2"), F.corr(x, y).alias("pearson")
    )


def top_bucket(p: DataFrame, k: int, skip_flat: bool = True) -> DataFrame:
    """By date: mean return of the top k (ties by ticker) against all; dates on which all scores are the same are left out."""
    place = F.row_number().over(Window.partitionBy(ORDER).orderBy(F.desc("score"), "ticker"))
    rows = p.withColumn("__p", place)
    day = rows.groupBy(ORDER).agg(F.avg(F.when(F.col("__p") <= k, F.col("ranking_return"))).alias("top_return"), F.avg("ranking_return").alias("all_return"), F.count_distinct("score").alias("__n"))
    day = day.filter("__n > 1") if skip_flat else day
    return day.select(ORDER, "top_return", "all_return", (F.col("top_return") - F.col("all_return")).alias("spread"))


def top_share(p: DataFrame, share: float) -> DataFrame:
    """The ceil(n * share) rows of each date with the highest score, at least one."""
    day = Window.partitionBy(ORDER)
    place, n = F.row_number().over(day.orderBy(F.desc("score"), "ticker")), F.count(F.lit(1)).over(day)
    return p.withColumns({"__p": place, "__n": n}).filter(F.col("__p") <= F.greatest(F.lit(1), F.ceil(F.col("__n") * share))).drop("__p", "__n")


def deciles(p: DataFrame, bins: int = 10) -> DataFrame:
    """Mean return by bin of the first-come rank on the date, each date with equal weight."""
    day = Window.partitionBy(ORDER)
    r, n = F.row_number().over(day.orderBy("score", "ticker")), F.count(F.lit(1)).over(day)
    # the k-th of equal cuts of ranks 1..n, each closed above
    q = F.greatest(F.lit(1), F.ceil((r - 1) * float(bins) / (n - 1)))
    daily = p.withColumn("decile", F.when(n > 1, q).otherwise(1).cast("int")).groupBy(ORDER, "decile").agg(F.avg("ranking_return").alias("r"))
    return daily.groupBy("decile").agg(F.count(F.lit(1)).alias("dates"), F.avg("r").alias("mean_return"))


def bootstrap_spreads(spreads: DataFrame, x: str = "spread", resamples: int = 500, seed: int = 0) -> DataFrame:
    """(mean, low, high): 2.5 and 97.5 % of the means of resampled dates. Each draw picks a date by a hash (SHA-256 of seed, resample
    and draw), so it repeats, on any engine. Dates are few; each is met by its draws through an equi-join on its number.
    """
    rows = spreads.filter(F.col(x).isNotNull())
    numbered = rows.select(F.col(x).alias("x"), (F.row_number().over(Window.orderBy(ORDER)) - 1).alias("i"))
    n = rows.count()
    if not n:
        return spreads.sparkSession.createDataFrame([], "mean double, low double, high double")
    ids = spreads.sparkSession.range(resamples * n).select((F.col("id") % resamples).alias("b"), F.floor(F.col("id") / resamples).alias("j"))
    pick = F.floor(random_score(seed, "b", "j") * n)
    draws = ids.select("b", F.least(pick, F.lit(n - 1)).cast("int").alias("i"))
    means = draws.join(numbered, "i").groupBy("b").agg(F.avg("x").alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def permutation_test(p: DataFrame, k: int, permutations: int = 250, seed: int = 0) -> DataFrame:
    """(observed, p_value): the mean top-k return against scores shuffled within dates; p = (1 + those at least as high) / (n + 1).

    A date's rows (one an instrument) are shuffled once; its task draws all permutations, by SHA-256 of permutation, seed and keys,
    and gives back the mean of the k first of each: dates x permutations rows, whatever the number of instruments.
    """
    rows = p.filter(F.col("ranking_return").isNotNull()).select("provider", "ticker", F.col(ORDER).cast("string").alias("day"), "score", F.col("ranking_return").cast("double").alias("r"))

    def draw(key, t):
        import heapq
        from hashlib import sha256

        import pyarrow as pa

        t = t.sort_by([("score", "descending"), ("ticker", "ascending")])
        r, day = t.column("r").to_pylist(), key[0].as_py()
        names = list(zip(t.column("provider").to_pylist(), t.column("ticker").to_pylist(), strict=True))
        mean = lambda at: sum(r[i] for i in at) / len(at)
        means = [mean(range(min(k, len(r))))]
        for b in range(permutations):
            order = [(sha256(f"{b}\x1f{seed}\x1f{a}\x1f{c}\x1f{day}".encode()).hexdigest(), c, i) for i, (a, c) in enumerate(names)]
            means.append(mean([i for _, _, i in heapq.nsmallest(k, order)]))
        return pa.table({"b": pa.array(range(-1, permutations), pa.int32()), "m": pa.array(means, pa.float64())})

    means = rows.groupBy("day").applyInArrow(draw, "b int, m double").groupBy("b").agg(F.avg("m").alias("m"))
    # permutations + 1 rows
    return means.agg(F.max(F.when(F.col("b") < 0, F.col("m"))).alias("observed"), F.array_agg(F.when(F.col("b") >= 0, F.col("m"))).alias("all")).select(
        "observed", ((1 + F.size(F.filter("all", lambda m: m >= F.col("observed")))) / (permutations + 1)).alias("p_value")
    ).filter("observed IS NOT NULL")


def short_horizon_targets(bars: DataFrame, horizons=(1, 2, 3), atr: str = "atr", max_raw: float = 3.0, max_units: float = 50.0, least_atr: float = 1e-4) -> DataFrame:
    """Forward returns, raw and in ATRs; out-of-bounds ones, and those with a tiny ATR, are missing."""
    from barloom.functions.core import lead

    share = divide(atr, "close")
    out = {}
    for h in horizons:
        raw = divide(lead("close", h), "close") - 1.0
        units = divide(raw, share)
        ok = (F.abs(raw) <= max_raw) & (F.abs(units) <= max_units) & (share >= least_atr)
        out |= {f"raw_return_{h}d": F.when(ok, raw), f"atr_return_{h}d": F.when(ok, units)}
    return bars.withColumns(out)


def prune_features(current, importance: dict[str, float], pool, iteration: int, protected=(), least: int = 20, drop_share: float = 0.1, add: int = 5, seed: int = 0) -> tuple[tuple, tuple, tuple]:
    """(next columns in the order of pool, dropped, added): the least important go, as many at most come back at random from the pool.

    Lists of names only, so it runs on the driver.
    """
    from random import Random

    may_go = sorted((c for c in current if c not in set(protected)), key=lambda c: importance.get(c, 0.0))
    n = min(max(0, len(current) - least), max(1, round(len(current) * drop_share)), len(may_go))
    dropped = tuple(may_go[:n])
    kept = set(current) - set(dropped)
    rest = [c for c in pool if c not in kept]
    added = tuple(Random(seed + iteration).sample(rest, min(add, n, len(rest))))
    return tuple(c for c in pool if c in kept | set(added)), dropped, added
