"""Evaluation of scores: classification metrics, calibration, ranking by day. Everything is exact, ties included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import ORDER, divide, finite
from barloom.functions.stored import stored

EPSILON = 2.220446049250313e-16


def random_score(seed: int, *keys: str) -> Column:
    """A number in (0, 1) from the seed and the keys, the same on every run and every engine with SHA-256."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return (F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def predictions(df: DataFrame, score: str, target: str, ranking_return: str | None, threshold: float = 0.5) -> DataFrame:
    """(provider, ticker, trading_date, target, score, predicted_class, ranking_return)."""
    r = finite(ranking_return) if ranking_return else F.lit(None).cast("double")
    s = F.col(score).cast("double")
    return df.select("provider", "ticker", ORDER, F.col(target).cast("int").alias("target"), s.alias("score"), (s >= threshold).cast("int").alias("predicted_class"), r.alias("ranking_return"))


def prediction_violations(p: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of counts of what a prediction frame may not have."""
    s = F.col("score")
    return p.agg(
        F.count_if(~F.coalesce(F.col("target").isin(0, 1), F.lit(False))).alias("target_not_binary"), F.count_if(~F.coalesce(s.between(0, 1), F.lit(False))).alias("score_out_of_range"),
        F.count_if(F.col("predicted_class") != (s >= threshold).cast("int")).alias("class_disagrees"),
    )


def checked(p: DataFrame, threshold: float = 0.5) -> DataFrame:
    """p, if targets are 0 or 1, scores between 0 and 1, classes what the threshold says, and keys there once."""
    found = {k: n for k, n in prediction_violations(p, threshold).first().asDict().items() if n}
    if again := p.groupBy("provider", "ticker", ORDER).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").count():
        found["repeated_key"] = again
    if found:
        raise ValueError(f"the predictions are not valid: {found}")
    return p


RANGES = 64


def _in_ranges(at: DataFrame) -> tuple[DataFrame, list[str]]:
    """One row a score, with the range that it falls in and what lies above that range: running sums go by range, so that no task has
    all scores. Ranges end at percentiles of the scores; their bounds and totals (RANGES of each) are all that the driver sees."""
    at = stored(at, "scores")  # read three times: a row a score, however many rows were summed into it
    bounds = at.agg(F.percentile_approx("score", [k / RANGES for k in range(1, RANGES)])).first()[0] or []
    limits = F.array(*map(F.lit, sorted(set(bounds)))) if bounds else F.array().cast("array<double>")
    at = at.withColumn("__range", F.size(F.filter(limits, lambda b: b > F.col("score"))))
    above_p, above_n, before = 0.0, 0.0, {}
    for r in at.groupBy("__range").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).orderBy("__range").collect():
        before[r["__range"]] = above_p, above_n
        above_p, above_n = above_p + (r["p"] or 0.0), above_n + (r["n"] or 0.0)
    of = [before.get(k, (0.0, 0.0)) for k in range(RANGES)]
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in of]), F.col("__range") + 1)
    return at.withColumns({"p_before": pick(0), "n_before": pick(1), "all_p": F.lit(above_p), "all_n": F.lit(above_n)}), ["__range"]


def classification(p: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Metrics over all rows, or for each group of ``by``; NULL where a class is absent.

    Rows combine to one a group and score before anything is ordered; precision-recall and ROC then follow from running sums
    over distinct scores, so ties are one step.
    """
    y, s = F.col("target").cast("double"), F.col("score")
    clipped = F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), s))
    at = p.groupBy(*by, "score").agg(
        F.sum(y).alias("p"), F.sum(1 - y).alias("n"), F.sum("predicted_class").alias("c"), F.sum(F.col("predicted_class") * y).alias("tp_c"),
        F.sum(-(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))).alias("loss"), F.sum((s - y) * (s - y)).alias("sq"),
    )
    at, within = (at, list(by)) if by else _in_ranges(at)
    upto = Window.partitionBy(*within).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    if by:
        every = Window.partitionBy(*by)
        at = at.withColumns({"p_before": F.lit(0.0), "n_before": F.lit(0.0), "all_p": F.sum("p").over(every), "all_n": F.sum("n").over(every)})
    at = at.withColumns({"tp": F.col("p_before") + F.sum("p").over(upto), "fp": F.col("n_before") + F.sum("n").over(upto)})
    tp0, fp0 = F.col("tp") - F.col("p"), F.col("fp") - F.col("n")  # counts, so differences are exact
    at = at.withColumns({
        "recall_at": divide("tp", "all_p"), "recall_before": divide(tp0, "all_p"), "precision_at": F.col("tp") / (F.col("tp") + F.col("fp")),
        "precision_before": F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(1.0),
    })
    gained = F.col("recall_at") - F.col("recall_before")
    at = at.withColumns({
        "ap": gained * F.col("precision_at"), "pr": gained * (F.col("precision_at") + F.col("precision_before")) / 2.0,
        "auc": F.col("p") * (F.col("all_n") - F.col("fp") + F.col("n") / 2.0),
    })
    rows, P, N = F.sum(F.col("p") + F.col("n")), F.first("all_p"), F.first("all_n")
    both = (P > 0) & (N > 0)
    return at.groupBy(*by).agg(
        rows.cast("long").alias("rows"), (P / rows).alias("prevalence"), F.when(P > 0, F.sum("ap")).alias("average_precision"), F.when(P > 0, F.sum("pr")).alias("pr_auc"),
        F.when(both, F.sum("auc") / (P * N)).alias("roc_auc"), F.when(both, F.sum("loss") / rows).alias("log_loss"), (F.sum("sq") / rows).alias("brier"),
        divide(F.sum("tp_c"), F.sum("c")).alias("precision"), divide(F.sum("tp_c"), P).alias("recall"),
    )


def calibration(p: DataFrame, bins: int = 10) -> DataFrame:
    """(bin from 1, lower, upper, rows, mean_score, positive_rate); empty bins too."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)) + 1
    found = p.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.avg("score").alias("mean_score"), F.avg(F.col("target").cast("double")).alias("positive_rate"))
    every = p.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"), ((F.col("id") - 1) / bins).alias("lower"), (F.col("id") / bins).alias("upper"))
    return every.join(found, "bin", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def with_quantile(p: DataFrame, quantiles: int = 5, tiebreak: str = "ticker") -> DataFrame:
    """Adds the quantile (1 lowest) of the score on its date: by rank, the highest row always in the last."""
    day = Window.partitionBy(ORDER)
    r, n = F.row_number().over(day.orderBy("score", tiebreak)), F.count(F.lit(1)).over(day)
    return p.withColumn("quantile", F.when(n == 1, quantiles).otherwise(1 + F.floor((r - 1) * (quantiles - 1) / (n - 1))).cast("int"))


def quantile_table(p: DataFrame, quantiles: int = 5) -> DataFrame:
    """Means by quantile: first by date, then over dates with equal weight."""
    daily = with_quantile(p, quantiles).groupBy(ORDER, "quantile").agg(F.avg("ranking_return").alias("r"), F.avg(F.col("target").cast("double")).alias("t"), F.avg("score").alias("s"))
    return daily.groupBy("quantile").agg(F.count(F.lit(1)).alias("dates"), F.avg("s").alias("mean_score"), F.avg("r").alias("mean_return"), F.avg("t").alias("positive_rate"))


def top_k(p: DataFrame, k: int, score: str = "score", tiebreak: str = "ticker") -> DataFrame:
    """A row a date: mean return and positive rate of the k rows with the highest score."""
    place = F.row_number().over(Window.partitionBy(ORDER).orderBy(F.desc(score), F.desc(tiebreak)))
    best = p.withColumn("__place", place).filter(F.col("__place") <= k)
    return best.groupBy(ORDER).agg(F.count(F.lit(1)).alias("rows"), F.avg("ranking_return").alias("mean_return"), F.avg(F.col("target").cast("double")).alias("positive_rate"))


def random_top_k(p: DataFrame, k: int, seed: int = 0) -> DataFrame:
    return top_k(p.withColumn("__random", random_score(seed, "provider", "ticker", ORDER)), k, "__random")


def lift(p: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Paired by date: the top k against k at random."""
    a = top_k(p, k).select(ORDER, F.col("mean_return").alias("a"))
    b = random_top_k(p, k, seed).select(ORDER, F.col("mean_return").alias("b"))
    return a.join(b, ORDER).agg(F.count(F.lit(1)).alias("dates"), F.avg("a").alias("top_mean_return"), F.avg("b").alias("random_mean_return"), F.avg(F.col("a") - F.col("b")).alias("lift"))


def _average_rank(x: str, by: tuple[str, ...], where: Column) -> tuple[Column, Column]:
    """(rank, ties) of x among the rows of a group where ``where`` holds."""
    v = F.when(where, F.col(x))
    return F.rank().over(Window.partitionBy(*by).orderBy(v.asc_nulls_last())), F.count(v).over(Window.partitionBy(*by, v))


def spearman(p: DataFrame, by: tuple[str, ...], x: str = "score", y: str = "ranking_return", name: str = "spearman") -> DataFrame:
    """Correlation of average ranks by group, over rows that have both; NULL if a side has one value only."""
    rows = p.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    (rx, tx), (ry, ty) = (_average_rank(c, by, F.lit(True)) for c in (x, y))
    ranked = rows.withColumns({"__x": rx + (tx - 1) / 2.0, "__y": ry + (ty - 1) / 2.0})
    enough = (F.min("__x") < F.max("__x")) & (F.min("__y") < F.max("__y"))
    return ranked.groupBy(*by).agg(F.when(enough, F.corr("__x", "__y")).alias(name))


def by_date_metrics(p: DataFrame, k: int = 5) -> DataFrame:
    out = classification(p, (ORDER,)).join(spearman(p, (ORDER,)), ORDER, "left")
    return out.join(top_k(p, k).select(ORDER, F.col("mean_return").alias("top_k_mean_return"), F.col("positive_rate").alias("top_k_positive_rate")), ORDER, "left")


def missingness(df: DataFrame, features) -> DataFrame:
    """(feature, missing, share), most first: what is NULL or not finite."""
    kinds = dict(df.dtypes)
    gone = lambda c: F.col(c).isNull() | (~F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) if kinds[c] in ("double", "float") else F.lit(False))
    one = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(gone(c)).alias(c) for c in features])
    long = one.unpivot(["__rows"], list(features), "feature", "missing")
    return long.select("feature", "missing", (F.col("missing") / F.col("__rows")).alias("share")).orderBy(F.desc("missing"), "feature")


def query_ids(df: DataFrame) -> DataFrame:
    """Adds query_id: dates of providers numbered from 0 in order, for learning to rank. Dates are numbered, then joined."""
    dates = df.select("provider", ORDER).distinct().withColumn("query_id", F.row_number().over(Window.orderBy("provider", ORDER)) - 1)
    return df.join(dates, ["provider", ORDER])


def ranking_by_date(p: DataFrame, relevance: str, k: int = 10, score: str = "score", r: str = "ranking_return") -> DataFrame:
    """(provider, date, ndcg, rank_ic, top_k_mean_return). Gain is the relevance; tied scores share their mean discount."""
    by = ("provider", ORDER)
    day = Window.partitionBy(*by)
    place = lambda c, *more: F.row_number().over(day.orderBy(F.desc(c), *more))
    discount = lambda c: F.when(F.col(c) <= k, 1.0 / F.log2(F.col(c) + 1.0)).otherwise(0.0)
    rows = p.withColumns({"__p": place(score, "ticker"), "__i": place(relevance, "ticker")})
    rows = rows.withColumn("__d", F.avg(discount("__p")).over(Window.partitionBy(*by, score)))
    out = rows.groupBy(*by).agg(
        divide(F.sum(F.col("__d") * F.col(relevance)), F.sum(discount("__i") * F.col(relevance))).alias("ndcg"), F.avg(F.when(F.col("__p") <= k, F.col(r))).alias("top_k_mean_return")
    )
    return out.join(spearman(p, by, score, r, "rank_ic"), list(by), "left").select(*by, "ndcg", "rank_ic", "top_k_mean_return")


def ranking_summary(daily: DataFrame) -> DataFrame:
    return daily.agg(
        F.count(F.lit(1)).alias("dates"), F.avg("ndcg").alias("mean_ndcg"), F.avg("rank_ic").alias("mean_rank_ic"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_ic_share"),
        F.avg("top_k_mean_return").alias("mean_top_k_return"),
    )


def daily_summary(by_date: DataFrame) -> DataFrame:
    """One row from by_date_metrics: dates, mean Spearman and the share of dates on which it is positive, mean top-k return and rate."""
    return by_date.agg(
        F.count(F.lit(1)).alias("dates"), F.avg("spearman").alias("mean_daily_spearman"), F.avg((F.round("spearman", 12) > 0).cast("double")).alias("positive_spearman_share"),
        F.avg("top_k_mean_return").alias("mean_top_k_return"), F.avg("top_k_positive_rate").alias("mean_top_k_positive_rate"),
    )


def evaluate(
    p: DataFrame, k: int = 5, bins: int = 10, quantiles: int = 5, seed: int = 0, threshold: float = 0.5,
    features: DataFrame | None = None, feature_columns=(), context: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Every table of a report over valid predictions: metrics (one row, the means over dates and the context included), calibration,
    quantiles, top_k, random_top_k, lift, by_date, and missingness of the features of the rows that were scored.

    features: keys and feature_columns; only rows with a prediction count. context: names of columns to say what was evaluated.
    """
    p = checked(p, threshold)
    by_date = by_date_metrics(p, k)
    metrics = classification(p).crossJoin(daily_summary(by_date))  # one row each
    if context:
        taken = set(metrics.columns) & set(context)
        if taken:
            raise ValueError(f"context may not be named {sorted(taken)}")
        metrics = metrics.withColumns({name: F.lit(value) for name, value in context.items()})
    out = {
        "metrics": metrics, "calibration": calibration(p, bins), "quantiles": quantile_table(p, quantiles), "top_k": top_k(p, k), "random_top_k": random_top_k(p, k, seed),
        "lift": lift(p, k, seed), "by_date": by_date,
    }
    if features is not None:
        scored = features.join(p.select("provider", "ticker", ORDER), ["provider", "ticker", ORDER], "left_semi")
        out["missingness"] = missingness(scored, list(feature_columns))
    return out
