"""Queries of the stages after the features: quality gates, datasets, splits, evaluation, models, backtest, labelling, studies."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.core import add_percentile, by_date, lead
from barloom.functions.stored import stored, stored_dir
from barloom.operators import backtest, boosting, cross_section, dataset, evaluation, labeling, models, quality, studies, targets, trend
from barloom.plans import catalog, sql, surface
from barloom.plans.contracts import Block, BlockSet, Task
from barloom.plans.indicators import out
from barloom.plans.sql import BARS, KEYS, LAG, TRUE_RANGE, ewm, with_
from barloom.sources import bars as store
from barloom.sources import feed
from barloom.sources.bars import bars_week
from barloom.sources.versions import Versions

QUERIES: dict = {}
SQL: dict[str, str] = {}
T = quality.Thresholds(inference_rows=200, training_rows=350, turnover=1_000_000, turnover_rows=20)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


# --- stored bars and gates


@query("a01_load_prices", with_(BARS, select=f"SELECT {KEYS}, close, volume FROM b WHERE ticker IN ('Brand#11', 'Brand#12', 'Brand#13') AND trading_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"))
def _load(spark, d):
    return store.load_daily_prices(bars_week(spark, d), "tpch", ["Brand#11", "Brand#12", "Brand#13"], "1996-01-01", "1997-12-31", ["close", "volume"])


_UPSERTED = with_(BARS, select=f"SELECT {KEYS}, CASE WHEN trading_date >= DATE '2000-01-03' THEN floor(close) * 2 ELSE floor(close) END AS close, CASE WHEN trading_date >= DATE '2000-01-03' THEN 'second' ELSE 'first' END AS request_id FROM b")


@query("a04_upsert", _UPSERTED)
def _upsert(spark, d):
    rows = bars_week(spark, d).withColumns({"dividends": F.lit(0), "stock_splits": F.lit(0), "fetched_at": F.to_timestamp(F.lit("2024-01-01")), "request_id": F.lit("first"), "close": F.floor("close")})
    first = store.upsert(None, rows.filter("trading_date < DATE '2000-06-05'"))
    second = rows.filter("trading_date >= DATE '2000-01-03'").withColumns({"close": F.col("close") * 2, "request_id": F.lit("second")})
    return store.upsert(first, second).select("provider", "ticker", "trading_date", F.col("close").cast("double").alias("close"), "request_id")


@query("a04_committed_upsert", _UPSERTED)
def _committed(spark, d):
    rows = bars_week(spark, d).withColumns({"dividends": F.lit(0), "stock_splits": F.lit(0), "fetched_at": F.to_timestamp(F.lit("2024-01-01")), "request_id": F.lit("first"), "close": F.floor("close")})
    versions = Versions(spark, f"{stored_dir(spark)}/prices-{uuid.uuid4().hex}")
    month = "date_format(trading_date, 'yyyy-MM')"
    store.commit_prices(versions, rows.filter("trading_date < DATE '2000-06-05'"), part=month)
    later = {"close": F.col("close") * 2, "request_id": F.lit("second"), "fetched_at": F.to_timestamp(F.lit("2024-01-02"))}
    store.commit_prices(versions, rows.filter("trading_date >= DATE '2000-01-03'").withColumns(later), part=month)
    return versions.read("bars").select("provider", "ticker", "trading_date", F.col("close").cast("double").alias("close"), "request_id")


@query("a09_wide_to_long", with_(BARS, select="SELECT 'p' AS provider, ticker, trading_date, close, volume::DOUBLE AS volume FROM b"))
def _wide(spark, d):
    b = bars_week(spark, d)
    tickers = sorted(r[0] for r in spark.read.parquet(f"{d}/part.parquet").select("p_brand").distinct().collect())  # brands: the columns of the wide table
    wide = b.groupBy("trading_date").pivot("ticker", tickers).agg(F.max("close").alias("Close"), F.max("volume").alias("Volume"))
    wide = wide.withColumnsRenamed({f"{t}_{f}": f"{t}|{f}" for t in tickers for f in ("Close", "Volume")})
    return store.normalize_wide(wide, "p", "r", dt.datetime(2024, 1, 1), {"Close": "close", "Volume": "volume"}, tickers).select("provider", "ticker", "trading_date", "close", "volume")


@query("a08_download", with_(BARS, "s AS (SELECT ticker, max(trading_date) AS start_date FROM b WHERE trading_date < DATE '2000-01-03' GROUP BY ticker)", select=f"SELECT {KEYS}, floor(close) AS close, volume, CASE WHEN trading_date >= start_date THEN 'new' ELSE 'old' END AS request_id FROM b JOIN s USING (ticker) WHERE trading_date < DATE '2001-06-04'"))
def _download(spark, d):
    """Bars stored up to a date are brought up to another one: planned by ticker, downloaded by the data source from files that
    stand for the provider (made from the same tables), and put in by key."""
    bars = bars_week(spark, d).withColumns({"close": F.floor("close"), "dividends": F.lit(0.0), "stock_splits": F.lit(0.0)})
    folder = f"{stored_dir(spark)}/provider-{uuid.uuid4().hex}"
    bars.drop("provider").repartition("ticker").write.partitionBy("ticker").option("header", True).csv(folder)
    known = bars.filter("trading_date < DATE '2000-01-03'").withColumns({"fetched_at": F.lit(dt.datetime(2024, 1, 1)), "request_id": F.lit("old")})
    plan = quality.update_plan(bars.select("ticker").distinct(), known, "2001-06-04")
    new = feed.as_bronze(feed.planned(spark, plan, path=folder), "tpch", "new", dt.datetime(2024, 1, 2))
    return store.coerce(store.upsert(known, new).select("provider", "ticker", "trading_date", "close", "volume", "request_id"))


@query("b01_price_state", with_(BARS, select="SELECT ticker, count(*) AS row_count, min(trading_date) AS first_date, max(trading_date) AS last_date FROM b WHERE trading_date <= DATE '2000-12-31' GROUP BY ticker"))
def _state(spark, d):
    return quality.price_state(bars_week(spark, d), "tpch", None, "2000-12-31")


@query("b02_available_tickers", with_(BARS, select="SELECT DISTINCT ticker FROM b WHERE trading_date >= DATE '2000-01-01'"))
def _available(spark, d):
    return quality.available_tickers(bars_week(spark, d), "tpch", "2000-01-01")


_QUALITY = (
    "l AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trading_date DESC) AS pos FROM b)",
    "q AS (SELECT ticker, count(*) AS row_count, min(trading_date) AS first_date, max(trading_date) AS last_date, count_if(adjusted_close IS NULL) AS missing_adjusted_close, count_if(volume IS NULL OR volume <= 0) AS empty_volume, count(CASE WHEN pos <= 20 AND volume > 0 THEN close * volume END) AS turnover_observations, median(CASE WHEN pos <= 20 AND volume > 0 THEN close * volume END) AS median_turnover FROM l GROUP BY ticker)",
)


@query("b03_quality_state", with_(BARS, *_QUALITY, select="SELECT ticker, row_count, first_date, last_date, missing_adjusted_close, empty_volume, turnover_observations, round(median_turnover, 4) AS median_turnover FROM q"))
def _quality(spark, d):
    return rounded(quality.quality_state(bars_week(spark, d), t=T), 4)


_WANTED = "w AS (SELECT DISTINCT p_brand AS ticker FROM part UNION ALL SELECT 'NONE')"


def _gate_sql(rows: int, stale: str) -> str:
    return with_(
        BARS, *_QUALITY, _WANTED,
        f"g AS (SELECT ticker, row_count, concat_ws(',', CASE WHEN row_count IS NULL THEN 'missing' END, CASE WHEN missing_adjusted_close > 0 THEN 'missing_adjusted_close' END, CASE WHEN empty_volume / row_count > 0.05 THEN 'sparse_volume' END, CASE WHEN row_count IS NOT NULL AND turnover_observations < 19 THEN 'insufficient_turnover_observations' WHEN row_count IS NOT NULL AND (median_turnover IS NULL OR median_turnover < 1000000) THEN 'low_liquidity' END, CASE WHEN row_count < {rows} THEN 'insufficient_history' END{stale}) AS reasons FROM w LEFT JOIN q USING (ticker))",
        select="SELECT ticker, row_count, reasons, reasons = '' AS ok FROM g",
    )


def _wanted(spark, d):
    tickers = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("ticker")).distinct()
    return tickers.unionByName(spark.createDataFrame([("NONE",)], "ticker string"))


def _flat(gate: DataFrame) -> DataFrame:
    return gate.select("ticker", "row_count", F.array_join("reasons", ",").alias("reasons"), "ok")


@query("b05_inference_readiness", _gate_sql(200, ", CASE WHEN DATE '2001-11-09' - last_date > 4 THEN 'stale' END"))
def _ready(spark, d):
    return _flat(quality.inference_readiness(bars_week(spark, d), _wanted(spark, d), "2001-11-09", t=T))


@query("b06_training_eligibility", _gate_sql(350, ""))
def _eligible(spark, d):
    return _flat(quality.training_eligibility(bars_week(spark, d), _wanted(spark, d), t=T))


@query("b09_onboarding", with_(BARS, _WANTED, "s AS (SELECT ticker, count(*) AS n, min(trading_date) AS f, max(trading_date) AS l FROM b GROUP BY ticker)", select="SELECT w.ticker, CASE WHEN n > 0 THEN 'onboarded' ELSE 'missing' END AS status, coalesce(n, 0) AS row_count, f AS first_date, l AS last_date FROM w LEFT JOIN s USING (ticker)"))
def _onboard(spark, d):
    return quality.onboarding(_wanted(spark, d), bars_week(spark, d))


@query("b11_update_plan", with_(BARS, _WANTED, "s AS (SELECT ticker, max(trading_date) AS start_date FROM b GROUP BY ticker)", select="SELECT ticker, start_date, DATE '2001-11-01' AS end_date FROM w JOIN s USING (ticker) WHERE start_date < DATE '2001-11-01'"))
def _plan(spark, d):
    return quality.update_plan(_wanted(spark, d), bars_week(spark, d), "2001-11-01")


@query("b14_clean_prices", with_(BARS, f"r AS (SELECT *, coalesce(volume = 0 AND abs(open - lag(open) {LAG}) <= 1e-10 AND abs(close - lag(close) {LAG}) <= 1e-10 AND abs(high - lag(high) {LAG}) <= 1e-10 AND abs(low - lag(low) {LAG}) <= 1e-10, false) AS rep FROM b)", select=f"SELECT {KEYS}, open * (adjusted_close / close) AS open, high * (adjusted_close / close) AS high, low * (adjusted_close / close) AS low, adjusted_close AS close FROM r WHERE NOT rep AND adjusted_close / close > 0"))
def _clean(spark, d):
    return quality.clean_prices(bars_week(spark, d)).select("provider", "ticker", "trading_date", "open", "high", "low", "close")


# --- datasets

_FEATURES = BlockSet("small", "1", (Block("returns", cross_section.add_returns, ("return_1d", "return_5d"), frozenset({"adjusted_close"}), {"horizons": (1, 5)}),))
_TARGETS = BlockSet("up", "1", (Block("up", catalog._fixed, ("up",), frozenset({"adjusted_close"}), {"horizon": 5, "threshold": 0.0, "name": "up"}),))
_TASK = Task("up", "boolean", 5)
SPLIT = dataset.SplitSpec((dt.date(1995, 1, 1), dt.date(1998, 12, 31)), (dt.date(1999, 1, 1), dt.date(2000, 6, 30)), (dt.date(2000, 7, 1), dt.date(2001, 12, 31)), 3)
_BUNDLE = (
    BARS,
    f"s AS (SELECT *, adjusted_close / lag(adjusted_close) {LAG} - 1 AS return_1d, adjusted_close / lag(adjusted_close, 5) {LAG} - 1 AS return_5d, lead(adjusted_close, 5) {LAG} / adjusted_close - 1 > 0 AS up, lead(trading_date, 5) {LAG} AS target_end_date FROM b)",
    "d AS (SELECT * FROM s WHERE up IS NOT NULL)",
)


def _bundle(spark, d) -> DataFrame:
    return dataset.construct(bars_week(spark, d), _FEATURES, _TARGETS, _TASK)


@query("d02_dataset", with_(*_BUNDLE, select=f"SELECT {KEYS}, round(return_1d, 6) AS return_1d, round(return_5d, 6) AS return_5d, up, target_end_date, true AS eligible FROM d"))
def _dataset(spark, d):
    return out(_bundle(spark, d), "return_1d", "return_5d", "up", "target_end_date", "eligible")


@query(
    "d01_dataset_at_cutoff",
    with_(
        *_BUNDLE, "l AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trading_date DESC) AS pos FROM b WHERE trading_date <= DATE '1999-12-31')", _QUALITY[1],
        "w AS (SELECT DISTINCT ticker FROM b)", _gate_sql(350, "").split("g AS (", 1)[1].split(")\nSELECT", 1)[0].join(("g AS (", ")")),
        select=f"SELECT {KEYS}, up, reasons = '' AS eligible, reasons FROM d JOIN g USING (ticker)",
    ),
)
def _dataset_at_cutoff(spark, d):
    """Samples, with the eligibility of each ticker by what was known at the cutoff."""
    from barloom.plans.experiment import eligibility_at

    bars = bars_week(spark, d)
    tickers = tuple(r[0] for r in bars.select("ticker").distinct().collect())  # a universe
    spec = dataset.DatasetSpec(dataset.Universe("tpch", tickers), dt.date(1992, 1, 1), dt.date(2001, 12, 31), _FEATURES, _TARGETS, _TASK)
    df = dataset.construct(bars, _FEATURES, _TARGETS, _TASK, eligibility_at(bars, spec, "1999-12-31", T))
    return df.select("provider", "ticker", "trading_date", "up", "eligible", F.array_join("reasons", ",").alias("reasons"))


_SPLIT = (
    *_BUNDLE,
    "i AS (SELECT *, CASE WHEN trading_date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'train' WHEN trading_date BETWEEN DATE '1999-01-01' AND DATE '2000-06-30' THEN 'validation' WHEN trading_date BETWEEN DATE '2000-07-01' AND DATE '2001-12-31' THEN 'test' END AS c FROM d)",
    "p AS (SELECT *, c IS NOT NULL AND target_end_date > CASE c WHEN 'train' THEN DATE '1998-12-31' WHEN 'validation' THEN DATE '2000-06-30' ELSE DATE '2001-12-31' END AS purged FROM i)",
    "e AS (SELECT *, dense_rank() OVER (PARTITION BY c, purged ORDER BY trading_date DESC) AS k FROM p)",
    "x AS (SELECT *, CASE WHEN c IS NULL THEN 'outside' WHEN purged THEN 'purge' WHEN c <> 'test' AND k <= 3 THEN 'embargo' END AS why FROM e)",
)


@query("d10_split", with_(*_SPLIT, select=f"SELECT {KEYS}, CASE WHEN why IS NULL THEN c END AS split, why AS split_exclusion_reason FROM x"))
def _split(spark, d):
    return dataset.split(_bundle(spark, d), SPLIT).select("provider", "ticker", "trading_date", "split", "split_exclusion_reason")


@query("d11_split_summary", with_(*_SPLIT, select="SELECT c AS split, count(*) AS candidates, count_if(why IS NULL) AS assigned, count(CASE WHEN why = 'purge' THEN 1 END) AS purged, count(CASE WHEN why = 'embargo' THEN 1 END) AS embargoed, count(DISTINCT CASE WHEN why IS NULL THEN trading_date END) AS dates, count(DISTINCT CASE WHEN why IS NULL THEN ticker END) AS tickers, min(CASE WHEN why IS NULL THEN trading_date END) AS first_date, max(CASE WHEN why IS NULL THEN trading_date END) AS last_date, round(avg(CASE WHEN why IS NULL THEN CAST(up AS INT) END), 6) AS prevalence FROM x WHERE c IS NOT NULL GROUP BY c"))
def _split_summary(spark, d):
    return rounded(dataset.split_summary(dataset.split(_bundle(spark, d), SPLIT), "up"))


@query(
    "d12_folds",
    with_(
        *_BUNDLE, "k AS (SELECT trading_date, row_number() OVER (ORDER BY trading_date DESC) - 1 AS k, lag(trading_date) OVER (ORDER BY trading_date) AS before FROM (SELECT DISTINCT trading_date FROM d))",
        "f AS (SELECT 3 - k // 20 AS fold, min(trading_date) AS a, max(trading_date) AS z, arg_min(before, trading_date) AS t FROM k WHERE k < 60 GROUP BY 1)",
        "m AS (SELECT fold, provider, ticker, trading_date, CASE WHEN trading_date < a AND target_end_date <= t THEN 'train' WHEN trading_date >= a AND target_end_date <= z THEN 'validation' END AS role FROM d JOIN f ON trading_date <= z)",
        select=f"SELECT CAST(fold AS INTEGER) AS fold, role, {KEYS} FROM m WHERE role IS NOT NULL",
    ),
)
def _folds(spark, d):
    return dataset.expanding_folds(_bundle(spark, d), 3, 20)


# --- evaluation: scores that any engine can make from the bars

_PRED = (
    BARS,
    f"s AS (SELECT {KEYS}, adjusted_close / lag(adjusted_close) {LAG} - 1 AS r1, lead(adjusted_close, 5) {LAG} / adjusted_close - 1 AS fr FROM b)",
    "p AS (SELECT provider, ticker, trading_date, CAST(fr > 0 AS INT) AS target, round(r1 / (1 + abs(r1)) / 2 + 0.5, 2) AS score, fr AS ranking_return FROM s WHERE r1 IS NOT NULL AND fr IS NOT NULL)",
)


def _predictions(spark, d) -> DataFrame:
    df = targets.add_forward_returns(cross_section.add_returns(bars_week(spark, d), (1,)), (5,)).filter("return_1d IS NOT NULL AND forward_return_5d IS NOT NULL")
    df = df.withColumn("score", F.round(F.col("return_1d") / (1 + F.abs("return_1d")) / 2 + 0.5, 2)).withColumn("target", F.col("forward_return_5d") > 0)
    return evaluation.predictions(df, "score", "target", "forward_return_5d")


@query("e04_random_score", with_(BARS, select=f"SELECT {KEYS}, (concat('0x', substr(sha256(concat_ws(chr(31), '7', provider, ticker, CAST(trading_date AS VARCHAR))), 1, 13))::BIGINT + 0.5) / 4503599627370496 AS score FROM b"))
def _random(spark, d):
    return bars_week(spark, d).select("provider", "ticker", "trading_date", evaluation.random_score(7, "provider", "ticker", "trading_date").alias("score"))


def _class_sql(by: str) -> str:
    w, key = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return with_(
        *_PRED, f"a AS (SELECT {key}score, sum(target) AS p, sum(1 - target) AS n, sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN score >= 0.5 THEN target ELSE 0 END) AS tpc, sum(-(target * ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, score))) + (1 - target) * ln(1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, score))))) AS loss, sum((score - target) * (score - target)) AS sq FROM p GROUP BY {key}score)",
        f"t AS (SELECT *, sum(p) OVER ({w}ORDER BY score DESC) AS tp, sum(n) OVER ({w}ORDER BY score DESC) AS fp, sum(p) OVER ({w.strip()}) AS pp, sum(n) OVER ({w.strip()}) AS nn FROM a)",
        "q AS (SELECT *, tp / (tp + fp) AS pr, tp / nullif(pp, 0) AS re FROM t)",
        f"l AS (SELECT *, lag(pr, 1, 1.0) OVER ({w}ORDER BY score DESC) AS pr0, lag(re, 1, 0.0) OVER ({w}ORDER BY score DESC) AS re0 FROM q)",
        select=f"SELECT {key}CAST(sum(p + n) AS BIGINT) AS rows, round(first(pp) / sum(p + n), 6) AS prevalence, CASE WHEN first(pp) > 0 THEN round(sum((re - re0) * pr), 6) END AS average_precision, CASE WHEN first(pp) > 0 THEN round(sum((re - re0) * (pr + pr0) / 2), 6) END AS pr_auc, CASE WHEN first(pp) > 0 AND first(nn) > 0 THEN round(sum(p * (nn - fp + n / 2)) / (first(pp) * first(nn)), 6) END AS roc_auc, CASE WHEN first(pp) > 0 AND first(nn) > 0 THEN round(sum(loss) / sum(p + n), 6) END AS log_loss, round(sum(sq) / sum(p + n), 6) AS brier, round(sum(tpc) / nullif(sum(c), 0), 6) AS precision, round(sum(tpc) / nullif(first(pp), 0), 6) AS recall FROM l" + (f" GROUP BY {by}" if by else ""),
    )


@query("e08_classification", _class_sql(""))
def _classification(spark, d):
    return rounded(evaluation.classification(_predictions(spark, d)))


@query("e12_classification_by_date", _class_sql("trading_date"))
def _classification_by_date(spark, d):
    return rounded(evaluation.classification(_predictions(spark, d), ("trading_date",)))


@query("e09_calibration", with_(*_PRED, "g AS (SELECT CAST(least(floor(score * 10), 9) + 1 AS INT) AS bin, count(*) AS n, avg(score) AS s, avg(target) AS t FROM p GROUP BY 1)", "v AS (SELECT CAST(unnest(range(1, 11)) AS INT) AS bin)", select="SELECT bin, (bin - 1) / 10 AS lower, bin / 10 AS upper, coalesce(n, 0) AS rows, round(s, 6) AS mean_score, round(t, 6) AS positive_rate FROM v LEFT JOIN g USING (bin)"))
def _calibration(spark, d):
    return rounded(evaluation.calibration(_predictions(spark, d)))


@query("e10_quantiles", with_(*_PRED, "q AS (SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY score, ticker) AS r, count(*) OVER (PARTITION BY trading_date) AS n FROM p)", "z AS (SELECT trading_date, CASE WHEN n = 1 THEN 5 ELSE CAST(1 + floor((r - 1) * 4 / (n - 1)) AS INT) END AS quantile, avg(ranking_return) AS r, avg(target) AS t, avg(score) AS s FROM q GROUP BY 1, 2)", select="SELECT quantile, count(*) AS dates, round(avg(s), 6) AS mean_score, round(avg(r), 6) AS mean_return, round(avg(t), 6) AS positive_rate FROM z GROUP BY quantile"))
def _quantiles(spark, d):
    return rounded(evaluation.quantile_table(_predictions(spark, d)))


_TOP = "t AS (SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY score DESC, ticker DESC) AS k FROM p)"


@query("e11_top_k", with_(*_PRED, _TOP, select="SELECT trading_date, count(*) AS rows, round(avg(ranking_return), 6) AS mean_return, round(avg(target), 6) AS positive_rate FROM t WHERE k <= 5 GROUP BY trading_date"))
def _top_k(spark, d):
    return rounded(evaluation.top_k(_predictions(spark, d), 5))


@query("e13_lift", with_(*_PRED, _TOP, "u AS (SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY (concat('0x', substr(sha256(concat_ws(chr(31), '0', provider, ticker, CAST(trading_date AS VARCHAR))), 1, 13))::BIGINT) DESC, ticker DESC) AS k FROM p)", "a AS (SELECT trading_date, avg(ranking_return) AS a FROM t WHERE k <= 5 GROUP BY 1)", "c AS (SELECT trading_date, avg(ranking_return) AS c FROM u WHERE k <= 5 GROUP BY 1)", select="SELECT count(*) AS dates, round(avg(a), 6) AS top_mean_return, round(avg(c), 6) AS random_mean_return, round(avg(a - c), 6) AS lift FROM a JOIN c USING (trading_date)"))
def _lift(spark, d):
    return rounded(evaluation.lift(_predictions(spark, d), 5))


def _ranks(by: str) -> str:
    return f"k AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0 AS x, rank() OVER (PARTITION BY {by} ORDER BY ranking_return) + (count(*) OVER (PARTITION BY {by}, ranking_return) - 1) / 2.0 AS y FROM p)"


@query("e12_spearman", with_(*_PRED, _ranks("trading_date"), select="SELECT trading_date, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN round(corr(x, y), 6) END AS spearman FROM k GROUP BY trading_date"))
def _spearman(spark, d):
    return rounded(evaluation.spearman(_predictions(spark, d), ("trading_date",)))


@query("e14_missingness", with_(*_BUNDLE, select="SELECT feature, missing, round(missing / n, 6) AS share FROM (SELECT 'return_1d' AS feature, count_if(return_1d IS NULL) AS missing, count(*) AS n FROM d UNION ALL SELECT 'return_5d', count_if(return_5d IS NULL), count(*) FROM d)"))
def _missing(spark, d):
    return rounded(evaluation.missingness(_bundle(spark, d), _FEATURES.outputs))


@query(
    "e15_report",
    with_(
        *_PRED, _ranks("trading_date"), _TOP, "sp AS (SELECT trading_date, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS s FROM k GROUP BY trading_date)",
        "tk AS (SELECT trading_date, avg(ranking_return) AS r, avg(target) AS h FROM t WHERE k <= 5 GROUP BY trading_date)",
        f"c AS ({_class_sql('')})", "y AS (SELECT count(*) AS dates, avg(s) AS s, avg(CAST(round(s, 12) > 0 AS INT)) AS pos, avg(r) AS r, avg(h) AS h FROM sp JOIN tk USING (trading_date))",
        select="SELECT c.*, dates, round(s, 6) AS mean_daily_spearman, round(pos, 6) AS positive_spearman_share, round(r, 6) AS mean_top_k_return, round(h, 6) AS mean_top_k_positive_rate, 'constant' AS model FROM c, y",
    ),
)
def _report(spark, d):
    return rounded(evaluation.evaluate(_predictions(spark, d), 5, context={"model": "constant"})["metrics"])


@query("e18_query_ids", with_(*_PRED, select="SELECT provider, ticker, trading_date, dense_rank() OVER (ORDER BY provider, trading_date) - 1 AS query_id FROM p"))
def _query_ids(spark, d):
    return evaluation.query_ids(_predictions(spark, d)).select("provider", "ticker", "trading_date", F.col("query_id").cast("long").alias("query_id"))


@query(
    "e19_ranking",
    with_(
        *_PRED, "g AS (SELECT *, greatest(ranking_return, 0) AS rel FROM p)",
        "o AS (SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY score DESC, ticker) AS kp, row_number() OVER (PARTITION BY trading_date ORDER BY rel DESC, ticker) AS ki FROM g)",
        "h AS (SELECT *, avg(CASE WHEN kp <= 10 THEN 1 / log2(kp + 1) ELSE 0 END) OVER (PARTITION BY trading_date, score) AS dc, CASE WHEN ki <= 10 THEN 1 / log2(ki + 1) ELSE 0 END AS ic FROM o)",
        _ranks("trading_date"), "s AS (SELECT trading_date, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS ric FROM k GROUP BY trading_date)".replace("s AS", "sp AS"),
        "z AS (SELECT trading_date, sum(dc * rel) / nullif(sum(ic * rel), 0) AS ndcg, avg(CASE WHEN kp <= 10 THEN ranking_return END) AS top FROM h GROUP BY trading_date)",
        select="SELECT 'tpch' AS provider, trading_date, round(ndcg, 6) AS ndcg, round(ric, 6) AS rank_ic, round(top, 6) AS top_k_mean_return FROM z JOIN sp USING (trading_date)",
    ),
)
def _ranking(spark, d):
    p = _predictions(spark, d).withColumn("rel", F.greatest("ranking_return", F.lit(0.0)))
    return rounded(evaluation.ranking_by_date(p, "rel"))


# --- models


def _parts(spark, d) -> DataFrame:
    """The split bundle, stored: fits read it a dozen times, the line items are read once."""
    return stored(dataset.split(stored(_bundle(spark, d), "bundle"), SPLIT), "parts")


@query("e01_preprocessing", with_(*_SPLIT, "t AS (SELECT return_1d, return_5d FROM x WHERE why IS NULL AND c = 'train')", "m AS (SELECT median(return_1d) AS m1, median(return_5d) AS m5 FROM t)", "f AS (SELECT coalesce(return_1d, m1) AS f1, coalesce(return_5d, m5) AS f5, m1, m5 FROM t, m)", select="SELECT 'return_1d' AS feature, round(first(m1), 6) AS median, round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS scale FROM f UNION ALL SELECT 'return_5d', round(first(m5), 6), round(avg(f5), 6), round(stddev_pop(f5), 6) FROM f"))
def _preprocess(spark, d):
    train = _parts(spark, d).filter("split = 'train'")
    p = models.Preprocessing.fit(train, list(_FEATURES.outputs))
    rows = [(c, p.medians[c], p.means[c], p.scales[c]) for c in _FEATURES.outputs]
    return rounded(spark.createDataFrame(rows, "feature string, median double, mean double, scale double"))


@query("e02_constant_prior", with_(*_SPLIT, "q AS (SELECT avg(CAST(up AS INT)) AS prior FROM x WHERE why IS NULL AND c = 'train')", select="SELECT x.provider, x.ticker, x.trading_date, round(prior, 6) AS score FROM x, q WHERE why IS NULL AND c = 'validation'"))
def _prior(spark, d):
    parts = _parts(spark, d)
    fitted = models.fit("constant_prior", parts.filter("split = 'train'"), _FEATURES.outputs, "up")
    return rounded(fitted.score(parts.filter("split = 'validation'")).select("provider", "ticker", "trading_date", "score"))


@query("e05_logistic_regression")
def _logistic(spark, d):
    parts = _parts(spark, d)
    fitted = models.fit("logistic_regression", parts.filter("split = 'train'"), _FEATURES.outputs, "up", penalty=0.1)
    return rounded(fitted.score(parts.filter("split = 'validation'")).select("provider", "ticker", "trading_date", "score"))


@query("e17_cross_validation")
def _cross_validation(spark, d):
    from barloom.plans.experiment import cross_validate

    return rounded(cross_validate(stored(_bundle(spark, d), "bundle"), _FEATURES.outputs, _TASK, "constant_prior", 3, 20))


# --- backtest and labelling


def _signals(spark, d) -> DataFrame:
    return trend.add_atr(bars_week(spark, d), 14).filter("atr IS NOT NULL").select("provider", "ticker", "trading_date", F.round(F.col("close") / F.col("high"), 6).alias("score"), "atr")


CASH = 10_000_000.0
RULES = {
    "tight": backtest.Rules(CASH, 0.02, minimum_score=0.9, stop_atr_multiple=0.5),
    "wide": backtest.Rules(CASH, 0.02, minimum_score=0.9, stop_atr_multiple=0.5, reward_risk_ratio=3.0, max_positions=10),
}


@query("k01_backtest")
def _backtest(spark, d):
    return rounded(backtest.run_backtest(bars_week(spark, d), _signals(spark, d), RULES))


@query("k02_candidates", with_(BARS, f"t AS (SELECT *, {TRUE_RANGE} AS tr FROM b)", ewm("a", "t", "tr", 1 / 14, 14), f"c AS (SELECT {KEYS}, round(close / high, 6) AS score, y AS atr FROM b JOIN a USING ({KEYS}) WHERE y > 0)", select=f"SELECT {KEYS}, score, row_number() OVER (PARTITION BY trading_date ORDER BY score DESC, provider, ticker) AS place FROM c WHERE score >= 0.9"))
def _candidates(spark, d):
    return backtest.ranked_candidates(_signals(spark, d), 0.9).select("provider", "ticker", "trading_date", "score", F.col("place").cast("long").alias("place"))


@query("k03_summary")
def _summary(spark, d):
    return rounded(backtest.summarize(backtest.run_backtest(bars_week(spark, d), _signals(spark, d), RULES), CASH))


@query("k04_violations", with_(BARS, select="SELECT 'signal_without_bar' AS kind, 0::BIGINT AS n UNION ALL SELECT 'invalid_bar', count_if(NOT (low > 0 AND open > 0 AND close > 0 AND high >= greatest(open, close) AND low <= least(open, close))) FROM b"))
def _violations(spark, d):
    return backtest.violations(bars_week(spark, d), _signals(spark, d))


@query("l04_windows", with_(BARS, f"n AS (SELECT *, row_number() OVER ({sql.P}) - 1 AS rn, count(*) OVER (PARTITION BY provider, ticker) AS n FROM b)", "f AS (SELECT provider, ticker, trading_date, rn FROM n WHERE rn % 15 = 0 AND rn + 30 + 10 <= n)", select="SELECT f.provider, f.ticker, CAST(f.rn // 15 AS INTEGER) AS \"window\", f.rn AS first_row, f.rn + 29 AS last_row, f.trading_date AS first_date, z.trading_date AS last_date FROM f JOIN n z ON z.provider = f.provider AND z.ticker = f.ticker AND z.rn = f.rn + 29"))
def _windows(spark, d):
    return labeling.plan_windows(bars_week(spark, d), 30, 15, 10)


@query("l03_committed_labels", with_(BARS, f"n AS (SELECT *, row_number() OVER ({sql.P}) - 1 AS rn, count(*) OVER (PARTITION BY provider, ticker) AS n FROM b)", select=f"SELECT 's' AS session_id, {KEYS}, CASE WHEN rn < 15 OR n < 55 THEN CAST(close > open AS INT) ELSE CAST(close < open AS INT) END AS label, CASE WHEN n < 55 THEN 1 ELSE 2 END AS windows FROM n WHERE (n >= 40 AND rn < 30) OR (n >= 55 AND rn < 45)"))
def _labels(spark, d):
    """Two windows of every ticker, labelled one after the other; each commit holds the labels and how far each ticker has come."""
    bars = bars_week(spark, d)
    windows, rows = labeling.plan_windows(bars, 30, 15, 10), bars.select("provider", "ticker", "trading_date", "open", "close")
    versions = Versions(spark, f"{stored_dir(spark)}/labels-{uuid.uuid4().hex}")
    for k, positive in enumerate((F.col("close") > F.col("open"), F.col("close") < F.col("open"))):
        w = windows.filter(F.col("window") == k).select("provider", "ticker", "first_date", "last_date")
        inside = rows.join(w, ["provider", "ticker"]).filter("trading_date BETWEEN first_date AND last_date").withColumn("session_id", F.lit("s"))
        labels = labeling.merge_labels(None, inside, inside.filter(positive), dt.datetime(2024, 1, 1 + k))
        progress = w.select(F.lit("s").alias("session_id"), "provider", "ticker", F.lit(k + 1).alias("windows"))

        def build(change, labels=labels, progress=progress):
            change.upsert("labels", labels, labeling.LABEL_KEY, "ticker")
            change.upsert("progress", progress, ("session_id", "provider", "ticker"))

        versions.commit(build)
    return versions.read("labels").drop("updated_at").join(versions.read("progress"), ["session_id", "provider", "ticker"])


@query("l06_forward_outcomes", with_(BARS, f"t AS (SELECT *, {TRUE_RANGE} AS tr FROM b)", ewm("a", "t", "tr", 1 / 14, 14), f"j AS (SELECT b.*, a.y AS atr, row_number() OVER (PARTITION BY b.provider, b.ticker ORDER BY b.trading_date) AS rn FROM b JOIN a USING ({KEYS}))", "h AS (SELECT unnest(range(1, 4)) AS h)", select="SELECT j.provider, j.ticker, j.trading_date, CAST(h AS INTEGER) AS horizon, round((e.close * 0.9975 - j.close * 1.0025) / (j.close * 1.0025), 6) AS net_return, round((e.close * 0.9975 - j.close * 1.0025) / j.atr, 6) AS net_atr, round((e.close * 0.9975 - j.close * 1.0025) / j.atr, 6) AS net_risk FROM j CROSS JOIN h LEFT JOIN j e ON e.provider = j.provider AND e.ticker = j.ticker AND e.rn = j.rn + h"))
def _outcomes(spark, d):
    return rounded(labeling.forward_outcomes(trend.add_atr(bars_week(spark, d)), 3))


@query("l07_risk_guide", with_(BARS, f"t AS (SELECT *, {TRUE_RANGE} AS tr FROM b)", ewm("a", "t", "tr", 1 / 14, 14), f"j AS (SELECT b.*, a.y AS atr FROM b JOIN a USING ({KEYS}))", select=f"SELECT {KEYS}, round(close - atr, 6) AS stop, round(close + 2 * atr, 6) AS target, coalesce(lead(trading_date, 10) {LAG}, max(trading_date) OVER (PARTITION BY provider, ticker)) AS end_date FROM j"))
def _guide(spark, d):
    return rounded(labeling.risk_guide(trend.add_atr(bars_week(spark, d)), 10))


@query("l09_heat_limit", with_(BARS, f"r AS (SELECT abs(close / lag(close) {LAG} - 1) AS x FROM b)", select='SELECT round(quantile_cont(x, 0.98), 6) AS "limit" FROM r'))
def _heat(spark, d):
    df = cross_section.add_returns(bars_week(spark, d), (1,), "close")
    return rounded(labeling.heat_limit(df, "return_1d"))


# --- the same in SQL


@query("q01_sql_functions", with_(BARS, f"p AS (SELECT *, lag(close) {LAG} AS pc FROM b)", select=f"SELECT {KEYS}, (high + low + close) / 3 AS typical, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, open * (adjusted_close / close) AS adj_open, (close - low) / nullif(high - low, 0) AS location, low > 0 AND open > 0 AND close > 0 AND high >= greatest(open, close) AND low <= least(open, close) AS valid FROM p"))
def _sql_functions(spark, d):
    surface.register(spark)
    return spark.sql(
        """SELECT provider, ticker, trading_date, typical_price(high, low, close) AS typical, true_range_of(high, low, lag(close) OVER w) AS tr,
        adjusted_price(open, close, adjusted_close) AS adj_open, close_location(high, low, close) AS location, valid_bar(open, high, low, close) AS valid
        FROM {bars} WINDOW w AS (PARTITION BY provider, ticker ORDER BY trading_date)""",
        bars=bars_week(spark, d),
    )


@query("q02_sql_ewm", with_(BARS, ewm("e", "b", "close", 0.1, 10), select=f"SELECT {KEYS}, round(y, 6) AS mean FROM e"))
def _sql_ewm(spark, d):
    surface.register(spark)
    rows = bars_week(spark, d).select("provider", "ticker", "trading_date", F.col("close").alias("x"))
    return rounded(spark.sql("SELECT * FROM ewm(TABLE({rows}) PARTITION BY (provider, ticker) ORDER BY (trading_date), 0.1D, 10)", rows=rows))


@query("q03_sql_zigzag")
def _sql_zigzag(spark, d):
    surface.register(spark)
    return rounded(spark.sql("SELECT * FROM zigzag(TABLE({bars}) PARTITION BY (provider, ticker) ORDER BY (trading_date), 5.0D, 10)", bars=bars_week(spark, d)))


@query("q04_sql_backtest")
def _sql_backtest(spark, d):
    surface.register(spark)
    rows = backtest._rows_of_runs(bars_week(spark, d), _signals(spark, d), RULES)
    rules = json.dumps({name: vars(r) for name, r in RULES.items()}).replace("{", "{{").replace("}", "}}")  # for the formatter
    return rounded(spark.sql(f"SELECT * FROM backtest(TABLE({{rows}}) PARTITION BY run ORDER BY (trading_date, provider, ticker), '{rules}')", rows=rows))


# --- studies


def ranking_samples(spark, d) -> DataFrame:
    """Samples of a ranking study: returns as features, graded relevance, percentile and market-relative return of the next five bars."""
    df = targets.add_forward_returns(cross_section.add_returns(bars_week(spark, d), (1, 2, 5, 10)), (5,))
    df = df.withColumn("target_end_date", lead("trading_date", 5)).filter("forward_return_5d IS NOT NULL")
    df = add_percentile(studies.relevance_by_cut(df, "forward_return_5d"), "forward_return_5d", "percentile", 1)
    return df.withColumn("relative_return", F.col("forward_return_5d") - F.avg("forward_return_5d").over(by_date()))


RANKERS = [boosting.RankerParams(trees=6, depth=3, learning_rate=0.3), boosting.RankerParams(trees=5, depth=2, learning_rate=0.3, subsample=0.8, colsample=0.75, alpha=0.1, lam=5.0, gamma=0.01)]


@query("n04_boosted_ranker")
def _ranker(spark, d):
    samples = stored(ranking_samples(spark, d), "samples")
    features = ["return_1d", "return_2d", "return_5d", "return_10d"]
    _, scored = boosting.tune(samples, dataset.expanding_folds(samples, 3, 20), features, "relevance", RANKERS)
    return rounded(boosting.tail_by_fold(scored, samples, "percentile", "relative_return"))


@query("n05_relevance", with_(*_PRED, "k AS (SELECT *, (rank() OVER (PARTITION BY trading_date ORDER BY ranking_return) + (count(*) OVER (PARTITION BY trading_date, ranking_return) - 1) / 2.0) / count(*) OVER (PARTITION BY trading_date) AS s FROM p)", select=f"SELECT {KEYS}, CAST(s > 0.5 AS INT) + CAST(s > 0.75 AS INT) + CAST(s > 0.9 AS INT) + CAST(s > 0.97 AS INT) AS relevance FROM k"))
def _relevance(spark, d):
    return studies.relevance_by_cut(_predictions(spark, d), "ranking_return").select("provider", "ticker", "trading_date", F.col("relevance").cast("int").alias("relevance"))


@query("n06_kendall", with_(*_PRED, "m AS (SELECT a.trading_date, sum(sign(a.score - c.score) * sign(a.ranking_return - c.ranking_return)) AS s, sum(abs(sign(a.score - c.score))) AS nx, sum(abs(sign(a.ranking_return - c.ranking_return))) AS ny FROM p a JOIN p c ON a.trading_date = c.trading_date AND a.ticker < c.ticker GROUP BY 1)", select="SELECT 'tpch' AS provider, trading_date, round(s / nullif(sqrt(nx * ny), 0), 6) AS kendall FROM m"))
def _kendall(spark, d):
    return rounded(studies.kendall_by_date(_predictions(spark, d)))


@query("n07_score_ties", with_(*_PRED, "m AS (SELECT *, max(score) OVER (PARTITION BY trading_date) AS top FROM p)", select="SELECT trading_date, count(*) AS rows, count(DISTINCT score) AS distinct_scores, count_if(score = top) AS top_rows, count(DISTINCT score) = 1 AS flat FROM m GROUP BY trading_date"))
def _ties(spark, d):
    return studies.score_ties(_predictions(spark, d))


@query("n08_regression", with_(*_PRED, select="SELECT count(*) AS rows, round(avg(abs(ranking_return - score)), 6) AS mae, round(sqrt(avg((ranking_return - score) ** 2)), 6) AS rmse, round(1 - sum((ranking_return - score) ** 2) / (var_pop(ranking_return) * count(*)), 6) AS r2, round(corr(score, ranking_return), 6) AS pearson FROM p"))
def _regression(spark, d):
    return rounded(studies.regression_metrics(_predictions(spark, d)))


@query("n09_top_bucket", with_(*_PRED, "t AS (SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY score DESC, ticker) AS k FROM p)", select="SELECT trading_date, round(avg(CASE WHEN k <= 5 THEN ranking_return END), 6) AS top_return, round(avg(ranking_return), 6) AS all_return, round(avg(CASE WHEN k <= 5 THEN ranking_return END) - avg(ranking_return), 6) AS spread FROM t GROUP BY trading_date HAVING count(DISTINCT score) > 1"))
def _bucket(spark, d):
    return rounded(studies.top_bucket(_predictions(spark, d), 5))


@query("n10_top_share", with_(*_PRED, "t AS (SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY score DESC, ticker) AS k, count(*) OVER (PARTITION BY trading_date) AS n FROM p)", select=f"SELECT {KEYS}, score FROM t WHERE k <= greatest(1, ceil(n * 0.1))"))
def _share(spark, d):
    return studies.top_share(_predictions(spark, d), 0.1).select("provider", "ticker", "trading_date", "score")


@query("n11_deciles", with_(*_PRED, "t AS (SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY score, ticker) AS r, count(*) OVER (PARTITION BY trading_date) AS n FROM p)", "z AS (SELECT trading_date, CASE WHEN n > 1 THEN CAST(greatest(1, ceil((r - 1) * 10.0 / (n - 1))) AS INT) ELSE 1 END AS decile, avg(ranking_return) AS m FROM t GROUP BY 1, 2)", select="SELECT decile, count(*) AS dates, round(avg(m), 6) AS mean_return FROM z GROUP BY decile"))
def _deciles(spark, d):
    return rounded(studies.deciles(_predictions(spark, d)))


_SPREADS = (*_PRED, "t AS (SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY score DESC, ticker) AS k FROM p)", "sp AS (SELECT trading_date, avg(CASE WHEN k <= 5 THEN ranking_return END) - avg(ranking_return) AS x FROM t GROUP BY trading_date HAVING count(DISTINCT score) > 1)")
_DRAW = "(concat('0x', substr(sha256(concat_ws(chr(31), {parts})), 1, 13))::BIGINT + 0.5) / 4503599627370496"


@query(
    "n12_bootstrap",
    with_(
        *_SPREADS, "n AS (SELECT x, row_number() OVER (ORDER BY trading_date) - 1 AS i, count(*) OVER () AS n FROM sp WHERE x IS NOT NULL)",
        "d AS (SELECT id % 500 AS b, id // 500 AS j FROM (SELECT unnest(range(500 * (SELECT max(n) FROM n))) AS id))",
        f"e AS (SELECT b, CAST(floor({_DRAW.format(parts="'0', CAST(b AS VARCHAR), CAST(j AS VARCHAR)")} * (SELECT max(n) FROM n)) AS BIGINT) AS i FROM d)",
        "m AS (SELECT b, avg(x) AS m FROM e JOIN n USING (i) GROUP BY b)",
        select="SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m",
    ),
)
def _bootstrap(spark, d):
    return rounded(studies.bootstrap_spreads(studies.top_bucket(_predictions(spark, d), 5)))


@query(
    "n13_permutation",
    with_(
        *_PRED, "o AS (SELECT avg(m) AS observed FROM (SELECT trading_date, avg(ranking_return) AS m FROM (SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY score DESC, ticker) AS k FROM p) WHERE k <= 5 GROUP BY 1))",
        "d AS (SELECT *, row_number() OVER (PARTITION BY b, trading_date ORDER BY sha256(concat_ws(chr(31), CAST(b AS VARCHAR), '0', provider, ticker, CAST(trading_date AS VARCHAR))), ticker) AS k FROM p, (SELECT unnest(range(50)) AS b))",
        "m AS (SELECT b, avg(m) AS m FROM (SELECT b, trading_date, avg(ranking_return) AS m FROM d WHERE k <= 5 GROUP BY 1, 2) GROUP BY b)",
        select="SELECT round(observed, 6) AS observed, round((1 + count_if(m >= observed)) / 51, 6) AS p_value FROM m, o GROUP BY observed",
    ),
)
def _permutation(spark, d):
    return rounded(studies.permutation_test(_predictions(spark, d), 5, 50))


@query("n14_short_horizon", with_(BARS, f"t AS (SELECT *, {TRUE_RANGE} AS tr FROM b)", ewm("a", "t", "tr", 1 / 14, 14), f"j AS (SELECT b.*, a.y / close AS sh, lead(close) OVER (PARTITION BY b.provider, b.ticker ORDER BY b.trading_date) / close - 1 AS raw FROM b JOIN a USING ({KEYS}))", select=f"SELECT {KEYS}, CASE WHEN abs(raw) <= 3 AND abs(raw / sh) <= 50 AND sh >= 1e-4 THEN round(raw, 6) END AS raw_return_1d, CASE WHEN abs(raw) <= 3 AND abs(raw / sh) <= 50 AND sh >= 1e-4 THEN round(raw / sh, 6) END AS atr_return_1d FROM j"))
def _short(spark, d):
    return out(studies.short_horizon_targets(trend.add_atr(bars_week(spark, d)), (1,)), "raw_return_1d", "atr_return_1d")


@query("x11_default_features")
def _default(spark, d):
    df = catalog.add_default_features(bars_week(spark, d))
    return out(df, *catalog.FEATURES.outputs)
