"""Datasets for learning: features and targets of a window, temporal splits with purge and embargo, expanding folds."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import ORDER, lead
from barloom.plans.contracts import BlockSet, Task, digest
from barloom.sources.bars import as_date

KEYS = ("provider", "ticker", "trading_date")


@dataclass(frozen=True)
class Universe:
    provider: str
    tickers: tuple[str, ...]

    def __post_init__(self):
        object.__setattr__(self, "tickers", tuple(sorted(set(self.tickers))))


@dataclass(frozen=True)
class DatasetSpec:
    universe: Universe
    start_date: dt.date
    end_date: dt.date
    features: BlockSet
    targets: BlockSet
    task: Task

    def digest(self) -> str:
        return digest({"universe": vars(self.universe), "window": [self.start_date, self.end_date], "features": self.features.manifest(), "targets": self.targets.manifest(), "task": vars(self.task)})


def construct(prices: DataFrame, features: BlockSet, targets: BlockSet, task: Task, eligibility: DataFrame | None = None) -> DataFrame:
    """Keys, features, targets and sample columns (target_end_date, eligible, reasons); rows without the task's target go.

    Rows are filtered after all windows, so nothing is computed on a shortened history. Rows of tickers that aren't eligible
    stay, and say so. eligibility has a row a ticker (it is as small as the universe).
    """
    df = targets.apply(features.apply(prices))
    end = F.col(task.end_date_column) if task.end_date_column else lead(ORDER, task.horizon)
    df = df.withColumn("target_end_date", end)
    if eligibility is not None:
        state = eligibility.select("ticker", F.col("ok").alias("eligible"), "reasons")
        df = df.join(state, "ticker", "left")
    else:
        df = df.withColumn("eligible", F.lit(True)).withColumn("reasons", F.array().cast("array<string>"))
    keep = [*KEYS, *features.outputs, *targets.outputs, "target_end_date", "eligible", "reasons"]
    return df.filter(F.col(task.column).isNotNull()).select(*keep)


def scope_violations(prices: DataFrame, universe: Universe, start: dt.date, end: dt.date) -> DataFrame:
    """(kind, value) of what doesn't fit: other providers, tickers too many or missing, dates outside."""
    spark = prices.sparkSession
    wanted = spark.createDataFrame([(t,) for t in universe.tickers], "ticker string")
    there = prices.select("ticker").distinct()
    rows = prices.filter(F.col("provider") != universe.provider).select(F.lit("provider").alias("kind"), F.col("provider").alias("value")).distinct()
    rows = rows.unionByName(there.join(wanted, "ticker", "left_anti").select(F.lit("unexpected_ticker").alias("kind"), F.col("ticker").alias("value")))
    rows = rows.unionByName(wanted.join(there, "ticker", "left_anti").select(F.lit("missing_ticker").alias("kind"), F.col("ticker").alias("value")))
    outside = prices.filter(~F.col(ORDER).between(F.lit(start), F.lit(end))).select(F.lit("date").alias("kind"), F.col(ORDER).cast("string").alias("value"))
    return rows.unionByName(outside.distinct())


def bundle_violations(bundle: DataFrame, features: BlockSet, targets: BlockSet, task: Task, data_end: dt.date | None = None) -> dict[str, int]:
    """What a bundle may not have, counted in one pass over it (and one over its keys): repeated keys, no target, a target that
    ends on or before its signal date, or after the data; and whether columns are missing or in another order."""
    want = [*KEYS, *features.outputs, *targets.outputs, "target_end_date", "eligible", "reasons"]
    out = {"columns": int(bundle.columns[: len(want)] != want)}
    if out["columns"]:
        return out
    late = F.col("target_end_date") > F.lit(as_date(data_end)) if data_end is not None else F.lit(False)
    counts = bundle.agg(
        F.count_if(F.col(task.column).isNull()).alias("missing_target"), F.count_if(F.col("target_end_date") <= F.col(ORDER)).alias("ends_before_signal"),
        F.count_if(late).alias("ends_after_data"), F.count_if(F.array_contains(F.array(*[F.col(k).isNull() for k in KEYS]), True)).alias("missing_key"),
    ).first()
    out |= counts.asDict()
    return out | {"repeated_key": bundle.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").count()}


def check_bundle(bundle: DataFrame, features: BlockSet, targets: BlockSet, task: Task, data_end: dt.date | None = None) -> DataFrame:
    """bundle, if there is nothing wrong with it."""
    if found := {k: n for k, n in bundle_violations(bundle, features, targets, task, data_end).items() if n}:
        raise ValueError(f"the bundle is not valid: {found}")
    return bundle


def tabular(bundle: DataFrame, features, target: str) -> DataFrame:
    """(keys, x array<double> in the order of features, y double, target_end_date): rows for a learner that takes vectors."""
    if unknown := [c for c in (*features, target) if c not in bundle.columns]:
        raise ValueError(f"the bundle has no {unknown}")
    x = F.array(*[F.col(c).cast("double") for c in features])
    return bundle.select(*KEYS, x.alias("x"), F.col(target).cast("double").alias("y"), "target_end_date")


def manifest(bundle: DataFrame, features: BlockSet, task: Task) -> dict:
    """Row count, date ranges, missing values by feature, and the target's classes or moments: one pass."""
    rows = bundle.agg(
        F.count(F.lit(1)).alias("rows"), F.min(ORDER).alias("first_date"), F.max(ORDER).alias("last_date"), F.max("target_end_date").alias("last_target_date"),
        F.count_distinct("ticker").alias("tickers"), *[F.count_if(F.col(c).isNull()).alias(f"missing__{c}") for c in features.outputs],
    ).first().asDict()
    out = {k: v for k, v in rows.items() if not k.startswith("missing__")}
    out["missing"] = {k.removeprefix("missing__"): v for k, v in rows.items() if k.startswith("missing__")}
    y = F.col(task.column)
    if task.kind == "number":
        out["target"] = bundle.agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max")).first().asDict()
    else:
        out["target"] = {str(r[0]): r[1] for r in bundle.groupBy(y.cast("string")).count().collect()}
    return out


@dataclass(frozen=True)
class SplitSpec:
    """Inclusive date ranges, in order, and the number of signal dates to leave out at the end of all but the last."""

    train: tuple[dt.date, dt.date]
    validation: tuple[dt.date, dt.date]
    test: tuple[dt.date, dt.date]
    embargo: int = 0

    def ranges(self) -> dict[str, tuple[dt.date, dt.date]]:
        return {n: tuple(map(as_date, getattr(self, n))) for n in ("train", "validation", "test")}

    def __post_init__(self):
        dates = [d for r in self.ranges().values() for d in r]
        if any(a > b for a, b in zip(dates, dates[1:], strict=False)) or self.embargo < 0:
            raise ValueError("ranges must follow one another; the embargo must not be negative")


def split(samples: DataFrame, spec: SplitSpec) -> DataFrame:
    """samples with split and split_exclusion_reason: outside, purge (the target ends after its range) or embargo."""
    where, end = F.lit(None).cast("string"), F.lit(None).cast("date")
    for name, (a, b) in spec.ranges().items():
        inside = F.col(ORDER).between(F.lit(a), F.lit(b))
        where, end = F.when(inside, name).otherwise(where), F.when(inside, F.lit(b)).otherwise(end)
    df = samples.withColumn("__in", where).withColumn("__purged", F.coalesce(F.col("target_end_date") > end, F.lit(True)) & F.col("__in").isNotNull())
    # embargo: the last dates with a surviving row in each range; dates are few, so they are ranked apart from the rows
    dates = df.filter(F.col("__in").isin("train", "validation") & ~F.col("__purged")).select("__in", ORDER).distinct()
    last = dates.withColumn("__k", F.row_number().over(Window.partitionBy("__in").orderBy(F.desc(ORDER)))).filter(F.col("__k") <= spec.embargo)
    df = df.join(last.select("__in", ORDER, F.lit(True).alias("__embargo")), ["__in", ORDER], "left")
    reason = F.when(F.col("__in").isNull(), "outside").when(F.col("__purged"), "purge").when(F.col("__embargo"), "embargo")
    df = df.withColumn("split_exclusion_reason", reason).withColumn("split", F.when(reason.isNull(), F.col("__in")))
    return df.withColumn("split_candidate", F.col("__in")).select(*samples.columns, "split", "split_candidate", "split_exclusion_reason")


def split_summary(assigned: DataFrame, target: str) -> DataFrame:
    """A row a split: candidates, assigned, purged, embargoed, distinct dates and tickers, range and prevalence."""
    on = F.col("split").isNotNull()
    return assigned.filter("split_candidate IS NOT NULL").groupBy(F.col("split_candidate").alias("split")).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(on).alias("assigned"), F.count_if(F.col("split_exclusion_reason") == "purge").alias("purged"),
        F.count_if(F.col("split_exclusion_reason") == "embargo").alias("embargoed"), F.count_distinct(F.when(on, F.col(ORDER))).alias("dates"),
        F.count_distinct(F.when(on, F.col("ticker"))).alias("tickers"), F.min(F.when(on, F.col(ORDER))).alias("first_date"), F.max(F.when(on, F.col(ORDER))).alias("last_date"),
        F.avg(F.when(on, F.col(target).cast("double"))).alias("prevalence"),
    )


def expanding_folds(samples: DataFrame, folds: int, validation_sessions: int) -> DataFrame:
    """(fold, role, keys): the last folds * validation_sessions dates cut into validation blocks; all earlier dates train.

    Rows whose target ends after the first validation date (train) or the block's last date (validation) are purged. A row is
    repeated for the folds it is in; there are few folds.
    """
    dates = samples.select(ORDER).distinct()
    # dates, not rows, are ranked in one task
    ranked = dates.withColumn("__k", F.row_number().over(Window.orderBy(F.desc(ORDER))) - 1).withColumn("__before", F.lead(ORDER).over(Window.orderBy(F.desc(ORDER))))
    blocks = ranked.filter(F.col("__k") < folds * validation_sessions).withColumn("fold", F.lit(folds) - F.floor(F.col("__k") / validation_sessions))
    edges = blocks.groupBy("fold").agg(F.min(ORDER).alias("first"), F.max(ORDER).alias("last"), F.min_by("__before", ORDER).alias("train_end"))
    met = samples.join(F.broadcast(edges), F.col(ORDER) <= F.col("last"))  # ``folds`` rows
    role = F.when((F.col(ORDER) < F.col("first")) & (F.col("target_end_date") <= F.col("train_end")), "train")
    role = role.when((F.col(ORDER) >= F.col("first")) & (F.col("target_end_date") <= F.col("last")), "validation")
    return met.withColumn("role", role).filter("role IS NOT NULL").select(F.col("fold").cast("int").alias("fold"), "role", *KEYS)
