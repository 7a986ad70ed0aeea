"""Experiments: a spec with a digest, one fit scored on validation (and on the test only when asked), and cross-validation."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.stored import stored
from barloom.operators import evaluation, models, quality
from barloom.operators.dataset import KEYS, DatasetSpec, SplitSpec, check_bundle, construct, expanding_folds, manifest, scope_violations, split, split_summary
from barloom.plans.contracts import Task, digest
from barloom.sources.bars import load_daily_prices
from barloom.sources.sinks import RunLog, write_json, write_report


@dataclass(frozen=True)
class ExperimentSpec:
    dataset: DatasetSpec
    split: SplitSpec
    model_type: str
    parameters: dict = field(default_factory=dict)
    feature_columns: tuple[str, ...] | None = None
    threshold: float = 0.5

    def columns(self) -> tuple[str, ...]:
        every = self.dataset.features.outputs
        if self.feature_columns is None:
            return every
        if unknown := [c for c in self.feature_columns if c not in every]:
            raise ValueError(f"the set has no {unknown}")
        return self.feature_columns

    def digest(self) -> str:
        return digest({"dataset": self.dataset.digest(), "split": vars(self.split), "model": [self.model_type, self.parameters], "features": self.columns(), "threshold": self.threshold})


@dataclass
class Result:
    digest: str
    fitted: models.Fitted
    predictions: DataFrame
    metrics: DataFrame


def eligibility_at(prices: DataFrame, spec: DatasetSpec, cutoff: dt.date | str | None = None, thresholds: quality.Thresholds | None = None) -> DataFrame:
    """(ticker, ok, reasons) of the spec's tickers by what was known at the cutoff (the spec's end): later bars don't count."""
    wanted = prices.sparkSession.createDataFrame([(t,) for t in spec.universe.tickers], "ticker string")
    return quality.training_eligibility(prices, wanted, cutoff or spec.end_date, spec.universe.provider, thresholds or quality.Thresholds())


def build_dataset(bronze: DataFrame, spec: DatasetSpec, eligibility: DataFrame | None = None, cutoff: dt.date | str | None = None, thresholds: quality.Thresholds | None = None) -> DataFrame:
    """Scan what the spec names, refuse what is outside it, build the bundle and validate it.

    Which tickers are eligible is given, or else, with a cutoff, derived from their bars up to it; without either all are.
    """
    prices = load_daily_prices(bronze, spec.universe.provider, list(spec.universe.tickers), spec.start_date, spec.end_date)
    if wrong := [tuple(r) for r in scope_violations(prices, spec.universe, spec.start_date, spec.end_date).limit(20).collect()]:
        raise ValueError(f"the prices don't fit the spec: {wrong}")
    if eligibility is None and cutoff is not None:
        eligibility = eligibility_at(prices, spec, cutoff, thresholds)
    return check_bundle(construct(prices, spec.features, spec.targets, spec.task, eligibility), spec.features, spec.targets, spec.task, spec.end_date)


def fit_and_score(spec: ExperimentSpec, bundle: DataFrame, ranking_return: str | None = None, open_test: bool = False) -> Result:
    """Fit on the train split, score validation, and the test only when asked."""
    data = spec.dataset
    usable = bundle.filter("eligible")
    fitted = models.fit(spec.model_type, usable.filter("split = 'train'"), spec.columns(), data.task.column, **spec.parameters)
    wanted = ["validation", *(["test"] if open_test else [])]
    scored = fitted.score(usable.filter(F.col("split").isin(*wanted)))
    p = evaluation.predictions(scored, "score", data.task.column, ranking_return, spec.threshold).join(scored.select(*KEYS, "split"), list(KEYS))
    return Result(spec.digest(), fitted, p, evaluation.classification(p, ("split",)))


def run(spec: ExperimentSpec, prices: DataFrame, eligibility: DataFrame | None = None, ranking_return: str | None = None, open_test: bool = False) -> Result:
    """Build the dataset, split it, fit on train, score and evaluate. The bundle is kept while the model reads it again."""
    data = spec.dataset
    bundle = stored(split(construct(prices, data.features, data.targets, data.task, eligibility), spec.split), "bundle")
    return fit_and_score(spec, bundle, ranking_return, open_test)


def run_experiment(
    spec: ExperimentSpec, bronze: DataFrame, root: str, eligibility: DataFrame | None = None, ranking_return: str | None = None, open_test: bool = False, expected_digest: str | None = None, k: int = 5
) -> Result:
    """One call: dataset from the bronze table, fit, scores, every table of the evaluation, artifacts and run log under root.

    root gets model.json, manifest.json, splits, run.json and a folder a split (summary.json, tables, predictions). A spec whose digest
    isn't the expected one is refused before anything is read.
    """
    if expected_digest is not None and expected_digest != spec.digest():
        raise ValueError(f"the spec's digest is {spec.digest()}, not {expected_digest}")
    spark, data = bronze.sparkSession, spec.dataset
    bundle = split(build_dataset(bronze, data, eligibility), spec.split).persist()
    try:
        out = fit_and_score(spec, bundle, ranking_return, open_test)
        prior = out.fitted.preprocessing
        write_json(spark, f"{root}/model.json", {"type": out.fitted.model_type, "parameters": out.fitted.parameters, "preprocessing": vars(prior) if prior else None})
        write_json(spark, f"{root}/manifest.json", manifest(bundle, data.features, data.task))
        split_summary(bundle, data.task.column).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/splits")
        log = RunLog(spark, root).put("params", model_type=spec.model_type, threshold=spec.threshold, **spec.parameters).put("tags", digest=out.digest, dataset=data.digest())
        for name in ("validation", *(["test"] if open_test else [])):
            p = out.predictions.filter(F.col("split") == name).drop("split").persist()
            try:
                context = {"split": name, "model_type": spec.model_type, "target": data.task.column, "experiment": out.digest}
                tables = evaluation.evaluate(p, k, threshold=spec.threshold, features=bundle, feature_columns=spec.columns(), context=context)
                metrics = tables.pop("metrics")
                write_report(f"{root}/{name}", metrics, tables, p)
                log.put("metrics", **{f"{name}_{c}": v for c, v in metrics.first().asDict().items() if v is not None})
            finally:
                p.unpersist()
        log.close()
    finally:
        bundle.unpersist()
    return out


def cross_validate(samples: DataFrame, features, task: Task, model_type: str, folds: int, validation_sessions: int, **parameters) -> DataFrame:
    """(fold, role, precision, recall, roc_auc, rows): a fit a fold, scored on its own rows and on its validation rows."""
    roles = expanding_folds(samples, folds, validation_sessions)
    joined = stored(samples.join(roles, list(KEYS)), "folds")
    out = None
    for fold in range(1, folds + 1):
        own = joined.filter(F.col("fold") == fold)
        fitted = models.fit(model_type, own.filter("role = 'train'"), features, task.column, **parameters)
        scored = fitted.score(own)
        p = evaluation.predictions(scored, "score", task.column, None).join(scored.select(*KEYS, "role"), list(KEYS))
        m = evaluation.classification(p, ("role",)).select(F.lit(fold).alias("fold"), "role", "precision", "recall", "roc_auc", "rows")
        out = m if out is None else out.unionByName(m)
    return out
