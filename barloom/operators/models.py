"""Baseline models: exact preprocessing, constant prior, random ranker, L2 logistic regression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.core import ORDER, finite
from barloom.functions.selection import exact_percentiles
from barloom.operators.evaluation import random_score


@dataclass
class Preprocessing:
    """Medians of the training rows for what is missing, then mean 0 and population deviation 1."""

    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, features) -> Preprocessing:
        x = {c: finite(F.col(c).cast("double")) for c in features}
        found = exact_percentiles(train, x, 0.5)
        medians = {c: 0.0 if found[c] is None else found[c] for c in features}
        filled = {c: F.coalesce(v, F.lit(medians[c])) for c, v in x.items()}
        row = train.agg(*[f(v).alias(f"{n}_{c}") for c, v in filled.items() for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return cls(medians, {c: row[f"m_{c}"] for c in features}, {c: row[f"s_{c}"] or 1.0 for c in features})

    def columns(self) -> dict[str, Column]:
        return {c: (F.coalesce(finite(F.col(c).cast("double")), F.lit(m)) - self.means[c]) / self.scales[c] for c, m in self.medians.items()}


@dataclass
class Fitted:
    """What a model type learned; ``score`` adds a column score."""

    model_type: str
    parameters: dict = field(default_factory=dict)
    preprocessing: Preprocessing | None = None

    def score(self, df: DataFrame) -> DataFrame:
        if self.model_type == "constant_prior":
            return df.withColumn("score", F.lit(self.parameters["prior"]))
        if self.model_type == "random_ranker":
            return df.withColumn("score", random_score(self.parameters["seed"], "provider", "ticker", ORDER))
        z = F.lit(self.parameters["intercept"])
        for c, x in self.preprocessing.columns().items():
            z = z + x * self.parameters["weights"][c]
        return df.withColumn("score", 1.0 / (1.0 + F.exp(-z)))


def fit(model_type: str, train: DataFrame, features, target: str, **parameters) -> Fitted:
    """Fit by type: constant_prior, random_ranker (seed), logistic_regression (penalty, max_iterations, tolerance)."""
    allowed = {"constant_prior": set(), "random_ranker": {"seed"}, "logistic_regression": {"penalty", "max_iterations", "tolerance"}}
    if model_type not in allowed:
        raise ValueError(f"model_type must be one of {sorted(allowed)}")
    if unknown := set(parameters) - allowed[model_type]:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    train = train.filter(F.col(target).isNotNull())
    if model_type == "constant_prior":
        return Fitted(model_type, {"prior": train.agg(F.avg(F.col(target).cast("double"))).first()[0]})
    if model_type == "random_ranker":
        return Fitted(model_type, {"seed": parameters.get("seed", 0)})
    return _logistic(train, list(features), target, **parameters)


def _logistic(train: DataFrame, features: list[str], target: str, penalty: float = 1.0, max_iterations: int = 1000, tolerance: float = 1e-8) -> Fitted:
    """Mean log loss + penalty / 2 * |w|^2 by L-BFGS; the intercept isn't penalised. Not converging is an error."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    scaled = Preprocessing.fit(train, features)
    x = train.select(F.col(target).cast("double").alias("label"), *[v.alias(c) for c, v in scaled.columns().items()])
    x = VectorAssembler(inputCols=features, outputCol="features").transform(x).select("label", "features").persist()
    try:
        model = LogisticRegression(regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=max_iterations, tol=tolerance).fit(x)
    finally:
        x.unpersist()
    if model.summary.totalIterations >= max_iterations:
        raise RuntimeError("the logistic regression did not converge")
    weights = dict(zip(features, (float(w) for w in model.coefficients), strict=True))
    return Fitted("logistic_regression", {"weights": weights, "intercept": float(model.intercept)}, scaled)
