"""Artifacts of a run on a shared file system: tables as CSV or Parquet, summaries and manifests as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.plans.contracts import canonical


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """One file of canonical JSON, written by Spark, so path may be in any store that Spark knows."""
    spark.createDataFrame([(canonical(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_report(root: str, metrics: DataFrame, tables: dict[str, DataFrame], predictions: DataFrame | None = None) -> None:
    """summary.json, a folder of CSV for each table (reports are small), and the predictions compressed, in parallel."""
    row = metrics.first()
    write_json(metrics.sparkSession, f"{root}/summary.json", {k: v for k, v in row.asDict().items() if v is not None and v == v})
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/{name}")
    if predictions is not None:
        predictions.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{root}/predictions")


class RunLog:
    """Parameters, tags and finite metrics of a run, kept as JSON in its folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.parts = spark, root, {"params": {}, "tags": {}, "metrics": {}}

    def put(self, part: str, **values) -> RunLog:
        keep = (lambda v: isinstance(v, int | float) and v == v and abs(v) != float("inf")) if part == "metrics" else (lambda v: True)
        self.parts[part] |= {k: v for k, v in values.items() if keep(v)}
        return self

    def close(self) -> None:
        write_json(self.spark, f"{self.root}/run.json", self.parts)
