"""Whole queries over the bars of a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.core import add_percentile
from barloom.operators.cross_section import add_returns
from barloom.sources.bars import bars_week


def flagship(spark: SparkSession, sf_dir: str, least: int = 2, k: int = 5) -> DataFrame:
    """The k tickers of each week with the highest percentile of the one-bar return."""
    df = add_percentile(add_returns(bars_week(spark, sf_dir), (1, 5)), "return_1d", "percentile", least)
    best = Window.partitionBy("provider", "trading_date").orderBy(F.desc("percentile"), "ticker")
    top = df.filter("percentile IS NOT NULL").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    return top.select("provider", "ticker", "trading_date", F.round("return_1d", 6).alias("return_1d"), F.round("return_5d", 6).alias("return_5d"), F.round("percentile", 6).alias("percentile"), F.col("place").cast("long").alias("place"))
