"""Bars stored so that windows by instrument need no shuffle: one sorted file a bucket of tickers.

Spark then plans ``partitionBy(provider, ticker).orderBy(trading_date)`` over the table without an exchange; with ``presorted`` also
without a sort, and a filter by ticker reads its bucket only. Rows of a bucket are in order of instrument and date, so minima and maxima of row groups let a filter by ticker or date skip
most of a file.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("provider", "ticker")
ORDER = "trading_date"


def store_bars(bars: DataFrame, table: str, buckets: int, path: str | None = None, rows_a_group: int | None = None) -> DataFrame:
    """Writes bars as a table of ``buckets`` files and reads it. Buckets: such that one holds what a task should read."""
    if buckets < 1:
        raise ValueError("buckets must be positive")
    spark = bars.sparkSession
    # dealt as the buckets are, so that each task writes one file of one bucket
    dealt = bars.repartition(buckets, "ticker").sortWithinPartitions(*KEYS, ORDER)
    writer = dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, "ticker").sortBy(*KEYS, ORDER)
    if path is not None:
        writer = writer.option("path", path)
    if rows_a_group is not None:
        writer = writer.option("parquet.block.row.count.limit", rows_a_group)
    writer.saveAsTable(table)
    return spark.table(table)


@contextmanager
def presorted(spark: SparkSession):
    """While it lasts, plans made from tables with one file a bucket rely on the files' order."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def files_by_bucket(table: DataFrame) -> dict[str, int]:
    """How many files each bucket has: one each, or the order within a bucket isn't that of a file. Looks at names only."""
    out: dict[str, int] = {}
    for name in table.inputFiles():  # as many as buckets
        bucket = name.rsplit("_", 1)[-1].split(".")[0]
        out[bucket] = out.get(bucket, 0) + 1
    return out


def part_of(table: DataFrame, tickers=None, first=None, last=None) -> DataFrame:
    """The rows of some tickers and dates; both filters reach the files."""
    if tickers is not None:
        table = table.filter(F.col("ticker").isin(list(tickers)))
    if first is not None:
        table = table.filter(F.col(ORDER) >= F.lit(first))
    if last is not None:
        table = table.filter(F.col(ORDER) <= F.lit(last))
    return table
