"""Price bars: the bronze table (scan, upsert, wide-to-long), and bars made from other tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, LongType, StringType, StructField, StructType, TimestampType

from barloom.sources.versions import Versions

KEYS = ("provider", "ticker", "trading_date")
PRICES = ("open", "high", "low", "close", "adjusted_close", "dividends", "stock_splits")
BRONZE = StructType(
    [
        StructField("provider", StringType(), False),
        StructField("ticker", StringType(), False),
        StructField("trading_date", DateType(), False),
        *(StructField(c, DecimalType(18, 6)) for c in PRICES),
        StructField("volume", LongType()),
        StructField("fetched_at", TimestampType(), False),
        StructField("request_id", StringType(), False),
    ]
)


def as_date(value: dt.date | str | None) -> dt.date | None:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def load_daily_prices(bronze: DataFrame, provider=None, tickers=None, start_date=None, end_date=None, columns=None) -> DataFrame:
    """Filtered, projected scan: both dates inclusive, keys first, prices as doubles; Parquet gets filters and columns."""
    if columns is not None and (unknown := [c for c in columns if c not in bronze.columns]):
        raise ValueError(f"unknown columns: {unknown}")
    df = bronze
    for name, values in (("provider", provider), ("ticker", tickers)):
        if values is not None:
            df = df.filter(F.col(name).isin([values] if isinstance(values, str) else list(values)))
    if start_date is not None:
        df = df.filter(F.col("trading_date") >= F.lit(as_date(start_date)))
    if end_date is not None:
        df = df.filter(F.col("trading_date") <= F.lit(as_date(end_date)))
    names = [*KEYS, *(c for c in (columns if columns is not None else df.columns) if c not in KEYS)]
    return coerce(df.select(*names))


def coerce(df: DataFrame) -> DataFrame:
    """Decimals become doubles, volume a nullable long."""
    cast = {f.name: F.col(f.name).cast("double") for f in df.schema.fields if isinstance(f.dataType, DecimalType)}
    if "volume" in df.columns:
        cast["volume"] = F.col("volume").cast("long")
    return df.withColumns(cast) if cast else df


def upsert(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """existing with the rows of incoming put in by key. Of rows of incoming with the same key, the one fetched last stays."""
    if missing := [f.name for f in BRONZE.fields if f.name not in incoming.columns]:
        raise ValueError(f"columns are missing: {missing}")
    new = incoming.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in BRONZE.fields])
    rest = [c for c in new.columns if c not in KEYS]
    new = new.groupBy(*KEYS).agg(F.max(F.struct("fetched_at", "request_id", *[c for c in rest if c not in ("fetched_at", "request_id")])).alias("r"))
    new = new.select(*KEYS, *[F.col(f"r.{c}").alias(c) for c in rest])
    if existing is None:
        return new
    return existing.join(new, list(KEYS), "left_anti").unionByName(new.select(*existing.columns))


def write_bronze(df: DataFrame, root: str) -> str:
    """Write a new version under root, clustered by instrument, and return its path; readers switch when told."""
    path = f"{root}/v-{uuid.uuid4().hex}"
    df.repartition("provider", "ticker").sortWithinPartitions(*KEYS).write.partitionBy("provider").parquet(path)
    return path


def commit_prices(store: Versions, incoming: DataFrame, table: str = "bars", part: str = "date_format(trading_date, 'yyyy-MM-dd')") -> int:
    """Upsert by key as one committed version: only the parts (by default, days) that incoming has rows of are read and written.
    Of rows of incoming with the same key, the one fetched last stays. Returns the version."""
    new = upsert(None, incoming)
    return store.commit(lambda change: change.upsert(table, new, KEYS, part), f"prices into {table}")


def normalize_wide(wide: DataFrame, provider: str, request_id: str, fetched_at, fields: dict[str, str], tickers: list[str]) -> DataFrame:
    """One row a date with columns '<ticker>|<field>' -> one row a ticker and date; rows without any value are dropped.

    fields: name in the download -> column of the bronze table.
    """
    parts = [
        F.struct(F.lit(t).alias("ticker"), *[(F.col(f"`{t}|{f}`") if f"{t}|{f}" in wide.columns else F.lit(None)).cast("double").alias(c) for f, c in fields.items()])
        for t in tickers
    ]
    long = wide.select("trading_date", F.explode(F.array(*parts)).alias("r")).select("trading_date", "r.*")
    long = long.na.drop("all", subset=list(fields.values()))
    return long.select(F.lit(provider).alias("provider"), "ticker", "trading_date", *fields.values(), F.lit(fetched_at).alias("fetched_at"), F.lit(request_id).alias("request_id"))


def bars_week(spark: SparkSession, sf_dir: str, ticker: str = "p_brand") -> DataFrame:
    """Weekly bars of line item prices by a column of part: open and close by a total order of the week's lines."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", ticker)
    price = F.col("l_extendedprice") / F.col("l_quantity")
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.lit("tpch").alias("provider"), F.col(ticker).alias("ticker"), F.date_trunc("week", "l_shipdate").cast("date").alias("trading_date"),
        price.cast("double").alias("p"), "l_quantity", (price * (1 - F.col("l_discount"))).cast("double").alias("a"), at.alias("at"),
    )
    return rows.groupBy("provider", "ticker", "trading_date").agg(
        F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"), F.max_by("a", "at").alias("adjusted_close"),
    )


def bars_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values by event type; the order column is a timestamp."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.lit("events").alias("provider"), F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("trading_date")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"),
        F.count(F.lit(1)).alias("volume"), F.max_by("value", "ts").alias("adjusted_close"),
    )
