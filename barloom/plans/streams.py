"""The streaming operators run over the events table as a bounded stream (available now), and held against the table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.functions.stored import stored_dir
from barloom.plans import sql
from barloom.plans.indicators import SQL as INDICATORS
from barloom.sources.versions import Versions
from barloom.streaming import bars, features

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _hour_bars(spark, d):
    """The events as a table, by the same function that the stream uses."""
    df = bars.event_bars(spark.read.parquet(f"{d}/events.parquet"))
    return df.select("ticker", "trading_date", "open", "high", "low", "close", "volume")


QUERIES["s01_event_bars"] = _hour_bars
SQL["s01_event_bars"] = "SELECT event_type AS ticker, time_bucket(INTERVAL 1 hour, ts) AS trading_date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2"


def _streamed_bars(spark, d):
    """The same from a stream: all that is there, in complete mode; each batch's windows replace the table as one committed version,
    so a reader sees a whole batch at any time."""
    out = f"{stored_dir(spark)}/bars-{uuid.uuid4().hex}"
    events, table = spark.readStream.schema(bars.EVENTS).parquet(d + "/events.parquet*"), Versions(spark, out)
    keep = lambda batch, k: table.commit(lambda change: change.replace("bars", batch), f"batch {k}")
    stream = bars.event_bars(events).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/_state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return table.read("bars").select("ticker", "trading_date", "open", "high", "low", "close", "volume")


QUERIES["s02_streamed_bars"] = _streamed_bars
SQL["s02_streamed_bars"] = SQL["s01_event_bars"]


def _sessions(spark, d):
    df = bars.sessions(spark.read.parquet(f"{d}/events.parquet"))
    return df.select("user_id", "start", "events", F.round("value", 4).alias("value"))


QUERIES["s03_sessions"] = _sessions
SQL["s03_sessions"] = """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
SELECT user_id, min(ts) AS start, count(*) AS events, round(sum(value), 4) AS value FROM s GROUP BY user_id, k"""


def _streamed_features(spark, d):
    """Hourly bars of the events as a stream of files; what the watermark has passed by the end comes out."""
    root = f"{stored_dir(spark)}/features-{uuid.uuid4().hex}"
    hours = bars.event_bars(spark.read.parquet(f"{d}/events.parquet"))
    hours = hours.withColumn("trading_date", F.col("trading_date").cast("timestamp"))
    hours.repartition("ticker").write.parquet(f"{root}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    features.state_store(spark)
    try:
        stream = features.stateful_features(spark.readStream.schema(hours.schema).parquet(f"{root}/in"), "6 hours")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    finally:
        spark.conf.set(key, before)
    rounded = [F.round(c, 6).alias(c) for c in features.ADX]
    return spark.read.schema(stream.schema).parquet(f"{root}/out").select("provider", "ticker", "trading_date", "direction_run", *rounded)


QUERIES["s04_streamed_features"] = _streamed_features
_ADX = INDICATORS["m09_adx"].replace(sql.BARS, sql.HOURS)
SQL["s04_streamed_features"] = f"""WITH {sql.HOURS}, adx AS ({_ADX}),
d AS (SELECT {sql.KEYS}, CAST(sign(close - open) AS INT) AS dir FROM b),
n AS (SELECT *, CASE WHEN dir <> 0 AND dir = lag(dir) {sql.LAG} THEN 0 ELSE 1 END AS new FROM d),
r AS (SELECT *, sum(new) {sql.LAG} AS run FROM n),
f AS (SELECT {sql.KEYS}, count(*) OVER (PARTITION BY provider, ticker, run ORDER BY trading_date ROWS UNBOUNDED PRECEDING) * dir AS direction_run FROM r)
SELECT {sql.KEYS}, CAST(direction_run AS BIGINT) AS direction_run, adx, plus_di, minus_di FROM f JOIN adx USING ({sql.KEYS})
WHERE trading_date <= (SELECT max(trading_date) FROM b) - INTERVAL 6 hours"""
