"""Bars and recursive means over streams of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def event_bars(events: DataFrame, every: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """Bars of a stream (or a table) by type and window; a window is final once the watermark has passed its end.

    Open and close go by (ts, event_id), so the order of arrival doesn't matter; events later than the watermark are
    dropped. ``late`` is None where the stream already has a watermark (after ``distinct_events``).
    """
    at = F.struct("ts", "event_id")
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    return rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume")
    ).select(F.lit("events").alias("provider"), F.col("event_type").alias("ticker"), F.col("w.start").alias("trading_date"), "open", "high", "low", "close", "volume")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users: runs of events with no longer pause than the gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running_ema(bars: DataFrame, length: int) -> DataFrame:
    """(ticker, trading_date, close, ema) from a stream of bars: the state of a ticker is its last mean and its count."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    alpha = 2.0 / (length + 1)

    def fold(key, batches, state):
        import pandas as pd

        mean, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("trading_date", kind="stable")
        out = []
        for at, close in zip(rows["trading_date"], rows["close"], strict=True):
            if close == close:
                mean = close if mean is None else (1 - alpha) * mean + alpha * close
                n += 1
            out.append((key[0], at, close, mean if n >= length else None))
        state.update((mean, n))
        yield pd.DataFrame(out, columns=["ticker", "trading_date", "close", "ema"])

    shape = "ticker string, trading_date timestamp, close double, ema double"
    return bars.groupBy("ticker").applyInPandasWithState(fold, shape, "mean double, n long", "append", GroupStateTimeout.NoTimeout)


def upsert_batches(write: Callable[[DataFrame], None], keys=("provider", "ticker", "trading_date")):
    """For foreachBatch: of the rows of a batch with a key, the one with the greatest volume (the fullest bar) is written."""

    def each(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in (*keys, "volume")]
        best = batch.groupBy(*keys).agg(F.max(F.struct("volume", *rest)).alias("r"))
        write(best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in ("volume", *rest)]))

    return each
