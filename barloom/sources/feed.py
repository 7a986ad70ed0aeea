"""Daily bars from a provider as a Spark data source, in batches and as a stream.

    spark.dataSource.register(DailyBars)
    spark.read.format("daily_bars").option("client", "...").option("tickers", "A,B").option("start", "2024-01-01").option("end", "2024-02-01").load()

A partition is a ticker and a range of dates, so tickers are downloaded by tasks side by side and a task that is lost asks again
for its range only. A ticker that fails doesn't stop the others: its partition returns one row with ``error`` set (``strict``
raises instead). The end is exclusive. As a stream, the offset is the first date not yet read; a restart goes on from the last committed
one; a batch is all that is new, in partitions of at most ``range_days`` dates of a ticker. Rows of a date may come again after a failure, so write them by key (``follow``
does, as committed versions).

A client is any ``module:name`` whose call with the options returns an object with ``fetch(ticker, start, end)`` (an Arrow table
of BARS' columns without ticker, or None) and ``last_date()`` (the newest date that it has, or None). ``folder`` is one: files
<ticker>.csv, or folders of CSV as Spark writes them by ticker, in a folder that all executors can open.
"""

from __future__ import annotations

import datetime as dt
import json
from importlib import import_module
from pathlib import Path
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

VALUES = ("open", "high", "low", "close", "adjusted_close", "dividends", "stock_splits")
BARS = StructType([StructField("ticker", StringType()), StructField("trading_date", DateType()), *[StructField(c, DoubleType()) for c in VALUES], StructField("volume", LongType()), StructField("error", StringType())])
_ARROW = pa.schema([("ticker", pa.string()), ("trading_date", pa.date32()), *[(c, pa.float64()) for c in VALUES], ("volume", pa.int64()), ("error", pa.string())])


class FolderClient:
    """Files of a folder instead of a provider."""

    def __init__(self, path: str):
        self.path = Path(path.removeprefix("file://").removeprefix("file:"))
        if not self.path.is_dir():
            raise FileNotFoundError(f"there is no folder {path}")

    def _tickers(self) -> dict[str, Path]:
        found = {p.stem: p for p in self.path.glob("*.csv")}
        return found | {unquote(p.name.removeprefix("ticker=")): p for p in self.path.iterdir() if p.is_dir()}

    def _files(self, ticker: str) -> list[Path]:
        at = self._tickers().get(ticker)
        return [] if at is None else [at] if at.is_file() else sorted(at.glob("*.csv"))

    def _table(self, ticker: str) -> pa.Table:
        from pyarrow import csv

        files = self._files(ticker)
        if not files:
            raise FileNotFoundError(f"the provider doesn't know {ticker}")
        kinds = {f.name: f.type for f in _ARROW if f.name != "error"}
        return pa.concat_tables([csv.read_csv(f, convert_options=csv.ConvertOptions(column_types=kinds)) for f in files], promote_options="default")

    def fetch(self, ticker: str, start: dt.date, end: dt.date) -> pa.Table | None:
        import pyarrow.compute as pc

        t = self._table(ticker)
        day = t.column("trading_date")
        return t.filter(pc.and_(pc.greater_equal(day, pa.scalar(start)), pc.less(day, pa.scalar(end))))

    def last_date(self) -> dt.date | None:
        """The newest date of any ticker, as the provider states it in last_date.txt, or else by the files themselves."""
        import pyarrow.compute as pc

        said = self.path / "last_date.txt"
        if said.exists():
            return dt.date.fromisoformat(said.read_text().strip())
        return max((d for n in self._tickers() if (d := pc.max(self._table(n).column("trading_date")).as_py())), default=None)


def folder(options: dict) -> FolderClient:
    return FolderClient(options["path"])


def _date(options: dict, name: str) -> dt.date:
    if not options.get(name):
        raise ValueError(f"the option {name} is missing")
    return dt.date.fromisoformat(options[name])


class Range(InputPartition):
    def __init__(self, ticker: str, start: dt.date, end: dt.date):
        super().__init__((ticker, start, end))
        self.ticker, self.start, self.end = ticker, start, end


class _Feed:
    """What both readers share: options, partitions, and reading one of them."""

    def __init__(self, options):
        self.options = {k.lower(): v for k, v in dict(options).items()}
        self.tickers = list(dict.fromkeys(t.strip() for t in self.options.get("tickers", "").split(",") if t.strip()))
        self.strict = self.options.get("strict", "false").lower() == "true"
        self.days = int(self.options.get("range_days", "3650"))
        if not self.tickers or self.days < 1:
            raise ValueError("tickers must name at least one, and range_days must be positive")

    def client(self):
        module, _, name = self.options.get("client", f"{__name__}:folder").partition(":")
        return getattr(import_module(module), name)(self.options)

    def ranges(self, start: dt.date, end: dt.date) -> list[Range]:
        if start > end:
            raise ValueError(f"start {start} is after end {end}")
        cuts = [start + dt.timedelta(days=d) for d in range(0, (end - start).days, self.days)]
        return [Range(t, a, min(end, a + dt.timedelta(days=self.days))) for t in self.tickers for a in cuts]

    def rows(self, part: Range):
        try:
            got = self.client().fetch(part.ticker, part.start, part.end)
        except Exception as e:
            if self.strict:
                raise
            columns = {f.name: [None] for f in _ARROW} | {"ticker": [part.ticker], "trading_date": [part.start], "error": [f"{type(e).__name__}: {e}"]}
            yield pa.RecordBatch.from_pydict(columns, schema=_ARROW)
            return
        if got is not None and got.num_rows:
            own = {"ticker": pa.array([part.ticker] * got.num_rows, pa.string()), "error": pa.nulls(got.num_rows, pa.string())}
            columns = [own[f.name] if f.name in own else got.column(f.name).cast(f.type).combine_chunks() if f.name in got.column_names else pa.nulls(got.num_rows, f.type) for f in _ARROW]
            yield from pa.table(columns, schema=_ARROW).to_batches(max_chunksize=10_000)


class _BatchReader(_Feed, DataSourceReader):
    def partitions(self):
        return self.ranges(_date(self.options, "start"), _date(self.options, "end")) or [Range(self.tickers[0], dt.date.min, dt.date.min)]

    def read(self, partition):
        if partition.start < partition.end:
            yield from self.rows(partition)


class _StreamReader(_Feed, DataSourceStreamReader):
    def initialOffset(self):
        return {"next": _date(self.options, "start").isoformat()}

    def latestOffset(self):
        """The day after the newest that the client has."""
        last = self.client().last_date()
        return self.initialOffset() if last is None else {"next": max(_date(self.options, "start"), last + dt.timedelta(days=1)).isoformat()}

    def partitions(self, start, end):
        a, z = (dt.date.fromisoformat(x["next"]) for x in (start, end))
        return self.ranges(a, z) if a < z else []

    def read(self, partition):
        yield from self.rows(partition)


class DailyBars(DataSource):
    """Options: tickers (comma between), start; end (batch); client or path; range_days, strict."""

    @classmethod
    def name(cls):
        return "daily_bars"

    def schema(self):
        return BARS

    def reader(self, schema):
        return _BatchReader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def downloaded(spark: SparkSession, tickers, start: dt.date, end: dt.date, **options) -> DataFrame:
    """One row a ticker and date, and one with error for each range that failed."""
    spark.dataSource.register(DailyBars)
    named = {k: str(v) for k, v in options.items()} | {"tickers": ",".join(tickers), "start": start.isoformat(), "end": end.isoformat()}
    return spark.read.format("daily_bars").options(**named).load()


def as_bronze(df: DataFrame, provider: str, request_id: str, fetched_at: dt.datetime) -> DataFrame:
    """The rows without error, as rows of the bronze table."""
    return df.filter("error IS NULL").drop("error").withColumns({"provider": F.lit(provider), "fetched_at": F.lit(fetched_at), "request_id": F.lit(request_id)})


def failures(df: DataFrame) -> DataFrame:
    """(ticker, start, error) of the ranges that failed."""
    return df.filter("error IS NOT NULL").select("ticker", F.col("trading_date").alias("start"), "error")


def planned(spark: SparkSession, plan: DataFrame, **options) -> DataFrame:
    """Downloads an update plan (ticker, start_date, end_date). Tickers with the same dates share a read; the plan has a row a ticker."""
    groups = plan.groupBy("start_date", "end_date").agg(F.array_sort(F.collect_list("ticker")).alias("tickers")).collect()
    out = spark.createDataFrame([], BARS)
    for g in groups:
        out = out.unionByName(downloaded(spark, g["tickers"], g["start_date"], g["end_date"], **options))
    return out


def follow(spark: SparkSession, store, tickers, start: dt.date, provider: str, checkpoint: str, table: str = "bars", part: str = "date_format(trading_date, 'yyyy-MM-dd')", **options):
    """Reads all that is new as a stream and commits every batch by key; what failed goes to the table <table>_failures. Returns
    the query, which ends when nothing is left; call it again to go on from where it stopped."""
    from barloom.sources.bars import KEYS, upsert

    spark.dataSource.register(DailyBars)
    named = {k: str(v) for k, v in options.items()} | {"tickers": ",".join(tickers), "start": start.isoformat()}

    def write(batch: DataFrame, batch_id: int) -> None:
        # the time of the batch is part of what it writes, so that a batch that is run again writes the same keys
        rows = batch.persist()
        try:
            new = upsert(None, as_bronze(rows, provider, f"batch-{batch_id}", dt.datetime.now(dt.UTC).replace(tzinfo=None)))
            wrong = failures(rows).withColumn("batch", F.lit(batch_id).cast("long"))

            def build(change) -> None:
                change.upsert(table, new, KEYS, part)
                change.upsert(f"{table}_failures", wrong, ("ticker", "start", "batch"), "cast(batch AS string)")

            store.commit(build, json.dumps({"batch": batch_id}))
        finally:
            rows.unpersist()

    stream = spark.readStream.format("daily_bars").options(**named).load()
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
