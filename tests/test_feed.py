"""The data source of daily bars: batches, a failing ticker, a stream that is stopped and goes on."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.sources import feed
from barloom.sources.versions import Versions

D = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]


def write(folder, ticker, days, close=1.0):
    rows = "\n".join(f"{D[d]},{close},{close},{close},{close},{close},10" for d in days)
    (folder / f"{ticker}.csv").write_text("trading_date,open,high,low,close,adjusted_close,volume\n" + rows + "\n")


def test_batches_by_ticker_and_range(spark, tmp_path):
    write(tmp_path, "A", range(20))
    write(tmp_path, "B", range(5, 10), 2.0)
    (tmp_path / "BAD.csv").write_text("trading_date,open\nnot a date,1\n")
    got = feed.downloaded(spark, ["A", "B", "BAD", "NONE"], D[2], D[8], path=tmp_path, range_days=3)
    assert got.rdd.getNumPartitions() == 8
    rows = got.collect()
    assert sorted((r["ticker"], r["trading_date"]) for r in rows if r["error"] is None) == [("A", d) for d in D[2:8]] + [("B", d) for d in D[5:8]]
    wrong = {(r["ticker"], r["start"]): r["error"] for r in feed.failures(got).collect()}
    assert sorted(wrong) == [(t, d) for t in ("BAD", "NONE") for d in (D[2], D[5])] and "NONE" in wrong["NONE", D[2]]
    bronze = feed.as_bronze(got, "p", "r1", dt.datetime(2024, 2, 1))
    assert bronze.agg(F.sum("volume")).first()[0] == 90 and bronze.filter("dividends IS NULL").count() == 9
    assert feed.downloaded(spark, ["A"], D[2], D[2], path=tmp_path).count() == 0
    with pytest.raises(Exception, match="NONE"):
        feed.downloaded(spark, ["NONE"], D[0], D[1], path=tmp_path, strict="true").collect()
    with pytest.raises(Exception, match="after end"):
        feed.downloaded(spark, ["A"], D[3], D[2], path=tmp_path).collect()
    plan = spark.createDataFrame([("A", D[18], D[25]), ("B", D[9], D[25])], "ticker string, start_date date, end_date date")
    assert sorted((r["ticker"], r["trading_date"]) for r in feed.planned(spark, plan, path=tmp_path).collect()) == [("A", D[18]), ("A", D[19]), ("B", D[9])]


def test_a_stream_goes_on_from_its_offset(spark, tmp_path):
    source, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    source.mkdir()
    store = Versions(spark, f"{tmp_path}/store")
    write(source, "A", range(7))
    write(source, "B", range(3))
    run = lambda **k: feed.follow(spark, store, ["A", "B", "C"], D[0], "p", checkpoint, path=source, **k).awaitTermination(120)
    assert run()
    got = {(r["ticker"], r["trading_date"], float(r["close"])) for r in store.read("bars").collect()}
    assert got == {("A", d, 1.0) for d in D[:7]} | {("B", d, 1.0) for d in D[:3]}
    assert {r["ticker"] for r in store.read("bars_failures").collect()} == {"C"}
    before = store.latest()
    write(source, "A", range(10), 5.0)  # new dates, and other values for dates that were read
    write(source, "C", [8])
    assert run()
    after = {(r["ticker"], r["trading_date"]): float(r["close"]) for r in store.read("bars").collect()}
    assert after["A", D[6]] == 1.0 and {after["A", d] for d in D[7:10]} == {5.0} and after["C", D[8]] == 1.0
    assert store.latest() > before
    assert store.read("bars", before).count() == 10


def test_offsets_are_the_first_date_not_read(tmp_path):
    write(tmp_path, "A", range(25))
    options = {"tickers": "A", "start": D[0].isoformat(), "path": str(tmp_path), "range_days": "10"}
    reader = feed._StreamReader(options)
    at, end = reader.initialOffset(), reader.latestOffset()
    assert end == {"next": D[25].isoformat()}
    parts = reader.partitions(at, end)
    assert [b.num_rows for p in parts for b in reader.read(p)] == [10, 10, 5]
    again = feed._StreamReader(options)  # after a restart
    assert again.partitions(end, again.latestOffset()) == []
    write(tmp_path, "A", range(27))
    assert [(p.start, p.end) for p in again.partitions(end, again.latestOffset())] == [(D[25], D[27])]
    assert feed._StreamReader({**options, "start": "2025-01-01"}).latestOffset() == {"next": "2025-01-01"}
