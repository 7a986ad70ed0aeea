"""Committed tables: whole versions, conflicts, killed writers, and what an upsert touches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import labeling
from barloom.sources import bars
from barloom.sources.versions import Conflict, Versions, newest, unnamed_folders

D = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(10)]
NAMES = ["provider", "ticker", "trading_date", "open", "high", "low", "close", "adjusted_close", "dividends", "stock_splits", "volume", "fetched_at", "request_id"]


def prices(spark, *rows):
    """(ticker, day, close, hour of the download)"""
    return spark.createDataFrame([("p", t, D[d], *[float(c)] * 5, 0.0, 0.0, 5, dt.datetime(2024, 2, 1, h), f"r{h}") for t, d, c, h in rows], NAMES)


def closes(df):
    return {(r["ticker"], D.index(r["trading_date"])): float(r["close"]) for r in df.collect()}


def test_an_upsert_of_a_day_touches_the_files_of_that_day(spark, tmp_path):
    store = Versions(spark, f"{tmp_path}/s")
    assert store.latest() == 0
    assert bars.commit_prices(store, prices(spark, *[(t, d, 1, 1) for t in "AB" for d in range(4)])) == 1
    before = store.manifest()["bars"]["parts"]
    assert sorted(before) == [str(d) for d in D[:4]]
    bars.commit_prices(store, prices(spark, ("B", 2, 7, 2), ("B", 2, 8, 3), ("C", 2, 9, 2)))
    after = store.manifest()["bars"]["parts"]
    assert {n for n in after if after[n] != before[n]} == {str(D[2])}
    assert closes(store.read("bars"))["B", 2] == 8.0 and len(closes(store.read("bars"))) == 9
    assert closes(store.read("bars", version=1)) == {(t, d): 1.0 for t in "AB" for d in range(4)}
    part = store.read("bars", first=str(D[3]), last=str(D[3]))
    assert closes(part) == {("A", 3): 1.0, ("B", 3): 1.0} and len(part.inputFiles()) == len([f for f in store.read("bars").inputFiles() if str(D[3]) in f])
    with pytest.raises(ValueError):
        bars.commit_prices(store, prices(spark, ("A", 0, 1, 1)).drop("volume"))
    with pytest.raises(ValueError):
        bars.commit_prices(store, prices(spark, ("A", 0, 1, 1)), part="ticker")


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path):
    store = Versions(spark, f"{tmp_path}/s")
    bars.commit_prices(store, prices(spark, ("A", 0, 1, 1)))

    def killed(change):
        change.upsert("bars", bars.upsert(None, prices(spark, ("A", 0, 5, 2))), bars.KEYS)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.commit(killed)
    assert store.latest() == 1 and closes(store.read("bars")) == {("A", 0): 1.0}
    assert len(unnamed_folders(store)) == 1


def test_of_two_writers_one_wins_and_the_other_builds_again(spark, tmp_path):
    store, other, seen = Versions(spark, f"{tmp_path}/s"), Versions(spark, f"{tmp_path}/s"), []
    bars.commit_prices(store, prices(spark, ("A", 0, 1, 1), ("B", 0, 1, 1)))

    def build(change):
        seen.append(change.base)
        if len(seen) == 1:
            bars.commit_prices(other, prices(spark, ("A", 0, 2, 2)))
        change.upsert("bars", bars.upsert(None, prices(spark, ("B", 0, 3, 2))), bars.KEYS)

    assert store.commit(build, "second") == 3 and seen == [1, 2]
    assert closes(store.read("bars")) == {("A", 0): 2.0, ("B", 0): 3.0}
    assert [h["note"] for h in store.history()] == ["prices into bars", "prices into bars", "second"]

    def always(change):
        bars.commit_prices(other, prices(spark, ("A", 0, 4, 4)))

    with pytest.raises(Conflict):
        store.commit(always, attempts=2)


def test_parts_may_have_any_name(spark, tmp_path):
    store = Versions(spark, f"{tmp_path}/s")
    df = spark.createDataFrame([("a/b=c%", 1), (None, 2), ("", 3), ("é ü", 4)], "k string, v int")
    store.commit(lambda c: c.replace("t", df, "k"))
    assert sorted(store.manifest()["t"]["parts"]) == sorted(["a/b=c%", "-", "é ü"])
    store.commit(lambda c: c.upsert("t", spark.createDataFrame([("a/b=c%", 5)], "k string, v int"), ["k"]))
    assert sorted((r["k"] or "", r["v"]) for r in store.read("t").collect()) == [("", 2), ("", 3), ("a/b=c%", 5), ("é ü", 4)]
    store.commit(lambda c: c.drop_parts("t", ["-"]))
    assert store.read("t").count() == 2 and store.read("t", 1).count() == 4
    store.commit(lambda c: c.replace("t", df.limit(0)))
    assert store.read("t").count() == 0
    twice = spark.createDataFrame([("x", 1, 9), ("x", 2, 1), ("y", 0, 0)], "k string, at int, v int")
    assert sorted(map(tuple, newest(twice, ["k"], ["at"]).collect())) == [("x", 2, 1), ("y", 0, 0)]


def test_labels_and_progress_are_committed_together(spark, tmp_path):
    store, now = Versions(spark, f"{tmp_path}/s"), dt.datetime(2024, 5, 1)
    rules = labeling.LabelingRules(window_size=3, step_size=3, forward_horizon=1)
    session = labeling.create_session("p", ["A", "B"], rules, now)
    labeling.open_session(store, session)
    assert labeling.session_of(store.read("sessions"), session.session_id) == session
    window = spark.createDataFrame([(d,) for d in D[:3]], "trading_date date")
    moved = labeling.commit_window(store, session.session_id, rules, window, 0, [D[1]], now + dt.timedelta(hours=1), next_window=1)
    assert moved.window_position == 1 and labeling.session_of(store.read("sessions"), session.session_id) == moved
    with pytest.raises(ValueError):  # a second writer that saves the same window
        labeling.commit_window(store, session.session_id, rules, window, 0, [D[0]], now)
    with pytest.raises(ValueError):
        labeling.commit_window(store, session.session_id, rules, window, 1, [D[7]], now)
    assert store.latest() == 2
    done = labeling.commit_window(store, session.session_id, rules, spark.createDataFrame([(d,) for d in D[3:6]], "trading_date date"), 1, [D[3]], now, next_ticker=1, next_window=0)
    assert done.ticker == "B"
    got = labeling.load_labels(store.read("labels"), session.session_id, "p", "A").collect()
    assert {r["trading_date"]: r["label"] for r in got} == {D[0]: 0, D[1]: 1, D[2]: 0, D[3]: 1, D[4]: 0, D[5]: 0}
    assert labeling.load_labels(store.read("labels", 2), session.session_id, "p", "A").agg(F.sum("label")).first()[0] == 1
    with pytest.raises(ValueError):
        labeling.LabelingRules(window_size=3, step_size=4)
