"""Manual labelling support: windows to label, forward outcomes, risk guides, and label tables merged by key."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import KEYS, ORDER, check_length, divide, finite, lead, position
from barloom.functions.selection import exact_percentiles

LABEL_KEY = ("session_id", "provider", "ticker", "trading_date")


def plan_windows(bars: DataFrame, window: int, step: int, forward_horizon: int, context: int = 0) -> DataFrame:
    """(provider, ticker, window, first_row, last_row, first_date, last_date): windows with forward_horizon rows after them.

    Rows count from 0; a window starts every ``step`` rows after ``context`` ones. Windows are made from one row a
    ticker, and dates looked up by row.
    """
    check_length(window, step)
    rows = bars.select(*KEYS, ORDER, (position() - 1).alias("row"))
    n = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    last_start = F.col("n") - forward_horizon - window
    starts = n.filter(last_start >= context).select(*KEYS, F.posexplode(F.sequence(F.lit(context).cast("long"), last_start, F.lit(step).cast("long"))).alias("window", "first_row"))
    plan = starts.withColumn("last_row", F.col("first_row") + window - 1)
    for side in ("first", "last"):
        plan = plan.join(rows.select(*KEYS, F.col("row").alias(f"{side}_row"), F.col(ORDER).alias(f"{side}_date")), [*KEYS, f"{side}_row"])
    return plan.select(*KEYS, "window", "first_row", "last_row", "first_date", "last_date")


def forward_outcomes(bars: DataFrame, horizons: int, atr: str = "atr", stop_atr_multiple: float = 1.0, commission: float = 0.0025) -> DataFrame:
    """(keys, horizon, net_return, net_atr, net_risk): close to close, after both commissions, for each row and horizon."""
    buy, sell = 1 + commission, 1 - commission
    per = {h: lead("close", h) for h in range(1, horizons + 1)}
    wide = bars.select(*KEYS, ORDER, "close", F.col(atr).alias("__atr"), F.array(*per.values()).alias("__ahead"))
    long = wide.select(*KEYS, ORDER, "close", "__atr", F.posexplode("__ahead").alias("__k", "__exit"))
    gain = F.col("__exit") * sell - F.col("close") * buy
    return long.select(
        *KEYS, ORDER, (F.col("__k") + 1).alias("horizon"), divide(gain, F.col("close") * buy).alias("net_return"), divide(gain, "__atr").alias("net_atr"),
        divide(gain, F.col("__atr") * stop_atr_multiple).alias("net_risk"),
    )


def risk_guide(bars: DataFrame, horizon: int, atr: str = "atr", stop_atr_multiple: float = 1.0, reward_risk_ratio: float = 2.0) -> DataFrame:
    """(keys, stop, target, end_date): levels from the close; the end is the row ``horizon`` ahead, or the last one."""
    end = F.coalesce(lead(ORDER, horizon), F.last(ORDER).over(Window.partitionBy(*KEYS).orderBy(ORDER).rowsBetween(0, Window.unboundedFollowing)))
    risk = finite(atr) * stop_atr_multiple
    return bars.select(*KEYS, ORDER, (F.col("close") - risk).alias("stop"), (F.col("close") + risk * reward_risk_ratio).alias("target"), end.alias("end_date"))


def merge_labels(existing: DataFrame | None, window: DataFrame, positives: DataFrame, now: dt.datetime) -> DataFrame:
    """existing with every row of a window (LABEL_KEY) labelled: 1 where positives has it, else 0; older labels are replaced."""
    marked = window.select(*LABEL_KEY).distinct().join(positives.select(*LABEL_KEY).distinct().withColumn("__p", F.lit(1)), list(LABEL_KEY), "left")
    new = marked.select(*LABEL_KEY, F.coalesce("__p", F.lit(0)).alias("label"), F.lit(now).cast("timestamp").alias("updated_at"))
    if existing is None:
        return new
    return existing.join(new, list(LABEL_KEY), "left_anti").unionByName(new)


def load_labels(labels: DataFrame, session_id: str, provider: str, ticker: str, start=None, end=None) -> DataFrame:
    df = labels.filter((F.col("session_id") == session_id) & (F.col("provider") == provider) & (F.col("ticker") == ticker))
    if start is not None:
        df = df.filter(F.col(ORDER) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(ORDER) <= F.lit(end))
    return df.select(ORDER, "label")


def latest_session(sessions: DataFrame, **where) -> DataFrame:
    """The session last updated (then created, then with the greatest id) among those with the given values."""
    for name, value in where.items():
        sessions = sessions.filter(F.col(name) == value)
    return sessions.orderBy(F.desc("updated_at"), F.desc("created_at"), F.desc("session_id")).limit(1)


def heat_limit(df: DataFrame, x: str, share: float = 0.98) -> DataFrame:
    """One row: the percentile of the absolute finite values, found by selection."""
    found = exact_percentiles(df, {"limit": F.abs(finite(x))}, share)["limit"]
    return df.sparkSession.createDataFrame([(found,)], "limit double")


@dataclass(frozen=True)
class LabelingRules:
    """What is fixed for a session; only the two multiples may change while it goes on."""

    window_size: int = 80
    step_size: int = 60
    forward_horizon: int = 10
    atr_length: int = 14
    atr_stop_multiple: float = 1.0
    reward_risk_ratio: float = 2.0
    commission_rate: float = 0.0025
    pivot_high_left: int = 15
    pivot_high_right: int = 15
    pivot_low_left: int = 15
    pivot_low_right: int = 15

    def __post_init__(self):
        whole = (self.window_size, self.step_size, self.forward_horizon, self.atr_length, self.pivot_high_left, self.pivot_high_right, self.pivot_low_left, self.pivot_low_right)
        if min(whole) < 1 or self.atr_stop_multiple <= 0 or self.reward_risk_ratio < 2 or not 0 <= self.commission_rate < 1:
            raise ValueError("lengths and the stop multiple must be positive, reward_risk_ratio at least 2, commission_rate at least 0 and under 1")
        if self.step_size > self.window_size:
            raise ValueError("step_size must not exceed window_size: rows between windows would never be labelled")

    def fixed(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k not in ("atr_stop_multiple", "reward_risk_ratio")}


@dataclass(frozen=True)
class Session:
    """Progress of one labelling job: which ticker and which of its windows comes next."""

    session_id: str
    provider: str
    tickers: tuple[str, ...]
    rules: LabelingRules
    created_at: dt.datetime
    updated_at: dt.datetime
    ticker_position: int = 0
    window_position: int = 0
    completed: bool = False

    @property
    def ticker(self) -> str:
        if self.completed or not 0 <= self.ticker_position < len(self.tickers):
            raise ValueError("the session has no current ticker")
        return self.tickers[self.ticker_position]


def create_session(provider: str, tickers, rules: LabelingRules, now: dt.datetime) -> Session:
    kept = tuple(dict.fromkeys(t.strip() for t in tickers if t.strip()))
    if not provider.strip() or not kept:
        raise ValueError("a session needs a provider and a ticker")
    return Session(uuid.uuid4().hex, provider, kept, rules, now, now)


def save_window(
    labels: DataFrame | None, session: Session, rules: LabelingRules, window: DataFrame, window_position: int, positive_dates, now: dt.datetime,
    next_ticker: int | None = None, next_window: int | None = None, completed: bool | None = None,
) -> tuple[DataFrame, Session]:
    """(labels with all of a window labelled, the session moved on). window has the planned dates (trading_date) of the current ticker.

    Refused: a completed session, other rules than the session's, a window that isn't the current one, positive dates outside the
    window, positions that don't exist.
    """
    if session.completed:
        raise ValueError("the session is completed")
    if rules.fixed() != session.rules.fixed():
        raise ValueError("the rules differ from the session's")
    if window_position != session.window_position:
        raise ValueError(f"the session is at window {session.window_position}, not {window_position}")
    planned = {r[0] for r in window.select(ORDER).distinct().collect()}  # a window's dates, as many as its size
    if outside := sorted(set(positive_dates) - planned):
        raise ValueError(f"dates outside the window: {outside}")
    if next_ticker is not None and not 0 <= next_ticker < len(session.tickers) or next_window is not None and next_window < 0:
        raise ValueError("there is no such position")
    spark = window.sparkSession
    at = lambda dates: spark.createDataFrame([(session.session_id, session.provider, session.ticker, d) for d in sorted(dates)], "session_id string, provider string, ticker string, trading_date date")
    merged = merge_labels(labels, at(planned), at(set(positive_dates)), now)
    moved = replace(
        session, rules=replace(session.rules, atr_stop_multiple=rules.atr_stop_multiple, reward_risk_ratio=rules.reward_risk_ratio), updated_at=now,
        ticker_position=session.ticker_position if next_ticker is None else next_ticker, window_position=session.window_position if next_window is None else next_window,
        completed=session.completed if completed is None else completed,
    )
    return merged, moved


SESSIONS = "session_id string, provider string, tickers array<string>, rules string, created_at timestamp, updated_at timestamp, ticker_position int, window_position int, completed boolean"


def session_rows(spark, *sessions: Session) -> DataFrame:
    """Sessions as rows of the table of sessions."""
    rows = [(s.session_id, s.provider, list(s.tickers), json.dumps(asdict(s.rules), sort_keys=True), s.created_at, s.updated_at, s.ticker_position, s.window_position, s.completed) for s in sessions]
    return spark.createDataFrame(rows, SESSIONS)


def session_of(sessions: DataFrame, session_id: str) -> Session:
    row = sessions.filter(F.col("session_id") == session_id).first()
    if row is None:
        raise ValueError(f"there is no session {session_id}")
    return Session(**{**row.asDict(), "tickers": tuple(row["tickers"]), "rules": LabelingRules(**json.loads(row["rules"]))})


def open_session(store, session: Session) -> int:
    """Commits a new session; the tables of labels and sessions are made with the first one."""

    def build(change) -> None:
        rows = session_rows(store.spark, session)
        change.upsert("sessions", rows, ("session_id",), "session_id")
        if "labels" not in change.tables:
            none = store.spark.createDataFrame([], "session_id string, provider string, ticker string, trading_date date, label int, updated_at timestamp")
            change.replace("labels", none, "concat_ws('/', session_id, ticker)")

    return store.commit(build, f"session {session.session_id}")


def commit_window(store, session_id: str, rules: LabelingRules, window: DataFrame, window_position: int, positive_dates, now: dt.datetime, **moves) -> Session:
    """save_window on stored tables: a window's labels and the session's progress are committed together, or not at all.

    The checks are made against the session as stored in the version that the commit builds on: of two writers that save the same
    window, the second finds the session moved on, and is refused.
    """
    out: list[Session] = []

    def build(change) -> None:
        session = session_of(change.read("sessions"), session_id)
        new, moved = save_window(None, session, rules, window, window_position, positive_dates, now, **moves)
        change.upsert("labels", new, LABEL_KEY)
        change.upsert("sessions", session_rows(store.spark, moved), ("session_id",))
        out[:] = [moved]

    store.commit(build, f"window {window_position} of session {session_id}")
    return out[0]


def prepare_frame(bars: DataFrame, rules: LabelingRules) -> DataFrame:
    """bars with ema_10, ema_20, ema_50, atr, pivot_high and pivot_low, for all instruments at once."""
    from barloom.operators.structure import add_pivot_points
    from barloom.operators.trend import add_atr, add_ema

    if missing := sorted({"open", "high", "low", "close", "volume"} - set(bars.columns)):
        raise ValueError(f"columns are missing: {missing}")
    df = add_ema(bars, "close", 10, 20, 50, names=["ema_10", "ema_20", "ema_50"])
    df = add_atr(df, rules.atr_length)
    out = add_pivot_points(df, high_left=rules.pivot_high_left, high_right=rules.pivot_high_right, low_left=rules.pivot_low_left, low_right=rules.pivot_low_right)
    return out.select(*df.columns, "pivot_high", "pivot_low")


def prepare_universe(bronze: DataFrame, provider: str, tickers, end: dt.date, rules: LabelingRules, start: dt.date | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, windows, skipped): cleaned bars with indicators and the windows of the tickers that have one; of the others, why not.

    Windows begin no earlier than start. skipped: (ticker, reason).
    """
    from barloom.operators.quality import clean_prices
    from barloom.sources.bars import load_daily_prices

    asked = list(dict.fromkeys(tickers))
    spark = bronze.sparkSession
    rows = load_daily_prices(bronze, provider, asked, None, end, ["open", "high", "low", "close", "adjusted_close", "volume"])
    frames = prepare_frame(clean_prices(rows), rules)
    first = frames.filter(F.col(ORDER) >= F.lit(start)) if start is not None else frames
    windows = plan_windows(first, rules.window_size, rules.step_size, rules.forward_horizon)
    there, able = rows.select("ticker").distinct(), windows.select("ticker").distinct()
    wanted = spark.createDataFrame([(t,) for t in asked], "ticker string")
    short = F.lit(f"insufficient usable history for one window of {rules.window_size} and {rules.forward_horizon} sessions after it")
    skipped = wanted.join(able, "ticker", "left_anti").join(there.withColumn("__there", F.lit(True)), "ticker", "left").select("ticker", F.when(F.col("__there"), short).otherwise("no price rows").alias("reason"))
    return frames.join(able, "ticker", "left_semi"), windows, skipped


def context_slice(frames: DataFrame, windows: DataFrame, rules: LabelingRules) -> DataFrame:
    """(window, in_window, all columns of frames): each window's rows with half a window around them, after it at least the forward horizon."""
    around = max(1, rules.window_size // 2)
    # each window's row numbers are written out, so that rows meet windows by equal keys
    first, last = F.greatest(F.col("first_row") - around, F.lit(0)), F.col("last_row") + max(around, rules.forward_horizon)
    w = windows.select(*KEYS, "window", "first_row", "last_row", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("__row"))
    met = frames.withColumn("__row", (position() - 1).cast("long")).join(w, [*KEYS, "__row"])
    return met.select("window", F.col("__row").between(F.col("first_row"), F.col("last_row")).alias("in_window"), *frames.columns)


def viewport(frames: DataFrame, windows: DataFrame, sessions: int) -> DataFrame:
    """(keys, window, first_date, last_date) of a view of so many sessions centred on the window; beyond the history in business days."""
    rows = frames.select(*KEYS, ORDER, (position() - 1).alias("__row"))
    ends = rows.groupBy(*KEYS).agg(F.min(ORDER).alias("__a"), F.max(ORDER).alias("__z"), (F.count(F.lit(1)) - 1).alias("__last"))
    center = F.floor((F.col("first_row") + F.col("last_row")) / 2)
    view = windows.select(*KEYS, "window", (center - sessions // 2).alias("__from"), (center + sessions // 2).alias("__to")).join(ends, list(KEYS))
    for side, name in (("__from", "first_date"), ("__to", "last_date")):
        at = rows.select(*KEYS, F.col("__row").alias(side), F.col(ORDER).alias(f"{side}_date"))
        view = view.join(at, [*KEYS, side], "left")
        beyond = F.when(F.col(side) < 0, _business_days("__a", F.col(side))).otherwise(_business_days("__z", F.col(side) - F.col("__last")))
        view = view.withColumn(name, F.coalesce(f"{side}_date", beyond))
    return view.select(*KEYS, "window", "first_date", "last_date")


def _business_days(day: str, n):
    """The date n business days from a day; from a weekend, counting starts at the Friday before (onwards) or the Monday after (back)."""
    d = F.weekday(day)  # Monday is 0
    on = F.when(d > 4, F.date_sub(F.col(day), (d - 4).cast("int"))).otherwise(F.col(day))
    back = F.when(d > 4, F.date_add(F.col(day), (7 - d).cast("int"))).otherwise(F.col(day))
    w = lambda x: F.weekday(x)
    ahead = F.date_add(on, (n + 2 * F.floor((w(on) + n) / 5)).cast("int"))
    behind = F.date_add(back, (n + 2 * F.floor((w(back) + n) / 5)).cast("int"))
    return F.when(n >= 0, ahead).otherwise(behind)
