"""Replay of signals over daily bars: one portfolio a run, many runs at once.

Spark ranks the candidates of each date and keeps, of all bars, those of the candidates' tickers while a position may be held;
within a run, cash and slots couple all instruments from day to day, so what is kept of a run is folded in order by one task.
Parallelism comes from runs (parameters to compare), which are the group key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import ORDER, finite


@dataclass(frozen=True)
class Rules:
    initial_cash: float = 100_000.0
    risk_fraction: float = 0.01
    max_positions: int = 5
    max_holding_sessions: int = 10
    minimum_score: float = 0.5
    stop_atr_multiple: float = 1.0
    reward_risk_ratio: float = 2.0
    commission_rate: float = 0.0025

    def __post_init__(self):
        if self.reward_risk_ratio < 2 or min(self.initial_cash, self.risk_fraction, self.stop_atr_multiple) <= 0 or self.commission_rate < 0:
            raise ValueError("reward_risk_ratio must be at least 2, amounts positive")
        if min(self.max_positions, self.max_holding_sessions) < 1:
            raise ValueError("counts must be positive")


def violations(prices: DataFrame, signals: DataFrame) -> DataFrame:
    """(kind, n): signals without a bar, bars that can't be."""
    from barloom.operators.targets import valid_bar

    lost = signals.join(prices, ["provider", "ticker", ORDER], "left_anti").agg(F.lit("signal_without_bar").alias("kind"), F.count(F.lit(1)).alias("n"))
    return lost.unionByName(prices.filter(~valid_bar()).agg(F.lit("invalid_bar").alias("kind"), F.count(F.lit(1)).alias("n")))


def ranked_candidates(signals: DataFrame, minimum_score: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Signals that may be traded, with their place on the date: by score, then provider and ticker."""
    ok = signals.withColumns({"score": finite("score"), "atr": finite("atr")}).filter((F.col("score") >= minimum_score) & (F.col("atr") > 0))
    return ok.withColumn("place", F.row_number().over(Window.partitionBy(*by, ORDER).orderBy(F.desc("score"), "provider", "ticker")))


TRADES = (
    "run string, provider string, ticker string, entry_date date, exit_date date, entry_price double, exit_price double, quantity long, stop double, target double, "
    "exit_reason string, ambiguous boolean, pnl double, r_multiple double, holding_sessions int, commission double"
)


def replay(rows: list[dict], rules: Rules) -> tuple[list[dict], list[tuple]]:
    """(trades, equity by date) of one run. rows: bars in order of date and ticker, place, score and atr where they signal."""
    days: dict = {}
    for r in rows:
        bars = days.setdefault(r["trading_date"], {})
        if r["ticker"] is not None:  # else a session without a bar that matters
            bars[r["provider"], r["ticker"]] = r
    dates = sorted(days)
    cash, held, pending, trades, curve = rules.initial_cash, {}, [], [], []
    fee = rules.commission_rate
    last_close: dict = {}

    def leave(key, day, price, why, ambiguous=False):
        nonlocal cash
        p = held.pop(key)
        paid = price * p["quantity"]
        cash += paid * (1 - fee)
        commission = (p["entry_price"] * p["quantity"] + paid) * fee
        pnl = paid - p["entry_price"] * p["quantity"] - commission
        risk = (p["entry_price"] - p["stop"]) * p["quantity"]
        trades.append({**p, "provider": key[0], "ticker": key[1], "exit_date": day, "exit_price": price, "exit_reason": why, "ambiguous": ambiguous, "pnl": pnl, "r_multiple": pnl / risk, "holding_sessions": p["sessions"], "commission": commission})

    due: set = set()
    for at, day in enumerate(dates):
        bars = days[day]
        for key in sorted(due & held.keys() & bars.keys()):  # without a bar, the exit waits for the next session
            leave(key, day, bars[key]["open"], "timeout")
            due.discard(key)
        for key in sorted(held.keys() & bars.keys()):
            p, o = held[key], bars[key]["open"]
            if o <= p["stop"] or o >= p["target"]:
                leave(key, day, o, "stop_loss" if o <= p["stop"] else "take_profit")
        for key, quantity, atr in pending:
            bar = bars.get(key)
            if bar is None or len(held) >= rules.max_positions:
                continue
            stop = bar["open"] - rules.stop_atr_multiple * atr
            quantity = min(quantity, int(cash // (bar["open"] * (1 + fee))))
            if quantity < 1 or stop <= 0:
                continue
            cash -= bar["open"] * quantity * (1 + fee)
            held[key] = {"entry_date": day, "entry_price": bar["open"], "quantity": quantity, "stop": stop, "target": bar["open"] + rules.reward_risk_ratio * rules.stop_atr_multiple * atr, "sessions": 0}
        pending = []
        for key in sorted(held.keys() & bars.keys()):
            p, bar = held[key], bars[key]
            p["sessions"] += 1
            hit_stop, hit_target = bar["low"] <= p["stop"], bar["high"] >= p["target"]
            if hit_stop:
                leave(key, day, p["stop"], "stop_loss", hit_target)
            elif hit_target:
                leave(key, day, p["target"], "take_profit")
        last_close.update((k, b["close"]) for k, b in bars.items())
        equity = cash + sum(p["quantity"] * last_close[k] for k, p in held.items())
        curve.append((day, equity))
        due = {k for k, p in held.items() if p["sessions"] >= rules.max_holding_sessions}
        if at + 1 < len(dates):
            coming, slots = days[dates[at + 1]], rules.max_positions - (len(held) - len(due))
            for r in sorted((r for r in bars.values() if r["place"] is not None), key=lambda r: r["place"]):
                key = r["provider"], r["ticker"]
                if slots < 1:
                    break
                if key in held or key not in coming:
                    continue
                quantity = int(equity * rules.risk_fraction // (rules.stop_atr_multiple * r["atr"]))
                if quantity >= 1:
                    pending.append((key, quantity, r["atr"]))
                    slots -= 1
    for key in sorted(held):
        leave(key, dates[-1], last_close[key], "end_of_data")
    if curve:
        curve[-1] = (curve[-1][0], cash)
    return trades, curve


EQUITY = "run string, trading_date date, equity double"


def _rows_of_runs(prices: DataFrame, signals: DataFrame, runs: dict[str, Rules]) -> DataFrame | None:
    """What a run depends on: placed candidates, the bars of their tickers while a position may be held (rows, since a session
    without a bar doesn't count), and every session once, without a ticker."""
    keys = ["provider", "ticker", ORDER]
    figures = ["open", "high", "low", "close"]
    bars, each = prices.select(*keys, *figures), None
    sessions = bars.select(ORDER).distinct()
    for name, rules in runs.items():
        placed = ranked_candidates(signals, rules.minimum_score).select(*keys, "place", "atr")
        since = Window.partitionBy("provider", "ticker").orderBy(ORDER).rowsBetween(-(rules.max_holding_sessions + 2), 0)
        own = bars.join(placed, keys, "left").withColumn("__near", F.max(F.col("place").isNotNull()).over(since)).filter("__near").drop("__near")
        own = own.unionByName(sessions, allowMissingColumns=True).withColumn("run", F.lit(name))
        each = own if each is None else each.unionByName(own)
    return each


def _replayed(bars, name: str, rules: Rules):
    rows = bars.sort_by([(ORDER, "ascending"), ("provider", "ascending"), ("ticker", "ascending")]).to_pylist()
    return replay(rows, rules)


def run_backtest(prices: DataFrame, signals: DataFrame, runs: dict[str, Rules]) -> DataFrame:
    """All trades of all runs (TRADES)."""
    each = _rows_of_runs(prices, signals, runs)
    names = [c.strip().split(" ")[0] for c in TRADES.split(",")]

    def fold(key, bars):
        import pyarrow as pa

        run = key[0].as_py()
        trades, _ = _replayed(bars, run, runs[run])
        kinds = {"entry_date": pa.date32(), "exit_date": pa.date32(), "quantity": pa.int64(), "ambiguous": pa.bool_(), "holding_sessions": pa.int32()}
        kinds |= dict.fromkeys(("run", "provider", "ticker", "exit_reason"), pa.string())
        return pa.table({n: pa.array([run if n == "run" else t[n] for t in trades], kinds.get(n, pa.float64())) for n in names})

    return each.groupBy("run").applyInArrow(fold, TRADES) if each is not None else prices.sparkSession.createDataFrame([], TRADES)


def equity_curves(prices: DataFrame, signals: DataFrame, runs: dict[str, Rules]) -> DataFrame:
    """(run, trading_date, equity): cash and holdings at each close; the last day's is the cash after everything is sold."""
    each = _rows_of_runs(prices, signals, runs)

    def fold(key, bars):
        import pyarrow as pa

        run = key[0].as_py()
        _, curve = _replayed(bars, run, runs[run])
        columns = [[run] * len(curve), [d for d, _ in curve], [float(e) for _, e in curve]]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("run", ORDER, "equity"), columns, (pa.string(), pa.date32(), pa.float64()), strict=True)})

    return each.groupBy("run").applyInArrow(fold, EQUITY) if each is not None else prices.sparkSession.createDataFrame([], EQUITY)


def summarize(trades: DataFrame, initial_cash: float) -> DataFrame:
    won = F.col("pnl") > 0
    return trades.groupBy("run").agg(
        F.count(F.lit(1)).alias("trades"), F.avg(won.cast("double")).alias("win_rate"), F.avg(F.when(won, F.col("r_multiple"))).alias("mean_r_win"),
        F.avg(F.when(~won, F.col("r_multiple"))).alias("mean_r_loss"), F.sum("r_multiple").alias("total_r"), (F.sum("pnl") / initial_cash).alias("total_return"),
        F.avg("r_multiple").alias("expectancy_r"), F.avg("holding_sessions").alias("mean_holding_sessions"), F.sum("commission").alias("commissions"),
    )
