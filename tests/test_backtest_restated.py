"""The backtest restated day by day in plain Python, over all bars, without any of the library's code; and its summary."""

import math
from dataclasses import dataclass

import pytest

from barloom.operators import backtest
from barloom.plans import workflow
from barloom.sources.bars import bars_week


@dataclass
class Lot:
    who: tuple
    since: object
    paid: float
    shares: int
    floor: float
    ceiling: float
    seen: int = 0


class Desk:
    """One run. Every phase of a day is a method; what a phase may look at is its argument."""

    def __init__(self, rules):
        self.rules, self.cash, self.lots, self.done, self.orders = rules, rules.initial_cash, [], [], []

    def sell(self, lot, day, price, why, both=False):
        fee, money = self.rules.commission_rate, price * lot.shares
        self.lots.remove(lot)
        self.cash += money - money * fee
        cost = lot.paid * lot.shares
        gain = money - cost - fee * (money + cost)
        self.done.append((*lot.who, lot.since, day, lot.paid, price, lot.shares, lot.floor, lot.ceiling, why, both, gain, gain / ((lot.paid - lot.floor) * lot.shares), lot.seen, fee * (money + cost)))

    def at_open(self, day, opens):
        for lot in sorted(self.lots, key=lambda x: x.who):
            if lot.who in opens and lot.seen >= self.rules.max_holding_sessions:
                self.sell(lot, day, opens[lot.who], "timeout")
        for lot in sorted(self.lots, key=lambda x: x.who):
            price = opens.get(lot.who)
            if price is not None and not lot.floor < price < lot.ceiling:
                self.sell(lot, day, price, "stop_loss" if price <= lot.floor else "take_profit")

    def buy(self, day, opens):
        for who, planned, atr in self.orders:
            if who not in opens or len(self.lots) == self.rules.max_positions:
                continue
            price, width = opens[who], self.rules.stop_atr_multiple * atr
            shares = min(planned, math.floor(self.cash / (price * (1 + self.rules.commission_rate))))
            if shares > 0 and price > width:
                self.cash -= shares * price * (1 + self.rules.commission_rate)
                self.lots.append(Lot(who, day, price, shares, price - width, price + width * self.rules.reward_risk_ratio))
        self.orders = []

    def during(self, day, lows, highs):
        for lot in sorted((x for x in self.lots if x.who in lows), key=lambda x: x.who):
            lot.seen += 1
            if lows[lot.who] <= lot.floor:
                self.sell(lot, day, lot.floor, "stop_loss", highs[lot.who] >= lot.ceiling)
            elif highs[lot.who] >= lot.ceiling:
                self.sell(lot, day, lot.ceiling, "take_profit")

    def plan(self, closes, wishes, tomorrow):
        worth = self.cash + sum(x.shares * closes[x.who] for x in self.lots)
        leaving = sum(x.seen >= self.rules.max_holding_sessions for x in self.lots)
        room = self.rules.max_positions - len(self.lots) + leaving
        for _, who, atr in sorted(wishes, key=lambda w: (-w[0], w[1])):
            shares = math.floor(worth * self.rules.risk_fraction / (self.rules.stop_atr_multiple * atr))
            if room > 0 and who in tomorrow and shares > 0 and all(x.who != who for x in self.lots):
                self.orders.append((who, shares, atr))
                room -= 1


def restated(bars, signals, rules):
    desk, closes = Desk(rules), {}
    days = sorted({d for d, *_ in bars})
    by_day = {d: {} for d in days}
    for d, who, o, h, lo, c in bars:
        by_day[d][who] = (o, h, lo, c)
    for k, day in enumerate(days):
        today = by_day[day]
        opens, highs, lows = ({w: b[i] for w, b in today.items()} for i in range(3))
        desk.at_open(day, opens)
        desk.buy(day, opens)
        desk.during(day, lows, highs)
        closes |= {w: b[3] for w, b in today.items()}
        if k + 1 < len(days):
            good = lambda s, a: s is not None and a is not None and math.isfinite(s) and math.isfinite(a) and s >= rules.minimum_score and a > 0
            desk.plan(closes, [(s, w, a) for d, w, s, a in signals.get(day, []) if good(s, a)], by_day[days[k + 1]])
    for lot in sorted(desk.lots, key=lambda x: x.who):
        desk.sell(lot, days[-1], closes[lot.who], "end_of_data")
    return desk.done


@pytest.fixture(scope="module")
def world(spark, data):
    bars, signals = bars_week(spark, data).cache(), workflow._signals(spark, data).cache()
    rows = [(r["trading_date"], (r["provider"], r["ticker"]), r["open"], r["high"], r["low"], r["close"]) for r in bars.collect()]
    wishes = {}
    for r in signals.collect():
        wishes.setdefault(r["trading_date"], []).append((r["trading_date"], (r["provider"], r["ticker"]), r["score"], r["atr"]))
    return bars, signals, rows, wishes


RUNS = workflow.RULES | {
    "few": backtest.Rules(1_000_000.0, 0.05, 1, 3, minimum_score=0.5, stop_atr_multiple=2.0),
    "many": backtest.Rules(50_000_000.0, 0.01, 20, 5, minimum_score=0.0, stop_atr_multiple=0.3, reward_risk_ratio=2.5, commission_rate=0.01),
    "never": backtest.Rules(minimum_score=2.0),
}


def test_trades_equal_the_restated_backtest(spark, world):
    bars, signals, rows, wishes = world
    got = {}
    for r in backtest.run_backtest(bars, signals, RUNS).collect():
        got.setdefault(r["run"], []).append(tuple(r)[1:])
    total, reasons = 0, set()
    for name, rules in RUNS.items():
        want = restated(rows, wishes, rules)
        have = sorted(got.get(name, []), key=lambda t: (t[2], t[:2], t[3]))
        want.sort(key=lambda t: (t[2], t[:2], t[3]))
        assert len(have) == len(want)
        for a, b in zip(have, want, strict=True):
            assert [x for x in a if not isinstance(x, float)] == [x for x in b if not isinstance(x, float)], (name, a, b)
            assert [x for x in a if isinstance(x, float)] == pytest.approx([float(x) for x in b if isinstance(x, float)], rel=1e-9)
        total += len(want)
        reasons |= {t[9] for t in want}
    assert total > 200 and reasons >= {"stop_loss", "take_profit", "timeout"}


def test_summary_equals_plain_figures(spark, world):
    bars, signals, rows, wishes = world
    got = {r["run"]: r for r in backtest.summarize(backtest.run_backtest(bars, signals, RUNS), 1_000_000.0).collect()}
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    for name, rules in RUNS.items():
        trades = restated(rows, wishes, rules)
        if not trades:
            assert name not in got
            continue
        pnl, r = [t[11] for t in trades], [t[12] for t in trades]
        want = {
            "trades": len(trades), "win_rate": mean([p > 0 for p in pnl]), "mean_r_win": mean([x for x, p in zip(r, pnl, strict=True) if p > 0]), "mean_r_loss": mean([x for x, p in zip(r, pnl, strict=True) if p <= 0]),
            "total_r": sum(r), "total_return": sum(pnl) / 1_000_000.0, "expectancy_r": mean(r), "mean_holding_sessions": mean([t[13] for t in trades]), "commissions": sum(t[14] for t in trades),
        }
        for k, v in want.items():
            assert v is None and got[name][k] is None or got[name][k] == pytest.approx(v, rel=1e-9), (name, k)
