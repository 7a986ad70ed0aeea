"""Features that depend on their own past, over a stream of bars: direction runs, ADX and the confirmed zigzag.

An instrument is a key of transformWithState. Bars wait in a list until the watermark has passed them, so bars that come in
any order within the watermark give what a table of them gives; a bar that comes after a later one has been used is dropped, as
is a second bar of the same time. A timer at the earliest waiting bar wakes the instrument. What has been used is folded into a
value of bounded size: the last bar, the recursive means, 2 * legs + 1 highs and lows, and the last pivots; never the history.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.structure import STATE, state_of, step

BAR = ("at", "open", "high", "low", "close")
RUNS, ADX = ("direction_run",), ("adx", "plus_di", "minus_di")
ZIGZAG = tuple(f"zigzag_{n}" for n in STATE)


def _ratio(a: float | None, b: float | None) -> float | None:
    return None if a is None or b is None or b == 0 else a / b


class Fold:
    """The features of one instrument's bars, a bar at a time; ``dump`` and ``load`` keep it as text."""

    def __init__(self, length: int = 14, deviation: float = 5.0, pivot_legs: int = 10, consistency_pivots: int = 4, dynamics_legs: int = 6):
        if not deviation > 0 or pivot_legs < 2 or consistency_pivots < 2 or dynamics_legs < 2 or dynamics_legs % 2 or length < 1:
            raise ValueError("lengths and deviation must be positive, dynamics_legs even")
        self.length, self.deviation, self.legs = length, deviation / 100.0, pivot_legs // 2
        self.consistency, self.dynamics = consistency_pivots, dynamics_legs
        self.own = {"n": 0, "last": None, "bar": None, "dir": None, "run": 0, "means": {}, "around": [], "pivots": []}

    def dump(self) -> str:
        return json.dumps(self.own)

    def load(self, text: str | None) -> Fold:
        if text:
            self.own = json.loads(text)
        return self

    @property
    def last(self) -> int | None:
        return self.own["last"]

    def _mean(self, name: str, x: float | None) -> float | None:
        """The recursive mean: a missing value repeats the last result and lets the old weight decay."""
        y, w, n = self.own["means"].get(name, (None, 1.0, 0))
        a = 1.0 / self.length
        if x is not None:
            y, w, n = (x, 1.0, n + 1) if y is None else ((w * (1 - a) * y + a * x) / (w * (1 - a) + a), 1.0, n + 1)
        elif y is not None:
            w *= 1 - a
        self.own["means"][name] = (y, w, n)
        return y if n >= self.length else None

    def _adx(self, high, low, close) -> tuple:
        before = self.own["bar"]
        up = down = 0.0
        if before and None not in (high, low, *before[:2]):
            u, d = high - before[0], before[1] - low
            up, down = u if u > d and u > 0 else 0.0, d if d > u and d > 0 else 0.0
        ranges = [abs(a - b) for a, b in ((high, low), (high, before and before[2]), (low, before and before[2])) if a is not None and b is not None]
        atr = self._mean("range", max(ranges, default=None))
        plus, minus = (_ratio(None if m is None else 100.0 * m, atr) for m in (self._mean("up", up), self._mean("down", down)))
        apart = None if plus is None or minus is None else _ratio(100.0 * abs(plus - minus), plus + minus)
        return self._mean("apart", apart), plus, minus

    def _zigzag(self, high, low) -> dict:
        own, legs = self.own, self.legs
        own["around"] = [*own["around"], (high, low)][-2 * legs - 1 :]
        if len(own["around"]) == 2 * legs + 1:
            sides = []
            for k, sign in ((0, 1), (1, -1)):
                xs = [b[k] for b in own["around"]]
                top = None not in xs and all(sign * (xs[legs] - x) > 0 for x in xs[:legs]) and all(sign * (xs[legs] - x) >= 0 for x in xs[legs + 1 :])
                sides.append(xs[legs] if top else None)
            if sides != [None, None]:
                pivots = [tuple(p) for p in own["pivots"]]
                step(pivots, own["n"] - legs, *sides, self.deviation)
                own["pivots"] = pivots[-max(2 * max(2, self.consistency), self.dynamics + 1, 2) :]
        return state_of([tuple(p) for p in own["pivots"]], self.consistency, self.dynamics)

    def push(self, at: int, open_: float | None, high: float | None, low: float | None, close: float | None) -> tuple:
        own = self.own
        sign = None if open_ is None or close is None else (close > open_) - (close < open_)
        own["run"] = 0 if not sign else own["run"] + sign if sign == own["dir"] else sign
        adx, zigzag = self._adx(high, low, close), self._zigzag(high, low)
        own |= {"n": own["n"] + 1, "last": at, "bar": (high, low, close), "dir": sign}
        return (None if sign is None else own["run"], *adx, *[zigzag[n] for n in STATE])


class BarFeatures(StatefulProcessor):
    def __init__(self, **settings):
        self.settings = settings
        Fold(**settings)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, open double, high double, low double, close double")
        self.folded = handle.getValueState("folded", "value string")

    def _fold(self) -> Fold:
        known = self.folded.get()
        return Fold(**self.settings).load(known[0] if known else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        last, new = self._fold().last, []
        for batch in rows:
            for bar in batch[list(BAR)].itertuples(index=False):
                if last is None or bar.at > last:
                    new.append((int(bar.at), *[None if x != x else float(x) for x in bar[1:]]))
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(-(-min(b[0] for b in new) // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs() * 1000
        bars = sorted((tuple(b) for b in self.waiting.get()), key=lambda b: b[0])
        ready, rest, fold, out = [b for b in bars if b[0] <= now], [b for b in bars if b[0] > now], self._fold(), []
        for b in ready:
            b = (b[0], *[None if x is None or x != x else x for x in b[1:]])
            if fold.last is None or b[0] > fold.last:
                out.append((*key, b[0], b[4], *fold.push(*b)))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        else:
            self.waiting.clear()
        if out:
            self.folded.update((fold.dump(),))
            yield pd.DataFrame(out, columns=["provider", "ticker", "at", "close", *RUNS, *ADX, *ZIGZAG]).astype({"direction_run": "Int64", **dict.fromkeys((*ADX, *ZIGZAG, "close"), "float64")})

    def close(self) -> None:
        pass


def stateful_features(bars: DataFrame, late: str = "2 hours", **settings) -> DataFrame:
    """A stream of bars -> (provider, ticker, trading_date, close, direction_run, adx, plus_di, minus_di, zigzag_*), each bar once
    the watermark has passed it. Needs the RocksDB state store (``state_store``)."""
    rows = bars.withWatermark("trading_date", late)
    rows = rows.select("provider", "ticker", "trading_date", F.unix_micros("trading_date").alias("at"), *[F.col(c).cast("double").alias(c) for c in BAR[1:]])
    shape = "provider string, ticker string, at long, close double, direction_run long, " + ", ".join(f"{n} double" for n in (*ADX, *ZIGZAG))
    out = rows.groupBy("provider", "ticker").transformWithStateInPandas(BarFeatures(**settings), shape, "Append", "EventTime")
    return out.select("provider", "ticker", F.timestamp_micros("at").alias("trading_date"), "close", *RUNS, *ADX, *ZIGZAG)


def state_store(spark) -> None:
    """transformWithState keeps lists, values and timers in column families, which only RocksDB has."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
