"""Exact order statistics of many columns by selection: no task and no buffer ever holds all values.

Bounds around the wanted rank come from a sketch, one aggregate for all columns; one more aggregate counts exactly what is
below and between them. A column whose interval still holds more than ``most`` distinct candidates is narrowed again, now
within its interval; the candidates of the others are counted by value and collected, at most ``most`` a column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 1000  # of the sketch: its bounds are within 1 / ACCURACY of all ranks
ROUNDS = 30


@dataclass
class _Search:
    """Of one column: values are in [low, high]; ``below`` values are under low; rank counts from 0 among all."""

    n: int
    rank: int
    low: float = -math.inf
    high: float = math.inf
    below: int = 0

    def inside(self, x: Column) -> Column:
        return (x >= F.lit(self.low)) & (x <= F.lit(self.high))


def _select(values: dict[str, Column], df: DataFrame, ranks: dict[str, tuple[int, int]], most: int) -> dict[str, float]:
    """name -> the value with rank k (from 0). ranks: name -> (n, k); several names may look at the same column."""
    open_ = {name: _Search(*ranks[name]) for name in ranks}
    found: dict[str, float] = {}
    for _ in range(ROUNDS):
        if not open_:
            return found
        # how many candidates are left, how many of them are different (roughly), and bounds around the rank
        shape = []
        for name, s in open_.items():
            x = F.when(s.inside(values[name]), values[name])
            shape += [F.count(x).alias(f"{name}_n"), F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max")]
            share = (s.rank - s.below + 0.5) / max(1, s.n)
            around = [min(1.0, max(0.0, share + d)) for d in (-2.0 / ACCURACY, 2.0 / ACCURACY)]
            shape.append(F.percentile_approx(x, around, ACCURACY).alias(f"{name}_cut"))
        row = df.agg(*shape).first()
        small = [name for name in open_ if row[f"{name}_n"] <= most or row[f"{name}_min"] == row[f"{name}_max"]]
        if small:
            pick = [F.struct(F.lit(name).alias("name"), F.when(open_[name].inside(values[name]), values[name]).alias("x")) for name in small]
            rows = df.select(F.explode(F.array(*pick)).alias("v")).filter("v.x IS NOT NULL").groupBy("v.name", "v.x").count().collect()  # most a column, or one value
            for name in small:
                own, left = sorted((r["x"], r["count"]) for r in rows if r["name"] == name), open_.pop(name)
                at = left.below
                for x, k in own:
                    at += k
                    if at > left.rank:
                        found[name] = x
                        break
        if not open_:
            return found
        counts = []
        for name, s in open_.items():
            a, b = row[f"{name}_cut"]
            x = F.when(s.inside(values[name]), values[name])
            counts += [F.count_if(x < a).alias(f"{name}_under"), F.count_if((x >= a) & (x <= b)).alias(f"{name}_in")]
        exact = df.agg(*counts).first()
        for name, s in open_.items():
            (a, b), under, inside, left = row[f"{name}_cut"], exact[f"{name}_under"], exact[f"{name}_in"], row[f"{name}_n"]
            rank = s.rank - s.below
            if rank < under:  # the sketch was off: go on below, or above, its bounds
                s.high, s.n = math.nextafter(a, -math.inf), under
            elif rank < under + inside:
                s.low, s.high, s.n, s.below = a, b, inside, s.below + under
            else:
                s.low, s.n, s.below = math.nextafter(b, math.inf), left - under - inside, s.below + under + inside
    raise RuntimeError("selection did not settle")


def exact_percentiles(df: DataFrame, columns: dict[str, Column], share: float, most: int = 20_000) -> dict[str, float | None]:
    """name -> the percentile of a column's values (null is none), interpolated between the two nearest, as ``percentile`` gives it."""
    if not 0 <= share <= 1:
        raise ValueError("share must be from 0 to 1")
    names = list(columns)
    if not names:
        return {}
    counts = df.agg(*[F.count(columns[c]).alias(f"n{k}") for k, c in enumerate(names)]).first()
    values, ranks, want = {}, {}, {}
    for k, c in enumerate(names):
        n = counts[f"n{k}"]
        if n:
            place = share * (n - 1)
            want[c] = (place - math.floor(place), f"a{k}", f"b{k}")
            for side, rank in (("a", math.floor(place)), ("b", math.ceil(place))):
                values[f"{side}{k}"], ranks[f"{side}{k}"] = columns[c], (n, rank)
    found = _select(values, df, ranks, most)
    return {c: None if c not in want else found[want[c][1]] + (found[want[c][2]] - found[want[c][1]]) * want[c][0] for c in names}
