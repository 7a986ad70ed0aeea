"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import written

MAX_ROUNDS = 50


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself): a row a link at most, some repeated."""
    both = _both(links)
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    moved = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    return moved.filter("a <> b")


def _small(links: DataFrame) -> DataFrame:
    """The node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    ends = F.explode(F.array("b", "a")).alias("a")  # a node's own link comes with each of its rows; distinct() leaves one in the task
    return links.join(least, "a").select(ends, F.col("m").alias("b")).filter("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether different links are stars: a node with a link to a smaller one has no other, and none links to it."""
    up = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    nodes = up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs -> (node, component), the component being its smallest node; isolated nodes aren't listed.

    Nothing is gathered by component or node: a round is two minima by node, each joined back, and its links are
    written to the shared folder. It ends when the links are stars, which a round would leave as they are.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = written(links, "links")
    for _ in range(MAX_ROUNDS):
        if _settled(links):
            break
        links = written(_small(_large(links)), "links")
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def forest(pairs) -> list[tuple[int, int]]:
    """The pairs (a, b) that join what earlier pairs have not: a spanning forest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out
