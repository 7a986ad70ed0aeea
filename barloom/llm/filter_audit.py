"""Audit of how filters interact: what each filter removes, in every order that they can be applied in.

Every document's failures are one number (a bit a filter). The documents are crossed with the orders (120 of five
filters, a table that is broadcast since its size is fixed by the number of filters), each pair's first failing step
is computed, its steps are exploded, and a conditional sum by (part, order, step) is combined within each task
before anything is shuffled: what a task sends is at most a row for each part, order and step, whatever it has
read. Texts are read once (in Arrow batches, where splitting words costs a fraction of what regular expressions do); only flags
and digests are shuffled after that. Copies are found by a minimum by
digest, combined in each task too; only digests that occur twice are joined back.

Defined cases: null text is the empty text, which has no word and fails only the length filter (and the copy filter, where a
smaller id's text is empty as well); texts of any length are judged whole; repeated rows are documents each, and don't
make each other copies, since their id isn't smaller; a null id is neither smaller nor larger than any, so it is never
a copy, and has no label; several labels of an id count once, as 1 if any is 1; a null source is the part of the empty source;
an empty table has no part and gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import table, text_of, written

FILTERS = "ABCDE"  # short, repetitive, upper case, signs, copies
UPPER, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: str) -> int:
    """The failures that a text alone decides: a bit for each of A to D. Words part at ASCII white space."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    failed = (
        len(words) < 50,
        100 * len(set(words)) < 65 * len(words),
        100 * (len(data) - len(data.translate(None, UPPER))) > 5 * len(text),
        len(data.translate(None, SIGNS)) < len(data),
    )
    return sum(1 << k for k, x in enumerate(failed) if x)


def flagged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, fails, digest): one pass over the texts, a text at a time."""
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), part.alias("part"), text_of(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            fails, digest = [], []
            for t in batch.column("text"):
                text = t.as_py()
                fails.append(failures(text))
                digest.append(sha256(text.encode("utf-8", "surrogatepass")).digest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(fails, pa.int32()), pa.array(digest, pa.binary())], names=["id", "part", "fails", "digest"])

    return rows.mapInArrow(run, "id long, part string, fails int, digest binary")


def orders_of(spark: SparkSession, filters: str) -> DataFrame:
    """(ord, filter_order, bits): every permutation of the filters; bits by step."""
    rows = [(k, "".join(p), [1 << filters.index(x) for x in p]) for k, p in enumerate(permutations(filters))]
    return spark.createDataFrame(rows, "ord int, filter_order string, bits array<int>")


def replayed(flags: DataFrame, orders: DataFrame, steps: int) -> DataFrame:
    """flags (part, fails, good, toxic) -> (part, ord, step, counts): each row judged in every order, at every step."""
    crossed = flags.crossJoin(F.broadcast(orders.select("ord", "bits")))
    fails = lambda k: F.col("fails").bitwiseAND(F.get("bits", F.lit(k))) > 0
    first = F.lit(steps + 1)
    for k in range(steps - 1, -1, -1):
        first = F.when(fails(k), k + 1).otherwise(first)
    each = crossed.withColumn("first", first).select("part", "ord", "fails", "good", "toxic", "first", F.posexplode("bits").alias("at", "bit"))
    each = each.withColumn("step", F.col("at") + 1)
    here = F.col("first") == F.col("step")
    counts = {
        "kept": F.col("first") > F.col("step"),
        "removed": here,
        "redundant": (F.col("first") < F.col("step")) & (F.col("fails").bitwiseAND(F.col("bit")) > 0),
        "unique_fails": F.col("fails") == F.col("bit"),
        "good_lost": here & F.col("good"),
        "toxic_lost": here & F.col("toxic"),
    }
    return each.groupBy("part", "ord", "step").agg(*[F.count_if(c).alias(name) for name, c in counts.items()])


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """rows (id, digest, fails), a stored table, with the bit set where a smaller id has the same text."""
    least = rows.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    # a sorted join: adaptive execution splits it where a text has very many copies
    return rows.join(least.hint("merge"), "digest", "left").withColumn("fails", F.col("fails") + F.when(copy, bit).otherwise(0)).drop("digest", "least")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order and step: part, filter_order, step, the counts, and shapley (the filter's removals over all orders)."""
    rows = with_copies(written(flagged(docs, id_col, text_col, part_col), "flags"), 1 << FILTERS.index("E"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    known = rows.join(marks.hint("merge"), "id", "left").select("part", "fails", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    orders = orders_of(docs.sparkSession, FILTERS)
    found = replayed(known, orders, len(FILTERS)).join(F.broadcast(orders.select("ord", "filter_order")), "ord")
    own = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return found.select("part", "filter_order", "step", *COUNTS, F.sum("removed").over(own).alias("shapley"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
     w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
     l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
     f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                  {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
                   'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text),
                   'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > least, false)} AS fails
           FROM w LEFT JOIN l USING (doc_id)),
     p AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
     letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
     orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
                WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
     s AS (SELECT p.*, filter_order, step, substr(filter_order, step, 1) AS letter,
                  coalesce(list_min(list_filter(range(1, 6), lambda k: CASE substr(filter_order, k, 1) WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END)), 6) AS first,
                  CAST(fails.A AS INT) + CAST(fails.B AS INT) + CAST(fails.C AS INT) + CAST(fails.D AS INT) + CAST(fails.E AS INT) AS failing
           FROM p, orders, (SELECT unnest(range(1, 6)) AS step)),
     o AS (SELECT *, CASE letter WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END AS own FROM s),
     g AS (SELECT part, filter_order, CAST(step AS INT) AS step, letter,
                  sum(CASE WHEN first > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN first = step THEN n ELSE 0 END) AS removed,
                  sum(CASE WHEN first < step AND own THEN n ELSE 0 END) AS redundant, sum(CASE WHEN own AND failing = 1 THEN n ELSE 0 END) AS unique_fails,
                  sum(CASE WHEN first = step AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN first = step AND toxic THEN n ELSE 0 END) AS toxic_lost
           FROM o GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM g
"""
