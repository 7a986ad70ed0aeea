"""Exact deduplication by skew-safe combining.

Three stages, each keyed by the digest AND the whole normalised text, so that an equal digest alone never makes
two rows equal: (1) every task deduplicates what it reads (map-side combining), (2) what is left meets by
(digest, salt), so that a text that a third of the rows share is spread over SALTS tasks, (3) the at most
SALTS winners of a text meet by digest. Stage 3 also counts the different texts of each digest. Class figures go
back to every row by digest alone where that count is one, which stage 3 has established by comparing texts;
rows of any other digest are joined by digest and text. The join back is a plain shuffled one, which adaptive
execution splits where one text is frequent.

Defined cases: null text is the empty text; all empty texts are equal to each other; an empty table gives an empty
result; a null id counts as larger than any other; rows that agree in id and text are copies like any others:
``group_copies`` marks each of them kept, ``drop_copies`` keeps one. Other columns, whatever their names, are not
read by ``group_copies`` and pass through ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import fresh, table, written

SALTS = 16
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def classes_of(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """rows (id, norm, digest) -> one row per text: digest, content (null if the digest has one text only), keep_id, n."""
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "norm")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        .groupBy("digest", "norm")
        .agg(F.min("id").alias("keep_id"), F.sum("n").alias("n"))
    )
    # a digest with several texts: never seen with SHA-256, but decided by comparing, not by trust
    shape = F.struct("keep_id", "n")
    least = (
        salted.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("texts"), F.min(shape).alias("one"))
        .select("digest", "texts", "one.keep_id", "one.n")
    )
    return least


def group_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (hex SHA-256 of the normalised text)."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("digest", F.sha2("norm", 256))
    per_digest = written(classes_of(rows, salts), "copies")
    found = _with_class(rows.select("id", "digest"), per_digest.filter("texts = 1").drop("texts"), ["digest"])
    mixed = per_digest.filter("texts > 1").select("digest")
    if not mixed.isEmpty():
        again = rows.join(mixed, "digest", "left_semi")
        exact = again.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        found = found.unionByName(_with_class(again, exact, ["digest", "norm"]))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )


def _with_class(rows: DataFrame, classes: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(classes, on).select("id", "digest", "keep_id", "n")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    id_, own, kept_, n = (fresh(x) for x in ("id", "digest", "kept", "n"))
    kept = group_copies(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text").filter("kept")
    kept = kept.groupBy(F.col("id").alias(id_), F.col("digest").alias(kept_)).agg(F.count(F.lit(1)).alias(n))
    kept = written(kept, "kept")
    here = docs.withColumn(own, F.sha2(normalised(F.col(text_col)), 256))
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(kept_))
    out = here.join(kept, same, "left_semi")
    if not kept.filter(F.col(n) > 1).isEmpty():
        out = out.dropDuplicates([id_col, own])
    return out.drop(own)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept,
       sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
