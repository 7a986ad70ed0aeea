"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before has kept, and returns a DataFrame; all
but the last return the columns of documents. ``run`` writes each stage's rows as Parquet in the shared folder and
reads them again as the next stage's docs. The last stage returns the digests of op2 for what is left.

No ORACLE_SQL: language ID is a fitted model, the join works on hashed shingle sets, and BPE is a tokenizer's; the tests
hold the whole run against a brute-force version. Every stage takes texts of any length, empty tables, and other columns under any name,
which pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import bpe, decontamination, exact_dedup, language_id, ngram_join
from barloom.llm.common import table, written

ORACLE_SQL = None


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text is null or has no letter, and all rows if no label can be learned from; repeated rows share their fate."""
    return language_id.keep_languages(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text, that with the smallest id (a null id is the greatest); null and empty texts are one text."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the id that is smallest in each group, with all its rows; rows without words or without an id stay."""
    return ngram_join.drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated rows; rows without words stay, and all do if the benchmark is empty."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row, null ids and repeated rows included; null and empty texts have no token."""
    return bpe.digests(docs)


STAGES = [
    ("language_id", tell_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", decontaminate),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
