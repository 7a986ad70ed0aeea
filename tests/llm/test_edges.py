"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import bpe, decontamination, exact_dedup, filter_audit, html_extract, language_id, merkle_manifest, minhash_dedup, ngram_join, secret_scan, substring_dedup, suffix_dedup, url_filter

CLASHES = "doc node key id rep n grp hash part block share digest blob __id __gone __digest __runs __doc __html lang_pred score items spans kept n_removed run a b".split()
LONG = " ".join(f"word{k % 5000} and" for k in range(60_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "The quick brown fox jumps over the lazy dog near the river bank today", "en"), (2, None, "en"), (3, "", None), (4, "12 34", "de"), (5, LONG, "en"), (None, "A text without an id, of a few words only", "en")]
    rows += [(7, rows[0][1], "en"), (7, rows[0][1], "en"), (8, "Der schnelle braune Fuchs springt heute nicht ueber den faulen Hund am Fluss", "de"), (8, "One id, another text of its own", None)]
    df = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES]).cache()


OPERATORS = {
    "bpe": lambda d: bpe.digests(d), "predict": lambda d: language_id.predict(d, language_id.fit(d)), "groups": lambda d: ngram_join.similar_groups(d), "copies": lambda d: exact_dedup.group_copies(d),
    "repeats": lambda d: substring_dedup.remove_repeats(d), "suffix": lambda d: suffix_dedup.remove_substrings(d), "secrets": lambda d: secret_scan.by_path(d, secret_scan.scan(d)),
    "near": lambda d: minhash_dedup.near_duplicates(d), "manifest": lambda d: merkle_manifest.manifest(d, "doc_id", "lang", ["doc_id", "source", "lang", "text"]),
    "hits": lambda d: decontamination.find_hits(d, d.sparkSession.createDataFrame([("i", "quick brown fox"), (None, None)], "item_id string, text string")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_each_row_whatever_it_holds(docs, name):
    assert OPERATORS[name](docs).count() == docs.count()
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_audit_of_long_texts_and_clashing_columns(spark, docs):
    labels = spark.createDataFrame([(5, 1, 0), (7, 1, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(docs, labels).collect()}
    assert len(got) == 600 and {r["part"] for r in got.values()} == {""}
    # only the long text has 50 words; its words repeat, so B removes it; rows 7 and the empty text after the null one are copies
    assert (got["ABCDE", 1]["removed"], got["ABCDE", 2]["removed"], got["BACDE", 1]["good_lost"], got["EABCD", 1]["removed"], got["EABCD", 1]["toxic_lost"]) == (9, 1, 1, 3, 2)
    assert got["ABCDE", 5]["kept"] == 0 and got["ABCDE", 5]["redundant"] == 3


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_and_whole_rows(spark, data, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, data)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    ids = sorted((r[0] is None, r[0] or 0) for r in out.select("doc_id").collect())
    want = {
        "language_id": [1, 5, 7, 7, 8, 8, None], "exact_dedup": [1, 2, 4, 5, 8, 8, None], "ngram_join": [1, 2, 3, 4, 5, 8, 8, None],
        "decontamination": [1, 2, 3, 4, 5, 7, 7, 8, 8, None], "bpe": [1, 2, 3, 4, 5, 7, 7, 8, 8, None],
    }[name]
    assert ids == sorted((i is None, i or 0) for i in want)


def test_pages_with_clashing_columns(spark):
    page = "<p>" + "The words of the page are all of them in the text. " * 5 + "</p>"
    rows = [(1, "http://a.net/", page), (1, "http://a.net/", page), (2, None, None), (None, "x", ""), (4, "http://b.org/fr/x", page * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("x").alias(c) for c in (*CLASHES, "host", "path", "fit", "text", "rule")])
    out = html_extract.extract_text(pages).collect()
    assert sorted(len(r["text"]) > 0 for r in out) == [False, False, True, True, True]
    got = sorted((str(r["page_id"]), r["verdict"], r["rule"]) for r in url_filter.filter_urls(pages).collect())
    assert got == [("1", "block", "net/"), ("1", "block", "net/"), ("2", "allow", None), ("4", "allow", "org/fr/"), ("None", "allow", None)]
