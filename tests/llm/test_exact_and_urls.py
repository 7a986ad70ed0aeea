import hashlib
import re

import numpy as np
import pytest

from barloom.llm import exact_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string"


def test_classes_follow_normalised_text_ties_nulls_and_clashing_columns(spark):
    texts = [(3, "a  b"), (1, "a\tb"), (2, None), (5, ""), (4, "c"), (4, "c"), (None, "a b"), (7, " "), (8, "a b")]
    docs = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in texts], SCHEMA)
    got = exact_dedup.group_copies(docs).collect()
    assert len(got) == len(texts)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    by = {}
    for i, t in texts:
        by.setdefault(norm(t), []).append(i)
    for r in got:
        own = next(v for k, v in by.items() if hashlib.sha256(k.encode()).hexdigest() == r["digest"])
        assert r["group_size"] == len(own)
        assert r["keep_id"] == min(i for i in own if i is not None)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 7, 8]


def test_exact_dedup_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.group_copies(docs).count() == 0
    assert exact_dedup.drop_copies(docs).count() == 0


def test_texts_with_equal_digests_are_still_compared(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: exact_dedup.F.lit("same"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.group_copies(docs).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 1)}


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("https://x.example.com/de/1#f", "x.example.com", "/de/1", "example.com/de/", "block"),
        ("https://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
        ("https://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"),
        ("https://a.org/fr", "a.org", "/fr", None, "allow"),
        ("https://planet/x", "planet", "/x", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://", "", "", None, "allow"),
        ("http://h.net", "h.net", "", None, None),
    ],
)
def test_url_parts_and_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, None, "x")], "page_id long, url string, html string, host string")
    r = url_filter.filter_urls(pages).first()
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
    assert verdict is None or r["verdict"] == verdict


def test_propagation_matches_a_matrix(spark):
    rng = np.random.default_rng(3)
    n = 12
    edges = [(f"h{a}", f"h{b}", int(rng.integers(1, 4))) for a in range(n) for b in range(n) if a != b and rng.random() < 0.2]
    seeds = [(f"h{a}", float(a == 0), float(a in (1, 2)) * 0.5) for a in range(n)]
    got = url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, pages long"), spark.createDataFrame(seeds, "host string, trust double, distrust double"))
    m = np.zeros((n, n))
    for a, b, w in edges:
        m[int(a[1:]), int(b[1:])] = w
    out = m / np.maximum(m.sum(1, keepdims=True), 1)
    back = m.T / np.maximum(m.T.sum(1, keepdims=True), 1)
    want = []
    for k, step in ((1, out), (2, back)):
        seed = np.array([s[k] for s in seeds])
        r = seed
        for _ in range(url_filter.PASSES):
            r = seed + url_filter.DAMPING * step.T @ r
        want.append(r)
    for r in got.collect():
        i = int(r["host"][1:])
        assert r["trust"] == pytest.approx(want[0][i])
        assert r["distrust"] == pytest.approx(want[1][i])


def test_a_host_that_links_to_blocked_hosts_is_blocked(spark):
    pages = spark.createDataFrame(
        [(1, "http://hub.info/a", '<a href="http://bad.net/x">'), (2, "http://bad.net/x", None), (3, "http://fine.info/", "<a href='/local'>")],
        "page_id long, url string, html string",
    )
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_the_query_over_linked_pages_equals_its_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(8)
    hosts = ["a.net", "b.net", "example.com", "www.example.org", "x.info", "y.info", "Z.info", "example.net"]
    rows = []
    for k in range(60):
        h = hosts[int(rng.integers(len(hosts)))]
        links = "".join(f'<a href="http://{hosts[int(j)]}/p">x</a>' for j in rng.integers(len(hosts), size=int(rng.integers(0, 4))))
        rows.append((k, f"http://{h}/{('fr', 'de', 'en', 'p')[int(rng.integers(4))]}/{k}?q#f", links or None))
    rows += [(100, None, None), (101, "no scheme", "<a href=//a.net/>"), (102, "http://", ""), (103, "x://H.NET", "<a href='http://[bad'>"), rows[0], rows[0]]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = url_filter.op1_url_filter(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(url_filter._oracle(90))
    columns = [c[0] for c in want.description]
    key = lambda r: [(x is None, str(x)) for x in r]
    got, want = sorted(map(tuple, df.select(*columns).collect()), key=key), sorted(want.fetchall(), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(a[5:] == pytest.approx(b[5:], abs=1e-4) for a, b in zip(got, want, strict=True))
    assert any(r[5] not in (0.0, 1.0) for r in got)
