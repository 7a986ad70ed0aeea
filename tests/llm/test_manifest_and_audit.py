"""The Merkle manifest and the filter audit against plain Python, with nulls, ties, repeated rows and empty tables."""

import hashlib
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from barloom.llm import filter_audit, merkle_manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_levels(nodes, fan=8):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + fan]) for k in range(0, len(out[-1]), fan)])
    return out


def plain_manifest(rows, fan=8):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(enc, r))
    low = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    order = lambda x: (x is not None, x)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (order(r[0]), leaf(r)))
        trees[g] = plain_levels([leaf(r) for r in groups[g]], fan)
    top = plain_levels([trees[g][-1][0] for g in langs], fan)

    def path(levels, at):
        for level in levels[:-1]:
            first = at // fan * fan
            yield level[first:at], level[at + 1 : first + fan]
            at //= fan

    out = []
    for k, g in enumerate(langs):
        for at, r in enumerate(groups[g]):
            steps = [*path(trees[g], at), *path(top, k)]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            fold = leaf((*r[:4], low(r[4]))) if bad else leaf(r)
            for before, after in steps:
                fold = h(*before, fold, *after)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[g][-1][0], root, h(*[x for b, a in steps for x in b + a]), fold, fold == root))
    return out


def key(r):
    return [(x is None, str(x)) for x in r]


def some_docs(n):
    langs = ["en", "de", None, "", "zé", "en", "en"]
    rows = [(k, f"s{k % 3}" if k % 5 else None, langs[k % 7], k if k % 4 else None, ["Some Text é %d" % (k % 50), "all small", "", None][k % 4]) for k in range(n)]
    return rows + rows[: n // 10] + [(None, "x", "de", 3, "No Id"), (None, "x", "de", 3, "No Id"), (3, "x", "en", 1, "another text of id 3"), (1, None, "lone", 0, None)]


@pytest.mark.parametrize(("n", "levels"), [(0, 3), (40, 1), (700, 1), (700, 2), (700, 3)])
def test_manifest_equals_plain_python(spark, monkeypatch, n, levels):
    monkeypatch.setattr(merkle_manifest.tree, "__defaults__", (merkle_manifest.FAN, levels))
    rows = some_docs(n)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = merkle_manifest.manifest(docs, "doc_id", "lang", list(merkle_manifest.FIELDS), {"text": F.translate("text", merkle_manifest._UPPER, merkle_manifest._LOWER)}, tampered)
    fold = merkle_manifest.folded(F.col("other"), F.col("path"))
    got = found.select("id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("path")), fold, fold == F.col("root")).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_an_empty_table_and_of_one_row(spark, tmp_path):
    docs = spark.createDataFrame([(7, None, None, None, "A")], DOCS)
    for name, rows in (("none", docs.limit(0)), ("one", docs)):
        rows.withColumns({c: F.lit("x") for c in ("id", "grp", "node", "other", "pos", "n", "part", "path")}).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert merkle_manifest.op13_merkle_manifest(spark, f"{tmp_path}/none").count() == 0
    got = merkle_manifest.op13_merkle_manifest(spark, f"{tmp_path}/one").first()
    assert got["leaf"] == got["subroot"] == got["root"] == h("1:7", "-", "-", "-", "1:A") and got["proof_sha256"] == h()


def plain_audit(docs, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    texts = {}
    for i, _, t in docs:
        if i is not None:
            texts.setdefault(t or "", set()).add(i)
    out = {}
    flagged = []
    for i, part, t in docs:
        t = t or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        fails = ["A"] * (len(words) < 50) + ["B"] * (100 * len(set(words)) < 65 * len(words)) + ["C"] * (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t))
        fails += ["D"] * any(c in "#$%&*|" for c in t) + ["E"] * (i is not None and any(j < i for j in texts[t]))
        flagged.append((part or "", set(fails), i in good, i in toxic))
    for part in {p for p, *_ in flagged}:
        rows = [r for r in flagged if r[0] == part]
        removals = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                firsts = [(next((k for k, x in enumerate(order, 1) if x in r[1]), 6), r) for r in rows]
                here = [r for first, r in firsts if first == step]
                removals[f] += len(here)
                out[part, "".join(order), step] = [sum(first > step for first, _ in firsts), len(here), sum(first < step and f in r[1] for first, r in firsts), sum(r[1] == {f} for r in rows), sum(r[2] for r in here), sum(r[3] for r in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removals[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_audit_equals_plain_python(spark):
    words = " ".join(f"w{k}" for k in range(60))
    texts = [words, words, "short", None, "", "a " * 80, "SHOUTING " * 60, words + " 100%", "tabs\tand\nlines\x0b" * 30, "é ü " * 55, words.upper() + " #", words]
    docs = [(k, ["a", None, "", "b"][k % 4], t) for k, t in enumerate(texts)] + [(3, "a", words), (3, "a", words), (None, "b", words), (None, None, None)]
    labels = [(1, 1, 0), (1, 0, 1), (5, 1, 1), (8, 1, None), (11, 1, 0), (None, 1, 1), (6, 0, 1), (6, 0, 1)]
    have = spark.createDataFrame(docs, "doc_id long, source string, text string").select("*", *[F.lit("x").alias(c) for c in ("id", "part", "fails", "digest", "good", "ord", "step")])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit(0))
    got = filter_audit.audit(have.repartition(3), marks)
    assert got.columns == ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 3 * 600 and set(rows) == plain_audit(docs, labels)
    assert filter_audit.audit(have.limit(0), marks).count() == 0
    assert {r["good_lost"] for r in filter_audit.audit(have, marks.limit(0)).collect()} == {0}
