"""HyperMinHash near-duplicates against all pairs of plain Python sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import minhash_dedup as m


def plain_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    return {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()


def plain_components(rows):
    """doc_id -> (set size, component); ids are unique."""
    sets = {i: plain_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, where = sorted(sets), {}
    for i in ids:
        for x in sets[i]:
            where.setdefault(x, []).append(i)
    for i in ids:
        for j in {j for x in sets[i] for j in where[x] if j < i}:
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def varied(rng, words, share):
    return [f"x{rng.randrange(10**9)}" if rng.random() < share else w for w in words]


def some_rows(seed, groups=12, crowd=150):
    rng, texts = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 7, 9, 20, 60, 300, 1500]))]
        n = crowd if g == 0 else rng.choice([1, 2, 3, 8])
        for _ in range(n):
            kind = rng.random()
            words = varied(rng, base, rng.choice([0, 0.01, 0.03, 0.05]))
            texts.append(" ".join(words if kind < 0.7 else words[: max(1, int(len(words) * 0.87))]))
    line = " ".join(f"common{k}" for k in range(40))
    texts += [line + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.choice([5, 20, 60]))) for _ in range(80)]
    texts += ["", "one", "One", "one two", "a b c", "A  b\tc", "a b c d", "é È", "é è"]
    rng.shuffle(texts)
    return [(3 * k + 1, t) for k, t in enumerate(texts)] + [(100_000, None)]


@pytest.mark.parametrize(("small", "crowd", "block"), [(64, 2048, 512), (4, 30, 16)])
def test_components_equal_all_pairs(spark, monkeypatch, small, crowd, block):
    for name, v in (("SMALL", small), ("CROWD", crowd), ("BLOCK", block)):
        monkeypatch.setattr(m, name, v)
    rows = some_rows(small)
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("doc", "node", "key", "size", "n", "grp", "bucket", "rep")])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in m.near_duplicates(docs.repartition(3)).collect()}
    assert got == plain_components(rows)


def test_query_equals_all_pairs(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = m.op12_minhash_dedup(spark, data).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_nulls_repeats_shared_ids_and_empty_tables(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(5, text), (5, text), (7, text + " more"), (7, "something else of its own"), (None, text), (None, None), (9, None), (9, ""), (11, "something else of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in m.near_duplicates(docs).collect())
    assert got == [(False, 5, 38, 5), (False, 5, 38, 5), (False, 7, 3, 7), (False, 7, 39, 5), (False, 9, 0, 9), (False, 9, 0, 9), (False, 11, 3, 7), (True, 0, 0, 0), (True, 0, 38, 0)]
    assert m.near_duplicates(docs.limit(0)).count() == 0
    left = m.drop_near_duplicates(docs)
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 0, 5, 5, 7, 7, 9, 9]


def test_registers_are_leading_zeros_and_mantissa_of_the_least_value():
    rng = np.random.default_rng(1)
    for n in (1, 3, 50, 5000):
        s = np.unique(rng.integers(0, 2**64, n, np.uint64))
        full = {}
        for x in s.tolist():
            full.setdefault(x >> 57, (x & (2**57 - 1)) >> 4)
        got = m.registers(s)
        for b, least in full.items():
            zeros = 53 - least.bit_length()
            assert got[b] == (zeros << 10) | (((least << zeros) >> 42) & 1023)
        assert set(got.tolist()) == {int(got[b]) for b in full}


def test_accidental_agreement_is_what_disjoint_sets_show():
    rng = np.random.default_rng(2)
    few, m.MANTISSA, old = 2, 2, m.MANTISSA
    try:
        for n, k in ((20, 20), (2000, 2000), (3000, 600)):
            pairs = [(m.registers(np.unique(rng.integers(0, 2**64, n, np.uint64))), m.registers(np.unique(rng.integers(0, 2**64, k, np.uint64)))) for _ in range(300)]
            seen = np.mean([np.mean(a == b) for a, b in pairs])
            assert abs(seen - float(m.accidental(np.array(n), np.array(k)))) < 0.02
    finally:
        m.MANTISSA = old
    assert few == 2 and float(m.accidental(np.array(5000), np.array(5000))) < 2e-4


def test_pairs_at_the_threshold_meet_and_pass_the_estimate():
    """Of 2,000 pairs at the threshold none may be lost: each has a chance of under 1e-6."""
    rng, lost = np.random.default_rng(3), 0
    for k in range(2000):
        n = (7, 13, 40, 200, 3000)[k % 5]
        union = np.unique(rng.integers(0, 2**64, n, np.uint64))
        extra = int(0.15 * len(union))
        out = rng.permutation(len(union))[:extra]
        cut = extra if k % 2 else extra // 2
        a, b = np.delete(union, out[:cut]), np.delete(union, out[cut:])
        r = np.stack([m.registers(a), m.registers(b)])
        size, one = np.array([len(a), len(b)]), np.zeros(2, int)
        meets = (m.bands(r)[0] == m.bands(r)[1]).any()
        lost += not (meets and m.may_link(r, size, one, np.array([0]), np.array([1]), 0.85)[0])
    assert lost == 0
