import hashlib
import re

import corpus_pipeline
from barloom.llm import bpe, decontamination, ngram_join


def test_the_run_equals_its_stages_by_brute_force(spark, data):
    from tokenizers import Tokenizer

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, data).collect()}
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    docs = [(i, t) for i, t in docs if any(map(str.isalpha, t))]
    seen, distinct = set(), []
    for i, t in docs:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        if n not in seen:
            seen.add(n)
            distinct.append((i, t))
    shingle = ngram_join.Shingler()
    sets, root = [(i, set(shingle(t).tolist())) for i, t in distinct], {i: i for i, _ in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and len(s & t) * 10 >= 8 * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    left = [(i, t) for i, t in distinct if find(i) == i]
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    auto = decontamination.automaton_of(bench, decontamination.WINDOW)
    tok, want = Tokenizer.from_file(bpe.vocabulary_file()), {}
    for i, t in left:
        words = decontamination.words_of(t)
        hit = sum(b - a for a, b in decontamination.scan(words, auto)[0])
        if not (hit and hit * 20 >= len(words)):
            ids = tok.encode(t, add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert {i: (r["n_tokens"], r["ids_sha256"]) for i, r in got.items()} == want


def test_stages_keep_the_columns_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns


def test_stages_of_an_empty_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0
