"""Language identification by known words first, with a backoff to ever shorter character n-grams.

Fitting counts words by language over labelled rows, and the n-grams (LONGEST down to 1 characters, with word ends
marked) of those words. Equal texts of a language count once. A language of up to ``fit_rows`` different texts is learned
from all of them, a more frequent one from a sample by hash of about ``fit_rows``; the model keeps the ``max_words`` words and ``max_grams`` n-grams with the highest counts of each language. These three bounds are
the model's size, which is what makes it safe to send it to every task; prediction then reads whole texts.

A word in the word list scores its log frequency per language. A word that is not scores the mean log frequency of
its n-grams of the greatest length of which any is known, going from LONGEST to 1. The language with the greatest sum
over the text wins; its score is its share of the probability. Ties go to the first language in order.

Defined cases: null text, and text without a letter, is ``und`` with score 0; so is every text if nothing could be
learned (an empty table or no labels); the language column is never read by ``predict``; rows are independent, so
repeated rows get the same answer; other columns pass through ``predict`` (``lang_pred`` and ``score`` are replaced).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from barloom.llm.common import table, written

FIT_ROWS = 20_000
MAX_WORDS = 50_000
MAX_GRAMS = 50_000
LONGEST = 5
SALTS = 16
UNDECIDED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams_of(word: str, n: int) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Model:
    """Log frequencies by language. A plain object: it is pickled and sent to the tasks."""

    def __init__(self, words: dict[tuple[str, str], int], grams: dict[tuple[str, str], int]):
        self.langs = sorted({lang for lang, _ in words})
        self.words, self.word_log = self._table(words)
        self.grams, self.gram_log = self._table(grams)

    def _table(self, counts: dict[tuple[str, str], int]):
        at: dict[str, int] = {}
        for _, x in counts:
            at.setdefault(x, len(at))
        m = np.full((len(at) + 1, len(self.langs)), 0.5)
        for (lang, x), n in counts.items():
            m[at[x], self.langs.index(lang)] += n
        # the n-grams of a length compete with each other, and so do the words; one total will do for differences
        return at, np.log(m / m.sum(axis=0, keepdims=True))

    def unseen(self, word: str) -> np.ndarray:
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            known = [self.grams[g] for g in grams_of(word, n) if g in self.grams]
            if known:
                return np.add.reduce(self.gram_log[known]) / len(known)
        return np.zeros(len(self.langs))

    def score(self, words: list[str], memo: dict[str, np.ndarray]) -> tuple[str, float]:
        if not words or not self.langs:
            return UNDECIDED, 0.0
        rows, times, other, often, total = [], [], [], [], np.zeros(len(self.langs))
        for w, n in Counter(words).items():
            at = self.words.get(w)
            if at is not None:
                rows.append(at)
                times.append(n)
            else:
                if w not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[w] = self.unseen(w)
                other.append(memo[w])
                often.append(n)
        if rows:
            total = total + np.asarray(times, float) @ self.word_log[rows]
        if other:
            total = total + np.asarray(often, float) @ np.asarray(other)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def fit_sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Different (text, lang) to learn from: all of a language, or a share by hash of about fit_rows of them."""
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna().withColumn("hash", F.xxhash64("text"))
    of = 1 << 30
    n = labelled.select("lang", "hash").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = n.select("lang", F.when(F.col("n") <= fit_rows, of).otherwise(F.floor(F.lit(float(of * fit_rows)) / F.col("n"))).alias("share"))
    picked = labelled.join(F.broadcast(share), "lang").filter(F.pmod("hash", F.lit(of)) < F.col("share"))  # a row a language, as in the model
    return picked.dropDuplicates(["lang", "hash"]).select("text", "lang")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    labelled = fit_sample(docs, text_col, lang_col, fit_rows)

    def count_words(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                seen: dict[str, Counter] = {}
                for text, lang in zip(some.column("text").to_pylist(), some.column("lang").to_pylist(), strict=True):
                    seen.setdefault(lang, Counter()).update(words_in(text))
                yield _counts({(lang, w): n for lang, own in seen.items() for w, n in own.items()})

    def count_grams(batches):
        for batch in batches:
            seen: Counter = Counter()
            for lang, word, n_ in zip(*(batch.column(c).to_pylist() for c in ("lang", "x", "n")), strict=True):
                for size in range(1, LONGEST + 1):
                    for g in grams_of(word, size):
                        seen[lang, g] += n_
            yield _counts(seen)

    shape = "lang string, x string, n long"
    # read by the word list and by the n-grams
    words = written(labelled.mapInArrow(count_words, shape).groupBy("lang", "x").agg(F.sum("n").alias("n")), "words")
    grams = words.mapInArrow(count_grams, shape).groupBy("lang", "x").agg(F.sum("n").alias("n"))
    return Model(_top(words, max_words), _top(grams, max_grams))


def _counts(seen: dict[tuple[str, str], int]) -> pa.RecordBatch:
    lang, x = zip(*seen, strict=True) if seen else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(x, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "x", "n"])


def _top(counts: DataFrame, most: int) -> dict[tuple[str, str], int]:
    """The most frequent of each language: those of each salted part, and of these, however many there were, at most SALTS * most."""
    order = F.desc("n"), "x"
    parts = counts.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)))
    parts = parts.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("at") <= most)
    top = parts.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("at") <= most)
    found = top.select("lang", "x", "n").toArrow()
    return dict(zip(zip(found["lang"].to_pylist(), found["x"].to_pylist(), strict=True), found["n"].to_pylist(), strict=True))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # at most the bounds above
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]

    def run(batches):
        m, memo = cloudpickle.loads(sent.value), {}
        for batch in batches:
            got = [m.score(words_in(t) if t and any(map(str.isalpha, t)) else [], memo) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lang_pred", "score"])

    out = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select(*[f"`{f.name}`" for f in fields]).mapInArrow(run, out)


def held_out(id_: Column) -> Column:
    """A fifth of the documents, by id: never learned from. A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 5 == 0


def keep_languages(docs: DataFrame) -> DataFrame:
    """The rows whose language can be told, with the columns of docs; learned from the labels that docs has."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, model).filter(F.col("lang_pred") != UNDECIDED).select(*docs.columns)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
