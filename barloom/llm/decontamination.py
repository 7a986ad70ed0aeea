"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark texts.

Items are cut into windows of consecutive words (13; an item with fewer words is one window). All windows go into
one automaton, which each task builds once and then runs over each document's normalised words, a single time;
a match's end is mapped back to words of the document, and from there to offsets in the original text.

Only the benchmark is sent to the tasks. Its size is checked on the driver by a sum in Spark: a benchmark with more
than ``max_bytes`` of windows is dealt to as many automata as it needs, so no task ever holds more than that. Each
automaton then reads the documents once; what it hits is kept by the text's digest, and the spans of a text are united
before its words are counted.

Words: A-Z lower-cased, then maximal runs of characters that are a-z, 0-9 or not ASCII. Working on UTF-8 bytes is the
same thing, because every byte of a character outside ASCII is above 0x7F.

Defined cases: null or wordless text has no words and is never contaminated; a null or wordless item has no window; an
empty benchmark hits nothing; repeated items all count; item ids are compared as strings, a null id is left out of the
list of items but its windows still hit; documents may be of any length; other columns are passed through by
``decontaminate`` (their names may not be ``n_words``, ``n_hit``, ``items`` or ``spans``, which it replaces).
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.llm.common import fresh, table, written

WINDOW = 13
SHARE = 20  # contaminated: at least one word in SHARE is hit
MAX_BYTES = 64 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    # b"".split() without an argument would do: the table leaves no white space but the space itself
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def windows_of(text: str | None, size: int = WINDOW) -> list[bytes]:
    words = words_of(text)
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def automaton_of(items: list[tuple[str | None, str | None]], size: int):
    """The automaton over ' w1 ... wn ' for every window, or None if there is none. Value: (words, item ids)."""
    import ahocorasick

    owners: dict[bytes, set] = {}
    for item, text in items:
        for w in windows_of(text, size):
            owners.setdefault(w, set()).add(item)
    if not owners:
        return None
    auto = ahocorasick.Automaton()
    for w, ids in owners.items():
        auto.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, sorted(i for i in ids if i is not None)))
    auto.make_automaton()
    return auto


def scan(words: list[bytes], auto) -> tuple[list[tuple[int, int]], set]:
    """Hit runs of words [first, last) in order, merged where they meet, and the items whose windows occur."""
    runs: list[list[int]] = []
    items: set = set()
    if auto is None or not words:
        return [], items
    text = f" {b' '.join(words).decode('latin-1')} "
    starts = None
    for end, (n, ids) in auto.iter(text):
        if starts is None:
            starts, at = [], 1
            for w in words:
                starts.append(at)
                at += len(w) + 1
        last = bisect_right(starts, end - 1)  # words that begin before the closing space
        first = last - n
        items.update(ids)
        while runs and runs[-1][1] >= first:
            first = min(first, runs.pop()[0])
        runs.append([first, last])
    return [tuple(r) for r in runs], items


def _offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as offsets in code points of the original text."""
    import re

    if not runs:
        return []
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


_OUT = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def dealt_items(benchmark: DataFrame, size: int, max_bytes: int) -> tuple[DataFrame, int]:
    """(item_id, text, part) and the number of parts, each of which has at most max_bytes of windows. Long items are cut
    into pieces that overlap by all but one word of a window."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    bytes_of = F.octet_length("text") * size  # a window a word
    total, most = bench.agg(F.sum(bytes_of), F.max(bytes_of)).first()
    if (total or 0) <= max_bytes:
        return bench.withColumn("part", F.lit(0)), 1
    piece = max(max_bytes // (8 * size), 1)

    def cut(batches):
        for batch in batches:
            ids, texts = [], []
            for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words, start = [w.decode("utf-8", "surrogatepass") for w in words_of(t)], 0
                while len(words):
                    end, n = start, 0
                    while end < len(words) and (n <= piece or end - start < size):
                        n += len(words[end].encode("utf-8", "surrogatepass")) + 1
                        end += 1
                    ids.append(i)
                    texts.append(" ".join(words[start:end]))
                    if end == len(words):
                        break
                    start = end - size + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["item_id", "text"])

    pieces = written(bench.mapInArrow(cut, "item_id string, text string") if most > max_bytes // 8 else bench, "pieces")
    parts = -(-total // max_bytes)
    while True:
        dealt = pieces.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
        fullest = dealt.groupBy("part").agg(F.sum(bytes_of).alias("b")).agg(F.max("b")).first()[0]
        if fullest <= max_bytes or parts >= 64 * total // max_bytes:  # by then a part holds one piece, or equal ones
            return dealt, parts
        parts *= 2


def _hits_of(text: str | None, runs: list[tuple[int, int]]) -> tuple[int, list[dict]]:
    return sum(b - a for a, b in runs), [{"start": a, "end": b} for a, b in _offsets(text or "", runs)]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in order, merged where they meet."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(r) for r in out]


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items (sorted) and spans (code points of the original text that are hit)."""
    fields = [f for f in docs.schema.fields if f.name not in ("n_words", "n_hit", "items", "spans")]
    kept = docs.select(*[f"`{f.name}`" for f in fields])
    out = StructType([*fields, *StructType.fromDDL(_OUT).fields])
    dealt, parts = dealt_items(benchmark, size, max_bytes)
    context = docs.sparkSession.sparkContext

    def items_of(part: int):
        rows = dealt if parts == 1 else dealt.filter(F.col("part") == part)
        return context.broadcast([(r["item_id"], r["text"]) for r in rows.select("item_id", "text").collect()])  # at most max_bytes / size

    def with_hits(batch, n_words, found):
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        hits = [_hits_of(t, runs) for t, (runs, _) in zip(texts, found, strict=True)]
        new = [
            pa.array(n_words, pa.int64()), pa.array([h for h, _ in hits], pa.int64()), pa.array([sorted(i) for _, i in found], pa.list_(pa.string())),
            pa.array([s for _, s in hits], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ]
        own = [batch.column(k) for k in range(len(fields))]
        return pa.RecordBatch.from_arrays([*own, *new], names=[*(f.name for f in fields), "n_words", "n_hit", "items", "spans"])

    if parts == 1:
        shared = items_of(0)

        def run(batches):
            auto = automaton_of(shared.value, size)
            for batch in batches:
                words = [words_of(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
                yield with_hits(batch, [len(w) for w in words], [scan(w, auto) for w in words])

        return kept.mapInArrow(run, out)

    # several automata: each reads all texts and keeps what it hits, by the text's digest; then spans of a text are united
    digest, hit = fresh("digest"), fresh("hit")
    texts = docs.select(F.col(text_col).alias("text")).filter("text IS NOT NULL")

    def hits_by(shared):
        def run(batches):
            auto = automaton_of(shared.value, size)
            for batch in batches:
                rows = []
                for t in batch.column("text").to_pylist():
                    runs, items = scan(words_of(t), auto)
                    if runs:
                        rows.append((t, [{"a": a, "b": b} for a, b in runs], sorted(items)))
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, names=["text", "runs", "items"])

        found = texts.mapInArrow(run, "text string, runs array<struct<a:int,b:int>>, items array<string>")
        return found.select(F.sha2("text", 256).alias(digest), "runs", "items").groupBy(digest).agg(F.first("runs").alias("runs"), F.first("items").alias("items"))

    every = None
    for part in range(parts):
        found = written(hits_by(items_of(part)), "hits")
        every = found if every is None else every.unionByName(found)
    both = every.groupBy(digest).agg(F.struct(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).alias(hit))

    def unite(batches):
        for batch in batches:
            words = [len(words_of(t)) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            found = [(merged([(r["a"], r["b"]) for r in h["runs"]]), h["items"]) if h else ([], []) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield with_hits(batch, words, found)

    joined = kept.withColumn(digest, F.sha2(F.col(text_col), 256)).join(both, digest, "left").drop(digest)
    return joined.mapInArrow(unite, out)


def contaminated(share: int = SHARE):
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows; the columns of docs."""
    return find_hits(docs, benchmark, text_col).filter(~contaminated()).select(*docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = find_hits(docs, table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


ORACLE = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     i AS (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0),
     v AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, k, k + 12), ' ') AS s FROM i),
     p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
     h AS (SELECT p.doc_id, p.k, v.n, v.item FROM (SELECT DISTINCT n FROM v) l JOIN p ON p.k + l.n - 1 <= len(p.w) JOIN v ON v.n = l.n AND v.s = array_to_string(list_slice(p.w, p.k, p.k + l.n - 1), ' ')),
     c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS k FROM h) GROUP BY doc_id),
     m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
