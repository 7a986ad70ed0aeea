"""Substring deduplication over sliding spans of sentences.

A sentence ends after a final mark (. ! ? and the like, followed by white space) and at a blank line. Each run of SPAN
consecutive sentences is hashed after normalising (lower case, words only); a run with fewer than SPAN_WORDS words is lengthened
until it has them, once to the right from each first sentence and once to the left from each last one. Runs meet globally by
hash; all but the first occurrence (by doc_id, then position) are repeats, and each sentence inside one is removed.

Text that has few final marks, and passages that begin and end inside sentences, need more: sentences are cut further into
pieces at places that their words name: of each WINDOW consecutive gaps between words without a sentence's end, the one whose
two words have the least hash. So no piece has more than WINDOW words, and where a sentence is cut depends on the WINDOW words
around the place, not on where a sentence or a line begins. Runs of whole pieces with at least PIECE_WORDS words (to the right
from each first piece) are spans too, and remove the pieces inside them. One sentence of fewer
words that documents share, alone or beside one other that is short, is no span.

A passage of over 50 words that repeats word for word shares a run of pieces with its copies wherever it begins and ends and
however its lines break: its cuts agree but for the WINDOW - 1 gaps at either end; the first of them is at word 2 * WINDOW - 1 at
most, and a run of pieces from there ends PIECE_WORDS + WINDOW - 1 words later, by word 44 of 51. What can stay of the passage are the
words up to its first common cut and those after the last run that ends inside it, less than a piece before its last common cut.

Texts travel in compressed blocks (see blocks.py). A block sends each distinct hash once, with its least doc_id, so a frequent
passage has at most one row a block in the global window; only hashes that an earlier document of another block has go
back to a block, which decides the rest by itself. No list of the documents of a passage is ever made. The hash has 128 bits.

Defined cases: null and empty texts have no sentence and stay as they are; a text with fewer than SPAN sentences and fewer than
PIECE_WORDS words, or with fewer than SPAN_WORDS words, has no span; rows with the same doc_id count as one document
for each other (neither removes the other's sentences); a null doc_id comes after all others; an empty table gives
an empty result; ids are integers, or strings of digits; texts of any length are read whole; other columns pass through
``remove_repeats`` (``n_sentences`` and ``n_removed``, which count pieces, are replaced).
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from barloom.llm.blocks import batches_of, pack
from barloom.llm.common import table

SPAN = 3
SPAN_WORDS = 10
WINDOW = 7
PIECE_WORDS = 25  # at most 53 - 4 * WINDOW, for passages of 51 words
BLOCK_CHARS = 4 << 20

_SLICE = 1 << 20
_LAST_ID = 2**63 - 1
_WORD, _SPACE, _LINE, _MARK = 1, 2, 3, 4
_MARKS = ".!?…。！？"
_PRIMES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    every, kinds = "".join(map(chr, range(0x110000))), np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_WORD, r"\w+"), (_SPACE, r"\s+"), (_LINE, r"\n"), (_MARK, f"[{_MARKS}]")):
        for m in re.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    return kinds


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _lowered(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):  # a few letters are longer in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of the values from each start to the next, that depends on their order."""
    at = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    return np.add.reduceat(_mixed(values + at.astype(np.uint64) * _PRIMES[1]), starts)


def _words(low: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, begins a sentence) of each word."""
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[codes]
    edges = np.diff((kinds == _WORD).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), np.zeros(0, bool)
    hashes = []
    firsts = np.unique(np.searchsorted(starts, np.arange(0, len(codes), _SLICE)))
    for a, b in zip(firsts, [*firsts[1:], len(starts)], strict=True):
        if a < b:
            own = np.arange(starts[a], ends[b - 1])[kinds[starts[a] : ends[b - 1]] == _WORD]  # letters only
            sizes = ends[a:b] - starts[a:b]
            hashes.append(_mixed(_sums(codes[own] * _PRIMES[0], np.cumsum(sizes) - sizes) + sizes.astype(np.uint64)))

    def between(kind: np.ndarray) -> np.ndarray:
        count = np.concatenate([[0], np.cumsum(kind, dtype=np.int32)])
        return count[starts[1:]] - count[ends[:-1]]

    line = kinds == _LINE
    lines = between(line)
    stops = ((between(kinds == _MARK) > 0) & (between(line | (kinds == _SPACE)) > 0)) | (lines > 1)
    return starts, ends, np.concatenate(hashes), np.concatenate([[True], stops])


def _cuts(hashes: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The words that begin a piece."""
    gaps = _mixed(hashes[:-1] * _PRIMES[0] + hashes[1:]) | np.uint64(1)
    gaps[stops[1:]] = 0
    begins = stops.copy()
    if len(gaps) >= WINDOW:
        least = np.lib.stride_tricks.sliding_window_view(gaps, WINDOW).argmin(axis=1)
        begins[least + np.arange(len(least)) + 1] = True
    return np.flatnonzero(begins)


def _cut_up(text: str | None):
    """(bounds in the text, number of words, whether it begins a sentence, hash, hash) of the pieces, which cover the text, and
    (low, starts, ends, cuts)."""
    low = _lowered(text or "")
    starts, ends, hashes, stops = _words(low)
    if not len(starts):
        return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((2, 0), np.uint64), (low, starts, ends, starts)
    cuts = _cuts(hashes, stops)
    bounds = np.concatenate([[0], starts[cuts[1:]], [len(low)]])
    return bounds, np.diff(np.append(cuts, len(starts))), stops[cuts], np.stack([_sums(hashes * p, cuts) for p in _PRIMES]), (low, starts, ends, cuts)


def pieces_of(text: str | None) -> list[tuple[int, int, str, int, bool]]:
    """(start, end, normalised words, number of words, begins a sentence) of each piece; they cover the text."""
    bounds, sizes, begins, _, (low, starts, ends, cuts) = _cut_up(text)
    words = [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    own = zip(bounds[:-1].tolist(), bounds[1:].tolist(), cuts.tolist(), sizes.tolist(), begins.tolist(), strict=True)
    return [(a, b, " ".join(words[k : k + n]), n, first) for a, b, k, n, first in own] if words else []


def _lengthened(ends: np.ndarray, span: int, least: int, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of runs of at least span units and least words, to the right from each unit, and if asked to the left."""
    n, at = len(ends) - 1, np.arange(len(ends))
    right = np.maximum(np.searchsorted(ends, ends + least), at + span)
    if not both:
        return at[right <= n], right[right <= n]
    left = np.minimum(np.searchsorted(ends, ends - least, side="right") - 1, at - span)
    return np.concatenate([at[right <= n], left[left >= 0]]), np.concatenate([right[right <= n], at[left >= 0]])


def _runs(sizes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """[first, last) in pieces: runs of whole sentences, and runs of pieces."""
    n, ends = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
    edges = np.append(np.flatnonzero(begins), n)  # of sentences
    whole = [edges[x] for x in _lengthened(ends[edges], SPAN, SPAN_WORDS, True)]
    parts = _lengthened(ends, 1, PIECE_WORDS, False)
    first, last = (np.concatenate(x) for x in zip(whole, parts, strict=True))
    return np.stack(np.divmod(np.unique(first * (n + 1) + last), n + 1), axis=1)


def runs_of(pieces: list[tuple[int, int, str, int, bool]]) -> list[tuple[int, int]]:
    """[first, last) of the runs to hash."""
    if not pieces:
        return []
    return [tuple(r) for r in _runs(np.array([p[3] for p in pieces], np.int64), np.array([p[4] for p in pieces], bool)).tolist()]


def _spans(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bounds of the pieces, and [first, last) and both hashes of the runs."""
    bounds, sizes, begins, own, _ = _cut_up(text)
    runs = _runs(sizes, begins) if len(sizes) else np.zeros((0, 2), np.int64)
    first, size = runs[:, 0], runs[:, 1] - runs[:, 0]
    # sums of hashes times powers of an odd number, taken back to where a run begins: one step a run, however long it is
    hashes = np.zeros((2, len(runs)), np.uint64)
    for k, p in enumerate(_PRIMES):
        power, back = (np.cumprod(np.append(np.uint64(1), np.full(len(sizes), x, np.uint64))) for x in (p, np.uint64(pow(int(p), -1, 1 << 64))))
        upto = np.append(np.uint64(0), np.cumsum(own[k] * power[:-1]))
        hashes[k] = _mixed((upto[first + size] - upto[first]) * back[first] + size.astype(np.uint64))
    return bounds, runs, hashes.view(np.int64)


def _ordered(h1: np.ndarray, h2: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by hash, then by others, and where a new hash begins in it."""
    order = np.lexsort((*reversed(then), h2, h1))
    h1, h2 = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return order, new


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with repeated sentences removed from the text, n_sentences and n_removed."""
    fields = [f for f in docs.schema.fields if f.name not in ("n_sentences", "n_removed")]
    names = [f.name for f in fields]
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID))
    own = F.struct(*[F.col(f"`{n}`") for n in names if n != text_col])
    rows = docs.select(F.struct(doc.alias("doc"), F.col(text_col).isNull().alias("none"), own.alias("own")).alias("id"), F.col(text_col).alias("text"))
    packed, _ = pack(rows, "id", "text", block_chars, by=("id.doc", "text"))

    def spans_of(block: pa.Table):
        """The rows of a block, the bounds of their pieces, and (row, first, last, hash, hash) of all runs."""
        ids, texts, bounds, runs = [], [], [], [np.zeros((0, 5), np.int64)]
        for batch in batches_of(block):
            ids.append(batch.column("id"))
            for text in batch.column("text").to_pylist():
                own_bounds, own_runs, hashes = _spans(text)
                runs.append(np.column_stack([np.full(len(own_runs), len(texts)), own_runs, hashes.T]))
                texts.append(text)
                bounds.append(own_bounds)
        return pa.concat_arrays(ids), texts, bounds, np.concatenate(runs)

    def doc_of(ids: pa.Array) -> np.ndarray:
        return ids.flatten()[0].to_numpy()

    def send(key, block):
        ids, _, _, runs = spans_of(block)
        h1, h2, doc = runs[:, 3], runs[:, 4], doc_of(ids)[runs[:, 0]]
        order, new = _ordered(h1, h2, doc)
        at = order[new]
        return pa.table({"block": pa.array(np.full(len(at), key[0].as_py()), pa.int32()), "h1": h1[at], "h2": h2[at], "doc": doc[at]})

    def cut(key, earlier, block):
        ids, texts, bounds, runs = spans_of(block)
        doc = doc_of(ids)
        # a hash that an earlier document of another block has comes before all of this block
        n = len(earlier)
        h1, h2 = (np.concatenate([earlier.column(h).to_numpy(), runs[:, k]]) for h, k in (("h1", 3), ("h2", 4)))
        docs_ = np.concatenate([np.full(n, -(2**63)), doc[runs[:, 0]]])
        row, first = (np.concatenate([np.full(n, -1), runs[:, k]]) for k in (0, 1))
        order, new = _ordered(h1, h2, docs_, row, first)
        repeat = docs_[order] > docs_[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
        repeat[1:] |= ~new[1:] & (row[order][1:] == row[order][:-1])  # an earlier run of this text
        gone = runs[np.sort(order[repeat & (row[order] >= 0)]) - n]
        by_row = np.searchsorted(gone[:, 0], np.arange(len(texts) + 1))
        removed = np.zeros(len(texts), np.int64)
        for r in np.unique(gone[:, 0]).tolist():
            mine = gone[by_row[r] : by_row[r + 1]]
            depth = np.zeros(len(bounds[r]), np.int64)
            np.add.at(depth, mine[:, 1], 1)
            np.add.at(depth, mine[:, 2], -1)
            kept = np.cumsum(depth)[:-1] == 0
            removed[r] = len(kept) - kept.sum()
            edges = np.diff(kept.astype(np.int8), prepend=0, append=0)
            pairs = zip(bounds[r][edges == 1].tolist(), bounds[r][edges == -1].tolist(), strict=True)
            texts[r] = "".join(texts[r][a:b] for a, b in pairs)
        _, none, own = ids.flatten()
        columns = iter(own.flatten())
        texts_ = pa.array([None if x else t for x, t in zip(none.to_pylist(), texts, strict=True)], pa.string())
        out = {name: texts_ if name == text_col else next(columns) for name in names}
        return pa.table(out | {"n_sentences": pa.array([len(b) - 1 for b in bounds], pa.int64()), "n_removed": removed})

    sent = packed.groupBy("block").applyInArrow(send, "block int, h1 long, h2 long, doc long")
    least = F.min("doc").over(Window.partitionBy("h1", "h2"))
    earlier = sent.withColumn("least", least).filter("doc > least").select("block", "h1", "h2")
    out = StructType([*fields, StructField("n_sentences", LongType()), StructField("n_removed", LongType())])
    return earlier.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(cut, out)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", "text")
