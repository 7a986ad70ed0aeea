"""Substring deduplication on bytes with suffix arrays built by Lyndon grouping.

A byte goes if it lies in a string of LENGTH bytes that also starts in a document with a smaller id. Four steps, each over
blocks of documents (see blocks.py); text is shuffled once, compressed, and that shuffle is read by all of them:

1. Texts are cut into chunks at places that their content names, each with the LENGTH - 1 bytes after it. A chunk whose
   bytes are in a document with a smaller id is a repeat as a whole (found by digest, with combining minima; a block
   sends a digest once, with its smallest id).
2. In what is left, the strings of LENGTH bytes are put in runs with the same minimizer: the GRAM bytes with the least
   hash in them. Equal strings have equal minimizers, so a run with a minimizer that occurs once has no repeat. Only
   the hashes of minimizers are compared, dealt by range.
3. Runs with a repeated minimizer meet by it. Of equal runs of a block only those of the block's smallest id are sent:
   in the others, all goes whatever the rest of the corpus holds. Where runs meet, their suffixes are sorted by Lyndon
   grouping (below), which makes equal strings neighbours; the smallest id of each set of neighbours decides. Sorted
   neighbours are compared over all LENGTH bytes. A minimizer of more than HOT runs is split: each string of LENGTH
   bytes of its runs meets its equals alone, so that no task gathers all contexts of a frequent minimizer.
4. Each document loses the bytes that steps 1 and 3 found.

Lyndon grouping: suffixes begin in groups of the same first byte, and groups are processed from the highest down. Each
suffix of the group at hand points to the previous suffix of a lower group; those that are pointed to leave their own
groups for new ones just above, ranked by how often they are pointed to. At the end the suffixes of a group share their
longest Lyndon prefix. Then one pass in rank order appends to its group each suffix whose next smaller suffix is
the one at hand, found by following the same pointers, and so emits the order within every group; nothing is renamed or
compared again.

Defined cases: null is the empty text; texts of fewer than LENGTH bytes lose nothing; rows with the same id count as
one document for each other; strings repeated only within a document stay; a null id counts as larger than any other;
an empty table gives an empty result; other columns are not read. A run's strings in one task are those of a range of
minimizers, at most HOT runs of each; of a string by itself, a task gets an entry a block that has it.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.blocks import batches_of, pack
from barloom.llm.common import parallelism, table, written

LENGTH = 50
GRAM = 24
CUT_GRAM, CUT_MASK, CUT_LEAST = 16, np.uint64(255), 32
BLOCK_CHARS = 4_000_000
BATCH_BYTES = 1 << 19
HOT = 8192  # runs of a minimizer over all blocks: about a batch of their bytes
_LAST_ID = 2**63 - 1
_M, _X = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


PIECE = 1 << 14  # positions at a time: what is in work stays in the processor's cache


def _piecewise(f, x: np.ndarray, width: int, kind) -> np.ndarray:
    """f over x in pieces, each with the width - 1 values after it that its last results need."""
    n = max(0, len(x) - width + 1)
    out = np.empty(n, kind)
    for i in range(0, n, PIECE):
        out[i : i + PIECE] = f(x[i : min(i + PIECE, n) + width - 1], width)
    return out


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes."""
    return _piecewise(_gram_hashes, b, k, np.uint64)


def _gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """By doubling."""
    with np.errstate(over="ignore"):
        h, n, power = (b.astype(np.uint64) + np.uint64(1)) * _X, 1, _M
        acc, have = None, 0
        rest = k
        while rest:
            if rest & 1:
                if acc is None:
                    acc, have = h, n
                else:  # n bytes of h, then have bytes of acc
                    m = len(b) - (have + n) + 1
                    acc = h[:m] * _pow(_M, have) + acc[n : n + m]
                    have += n
            rest >>= 1
            if rest:
                h = h[:-n] * power + h[n:]
                power = power * power
                n *= 2
        acc = acc ^ (acc >> np.uint64(31))
        acc *= _X
        acc ^= acc >> np.uint64(29)
        acc *= _M
        acc ^= acc >> np.uint64(32)
    return acc


def _pow(x: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(x), n, 2**64))


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    return _piecewise(_window_min, h, w, h.dtype)


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    n = 1
    size = len(h) - w + 1
    while n * 2 <= w:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[:size], h[w - n : w - n + size])


class Block:
    """The documents of a block by id and text: their bytes, one after the other."""

    def __init__(self, packs: pa.Table):
        rows = []
        for batch in batches_of(packs):
            ids = batch.column("id").to_pylist()
            rows += [(_LAST_ID if i is None else i, i is None, t.encode("utf-8", "surrogatepass")) for i, t in zip(ids, batch.column("text").to_pylist(), strict=True)]
        rows.sort()
        self.raw = b"".join(r[2] for r in rows)
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.null = [r[1] for r in rows]
        self.ends = np.cumsum([len(r[2]) for r in rows]) if rows else np.zeros(0, np.int64)
        self.starts = self.ends - np.array([len(r[2]) for r in rows], np.int64) if rows else self.ends
        self.bytes = np.frombuffer(self.raw, np.uint8)

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, doc): strings of LENGTH bytes that start in [first, last) are the chunk's."""
        h = gram_hashes(self.bytes, CUT_GRAM)
        cut = np.flatnonzero((h & CUT_MASK) == 0)
        cut = cut[np.diff(cut, prepend=-CUT_LEAST) >= CUT_LEAST]
        doc = np.searchsorted(self.ends, cut, side="right")
        cut = cut[cut <= self.ends[doc] - LENGTH] if len(cut) else cut
        whole = np.flatnonzero(self.ends - self.starts >= LENGTH)
        first = np.unique(np.concatenate([cut, self.starts[whole]]).astype(np.int64))
        doc = np.searchsorted(self.ends, first, side="right")
        last = np.append(first[1:], 0) if len(first) else first
        end_of_doc = self.ends[doc] - LENGTH + 1 if len(first) else first
        last = np.where(np.append(doc[1:] == doc[:-1], False), last, end_of_doc) if len(first) else first
        return first, last, doc

    def runs(self, gone: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(minimizer, first, last, doc) of the strings in chunks that aren't gone."""
        first, last, doc = self.chunks()
        keep = np.ones(len(first), bool)
        keep[list(gone)] = False
        if not keep.any():
            return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
        least = window_min(gram_hashes(self.bytes, GRAM), LENGTH - GRAM + 1)
        of = np.full(len(least) + 1, -1, np.int64)  # chunk of each string's start, -1 if none or gone
        edge = np.zeros(len(least) + 1, np.int64)
        f, e = first[keep], last[keep]
        number = np.flatnonzero(keep)
        inside = np.zeros(len(least) + 1, np.int64)
        np.add.at(inside, f, 1)
        np.add.at(inside, e, -1)
        inside = np.cumsum(inside) > 0
        edge[f] = 1
        at = np.cumsum(edge) - 1
        of[inside] = number[at[inside]]
        new = np.empty(len(least), bool)
        new[0] = True
        new[1:] = (least[1:] != least[:-1]) | (of[1:-1] != of[:-2])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(least))
        ok = of[begin] >= 0
        begin, end = begin[ok], end[ok]
        with np.errstate(over="ignore"):  # a minimum is small more often than not: mixed again, so that ranges are even
            h = least[begin] * _X
            h = (h ^ (h >> np.uint64(32))) * _M
        return h, begin, end, doc[of[begin]]


def _zip(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unzip(x: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _range_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def lyndon_order(text: bytes, strings: list[tuple[int, int]]) -> list[int]:
    """The starts of all suffixes of the strings [start, end) of text, in order; a string's end sorts before all bytes.

    Two phases, each a constant number of steps a suffix. ``order`` holds the groups as intervals, ``first`` the
    start of each suffix's interval, ``smaller`` the previous suffix of a lower group. Ends of strings are a lowest
    group of their own, which is never split.
    """
    # every string ends in 0, which is below all bytes
    codes: list[int] = [0]
    origin = [-1]
    for s, e in strings:
        codes += [c + 1 for c in text[s:e]]
        codes.append(0)
        origin += range(s, e)
        origin.append(-1)
    n = len(codes)
    count = [0] * 258
    for c in codes:
        count[c + 1] += 1
    for c in range(257):
        count[c + 1] += count[c]
    n_ends = count[1]
    fill = count[:]
    order, place, first = [0] * n, [0] * n, [0] * n
    size = [0] * n
    for i, c in enumerate(codes):
        at = fill[c]
        order[at], place[i], first[i] = i, at, count[c]
        fill[c] = at + 1
    for c in range(257):
        if count[c + 1] > count[c]:
            size[count[c]] = count[c + 1] - count[c]
    smaller = [-1] * n
    top = n
    while top > n_ends:  # the highest group that is left, down to the ends
        low = first[order[top - 1]]
        members = order[low:top]
        members.sort()
        times: dict[int, int] = {}
        for s in members:
            p = s - 1
            while first[p] >= low:  # a group already done, or this one: between its pointer and it nothing is lower
                p = smaller[p]
            smaller[s] = p
            if p in times:
                times[p] += 1
            else:
                times[p] = 1
        # those that point from most members rank highest in their group: they go to its end first
        by_times: dict[int, list[int]] = {}
        for p, k in times.items():
            if first[p] >= n_ends:
                by_times.setdefault(k, []).append(p)
        for k in sorted(by_times, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in by_times[k]:
                moved.setdefault(first[p], []).append(p)
            for group, own in moved.items():
                end = group + size[group]
                for p in own:
                    end -= 1
                    at, other = place[p], order[end]
                    order[at], place[other] = other, at
                    order[end], place[p] = p, end
                if end > group:
                    size[group] = end - group
                    size[end] = len(own)
                    for p in own:
                        first[p] = end
        top = low
    # in rank order, each suffix lets those follow whose next smaller suffix it is: the ones before it, by their pointers
    done, free = [False] * n, list(range(n))
    for i in range(n):
        s = order[i] - 1
        while s > 0 and codes[s] and not done[s]:
            done[s] = True
            group = first[s]
            order[free[group]] = s
            free[group] += 1
            s = smaller[s]
    return [origin[i] for i in order[n_ends:]]


def _windows(strings: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, starts, ends, where a string of LENGTH bytes starts that another one's hash agrees with)."""
    text = b"".join(strings)
    ends = np.cumsum([len(s) for s in strings])
    starts = ends - np.array([len(s) for s in strings])
    whole = np.zeros(len(text) + 1, np.int32)
    np.add.at(whole, starts, 1)
    np.add.at(whole, ends - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(whole)[:-1] > 0)
    h = gram_hashes(np.frombuffer(text, np.uint8), LENGTH)[at]
    _, back, count = np.unique(h, return_inverse=True, return_counts=True)
    again = np.zeros(len(text), bool)
    again[at[count[back] > 1]] = True
    return text, starts, ends, again


def smaller_elsewhere(strings: list[bytes], ids: list[int]) -> list[list[tuple[int, int]]]:
    """For each of the different strings, the runs [first, last) of starts whose LENGTH bytes are in a string with a smaller id.

    Hashes rule out what is in one place only; the stretches that are left are cut out, and stretches that are equal as
    a whole are taken once. The suffix order is then built of those that agree with others in part.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    text, starts, ends, again = _windows(strings)
    edges = np.flatnonzero(np.diff(again.view(np.int8), prepend=0, append=0))
    first, last = edges[::2], edges[1::2]
    inside = np.searchsorted(ends, first, side="right")
    at = first - starts[inside]
    stretches: dict[bytes, list[tuple[int, int]]] = {}
    for a, b, k, i in zip(first.tolist(), (last + LENGTH - 1).tolist(), inside.tolist(), at.tolist(), strict=True):
        stretches.setdefault(text[a:b], []).append((k, i))
    if not stretches:
        return out
    least = [min(ids[k] for k, _ in own) for own in stretches.values()]
    every = list(stretches)
    _, s_starts, _, parts = _windows(every)
    touched = np.add.reduceat(parts, s_starts) > 0
    some = np.flatnonzero(touched).tolist()
    found = dict(zip(some, _by_suffix_order([every[k] for k in some], [least[k] for k in some]), strict=True)) if some else {}
    for n, (s, own) in enumerate(stretches.items()):
        size, of = len(s) - LENGTH + 1, found.get(n)
        for k, i in own:
            if of is None:
                if least[n] < ids[k]:
                    out[k].append((i, i + size))
            else:
                cuts = np.flatnonzero(np.diff((of < ids[k]).view(np.int8), prepend=0, append=0)).tolist()
                out[k] += [(i + x, i + y) for x, y in zip(cuts[::2], cuts[1::2], strict=True)]
    return out


def _decided(groups: dict[int, dict[bytes, list]]) -> tuple[list[int], list[int], list[int]]:
    """minimizer -> string -> its places (doc, block, at): (block, first, last) of the strings of LENGTH bytes that go."""
    block: list[int] = []
    first: list[int] = []
    last: list[int] = []

    def mark(b: int, x: int, y: int) -> None:
        block.append(b)
        first.append(x)
        last.append(y)

    def settle(strings: dict[bytes, list]) -> None:
        least = [min(own)[0] for own in strings.values()]
        runs = smaller_elsewhere(list(strings), least)
        for (s, own), i, some in zip(strings.items(), least, runs, strict=True):
            for doc, b, at in own:
                if doc > i:
                    mark(b, at, at + len(s) - LENGTH + 1)
                else:
                    for x, y in some:
                        mark(b, at + x, at + y)

    batch: dict[bytes, list] = {}
    size = 0
    for strings in groups.values():
        if len(strings) == 1:  # the same bytes each time
            for s, own in strings.items():
                least = min(own)[0]
                for doc, b, at in own:
                    if doc > least:
                        mark(b, at, at + len(s) - LENGTH + 1)
            continue
        batch.update(strings)  # equal strings have equal minimizers, so none is there yet
        size += sum(map(len, strings))
        if size > BATCH_BYTES:
            settle(batch)
            batch, size = {}, 0
    if batch:
        settle(batch)
    return block, first, last


def _least_of(strings: list[bytes], docs: list[int], at: list[int]) -> tuple[list[tuple[bytes, int, int]], list[tuple[int, int]]]:
    """(string, doc, at) where the string has its smallest doc, and the runs (first, last) that go because a smaller doc has the same."""
    least: dict[bytes, int] = {}
    for s, d in zip(strings, docs, strict=True):
        if least.setdefault(s, d) > d:
            least[s] = d
    sent, gone = [], []
    for s, d, a in zip(strings, docs, at, strict=True):
        if least[s] == d:
            sent.append((s, d, a))
        else:
            gone.append((a, a + len(s) - LENGTH + 1))
    return sent, gone


def _split(strings: list[bytes], docs: list[int], at: list[int]) -> tuple[list[bytes], list[int], list[int]]:
    """Each string of LENGTH bytes of the strings by itself."""
    out: list[tuple[bytes, int, int]] = [(s[k : k + LENGTH], d, a + k) for s, d, a in zip(strings, docs, at, strict=True) for k in range(len(s) - LENGTH + 1)]
    return [x[0] for x in out], [x[1] for x in out], [x[2] for x in out]


def _key(s: bytes) -> int:
    return int.from_bytes(blake2b(s, digest_size=8).digest(), "little")


def _by_suffix_order(strings: list[bytes], ids: list[int]) -> list[np.ndarray]:
    ends = np.cumsum([len(s) for s in strings])
    starts = ends - np.array([len(s) for s in strings])
    text = b"".join(strings)
    order = np.array(lyndon_order(text, list(zip(starts.tolist(), ends.tolist(), strict=True))), np.int64)
    of = np.searchsorted(ends, order, side="right")
    whole = order + LENGTH <= ends[of]
    order, of = order[whole], of[whole]
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), LENGTH)
    same = np.ones(len(order) - 1, bool)
    for k in range(0, len(same), 100_000):
        near = order[k : k + 100_001]
        same[k : k + 100_000] = (windows[near[:-1]] == windows[near[1:]]).all(1)
    group = np.concatenate([[0], np.cumsum(~same)])
    least = np.minimum.reduceat(np.array(ids, np.int64)[of], np.flatnonzero(np.concatenate([[True], ~same])))
    out = np.empty(len(text), np.int64)
    out[order] = least[group]
    return [out[a : b - LENGTH + 1] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def remove_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, hot: int = HOT) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept binary (the remaining bytes)."""
    spark = docs.sparkSession
    packed, n_blocks = pack(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", block_chars)
    ranges = max(parallelism(spark), n_blocks // 2)

    def chunk_rows(key, packs):
        block = Block(packs)
        first, last, doc = block.chunks()
        keys = [blake2b(block.raw[a : b + LENGTH - 1], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        docs = block.ids[doc].tolist()
        least: dict[bytes, int] = {}
        for k, d in zip(keys, docs, strict=True):
            if least.setdefault(k, d) > d:
                least[k] = d
        own: dict[bytes, list[int]] = {k: [] for k in least}  # places of the block's smallest id, and the others, which go in any case
        other: dict[bytes, list[int]] = {k: [] for k in least}
        for at, (k, d) in enumerate(zip(keys, docs, strict=True)):
            (own if d == least[k] else other)[k].append(at)
        return pa.table({
            "key": pa.array(list(least), pa.binary()), "doc": pa.array(list(least.values()), pa.int64()), "block": pa.array([key[0].as_py()] * len(least), pa.int32()),
            "own": pa.array(list(own.values()), pa.list_(pa.int64())), "other": pa.array(list(other.values()), pa.list_(pa.int64())),
        })

    chunks = packed.groupBy("block").applyInArrow(chunk_rows, "key binary, doc long, block int, own array<long>, other array<long>")
    least = chunks.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most")
    gone = F.when(F.col("doc") > F.col("least"), F.concat("own", "other")).otherwise(F.col("other"))
    whole = written(chunks.join(least, "key", "left").select("block", F.explode(gone).alias("a")), "chunks")
    whole = whole.select("block", "a", F.lit(None).cast("long").alias("b"), F.lit(None).cast("binary").alias("data"))

    def minimizers(key, found, packs):
        block = Block(packs)
        h, n = np.unique(block.runs(set(found.column("a").to_pylist()))[0], return_counts=True)
        to = _range_of(h, ranges)
        cuts = np.flatnonzero(np.diff(to, prepend=-1, append=-1)) if len(h) else np.zeros(1, np.int64)
        at = to[cuts[:-1]]
        data = [_zip(h[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        many = [_zip(np.concatenate([h[x:y][n[x:y] > 1], n[x:y][n[x:y] > 1].astype(np.uint64)])) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"to": pa.array(at, pa.int32()), "block": pa.array([key[0].as_py()] * len(data), pa.int32()), "data": pa.array(data, pa.binary()), "many": pa.array(many, pa.binary())})

    def repeated(key, packs):
        lists = [_unzip(x) for x in packs.column("data").to_pylist()]
        every, count = np.unique(np.concatenate(lists), return_counts=True)
        twice = count > 1
        runs_of = count.copy()  # a run a block that has it, and those beyond the first
        for x in packs.column("many").to_pylist():
            more = _unzip(x).reshape(2, -1)
            runs_of[np.searchsorted(every, more[0])] += more[1].astype(np.int64) - 1
        crowded = every[twice & (runs_of > hot)]
        twice = every[twice]
        own = [np.intersect1d(x, twice, assume_unique=True) for x in lists]
        rows = [(b, _zip(x), _zip(np.intersect1d(x, crowded, assume_unique=True)) if len(crowded) else None) for b, x in zip(packs.column("block").to_pylist(), own, strict=True) if len(x)]
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary()), "hot": pa.array([r[2] for r in rows], pa.binary())})

    sent = whole.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(minimizers, "to int, block int, data binary, many binary")
    shared = sent.groupBy("to").applyInArrow(repeated, "block int, data binary, hot binary")
    none = F.lit(None).cast("long")
    known = whole.withColumn("hot", F.lit(None).cast("binary")).unionByName(shared.select("block", none.alias("a"), none.alias("b"), "data", "hot"))

    def run_rows(key, found, packs):
        block = Block(packs)
        lists = [_unzip(x) for x in found.column("data").to_pylist() if x is not None]
        h, begin, end, doc = block.runs({a for a in found.column("a").to_pylist() if a is not None})
        every, count = np.unique(h, return_counts=True)
        keep = np.isin(h, np.concatenate([*lists, every[count > 1]]))
        h, begin, end, doc = h[keep], begin[keep], end[keep], doc[keep]
        crowded = np.isin(h, np.concatenate([np.zeros(0, np.uint64), *(_unzip(x) for x in found.column("hot").to_pylist() if x is not None)]))
        strings = [block.raw[a : b + LENGTH - 1] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        docs, at = block.ids[doc], begin
        sent, gone = _least_of([strings[k] for k in np.flatnonzero(~crowded).tolist()], docs[~crowded].tolist(), at[~crowded].tolist())
        number = dict(zip(at.tolist(), h.tolist(), strict=True))
        keys = [number[x[2]] for x in sent]
        if crowded.any():
            alone, some = _least_of([strings[k] for k in np.flatnonzero(crowded).tolist()], docs[crowded].tolist(), at[crowded].tolist())
            gone += some
            alone, some = _least_of(*_split(*map(list, zip(*alone, strict=True))))
            gone += some
            sent += alone
            keys += [_key(x[0]) for x in alone]
        if not sent:
            return pa.table({"to": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "data": pa.array([], pa.binary()), "gone": pa.array([], pa.binary())})
        h = np.array(keys, np.uint64)
        order = np.argsort(h, kind="stable")
        to = _range_of(h[order], ranges)
        rows = pa.RecordBatch.from_arrays(
            [pa.array(h, pa.uint64()), pa.array([x[1] for x in sent], pa.int64()), pa.array([x[2] for x in sent], pa.int64()), pa.array([x[0] for x in sent], pa.binary())], names=["h", "doc", "at", "bytes"]
        ).take(pa.array(order))
        cuts = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
        data = []
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(rows.slice(x, y - x))
            data.append(sink.getvalue().to_pybytes())
        known_here = [_zip(np.array(gone, np.uint64).ravel())] if gone else [None]  # travels with the first row
        return pa.table({
            "to": pa.array(to[cuts[:-1]], pa.int32()), "block": pa.array([key[0].as_py()] * len(data), pa.int32()), "data": pa.array(data, pa.binary()),
            "gone": pa.array(known_here + [None] * (len(data) - 1), pa.binary()),
        })

    def decide(key, packs):
        groups: dict[int, dict[bytes, list]] = {}
        for b, x in zip(packs.column("block").to_pylist(), packs.column("data"), strict=True):
            t = pa.ipc.open_stream(x.as_buffer()).read_all()
            for h, own, doc, at in zip(*(t.column(c).to_pylist() for c in ("h", "bytes", "doc", "at")), strict=True):
                groups.setdefault(h, {}).setdefault(own, []).append((doc, b, at))
        block, first, last = _decided(groups)
        for b, x in zip(packs.column("block").to_pylist(), packs.column("gone").to_pylist(), strict=True):
            if x is not None:
                some = _unzip(x).reshape(-1, 2).astype(np.int64)
                block += [b] * len(some)
                first += some[:, 0].tolist()
                last += some[:, 1].tolist()
        return pa.table({"block": pa.array(block, pa.int32()), "a": pa.array(first, pa.int64()), "b": pa.array(last, pa.int64())})

    runs = known.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(run_rows, "to int, block int, data binary, gone binary")
    decided = runs.groupBy("to").applyInArrow(decide, "block int, a long, b long")
    gone = whole.select("block", "a", "b").unionByName(decided)

    def cut(key, found, packs):
        block = Block(packs)
        first, last, _ = block.chunks()
        depth = np.zeros(len(block.raw) + 1, np.int32)
        a, b = found.column("a").to_numpy(), found.column("b").to_pylist()
        isrun = np.array([x is not None for x in b], bool)
        at = a[~isrun].astype(np.int64)
        starts = np.concatenate([first[at], a[isrun].astype(np.int64)])
        ends = np.concatenate([last[at], np.array([x for x in b if x is not None], np.int64)])
        np.add.at(depth, starts, 1)
        np.add.at(depth, ends + LENGTH - 1, -1)
        out = np.cumsum(depth)[:-1] > 0
        ids, size, removed, spans, kept = [], [], [], [], []
        for i, (s, e) in enumerate(zip(block.starts.tolist(), block.ends.tolist(), strict=True)):
            own = out[s:e]
            n = int(own.sum())
            ids.append(None if block.null[i] else int(block.ids[i]))
            size.append(e - s)
            removed.append(n)
            spans.append(int((np.diff(own.view(np.int8), prepend=0) == 1).sum()) if n else 0)
            kept.append(block.bytes[s:e][~own].tobytes() if n else block.raw[s:e])
        return pa.table({"id": pa.array(ids, pa.int64()), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    done = gone.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumnRenamed("id", id_col)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     t AS (SELECT doc_id, q, substr(h, 512 * q + 1, 610) AS t FROM (SELECT doc_id, h, unnest(range(0, CAST(ceil(length(h) / 512) AS BIGINT))) AS q FROM d)),
     w AS (SELECT doc_id, 256 * q + k + 1 AS p, substr(t, 2 * k + 1, 100) AS s FROM (SELECT doc_id, q, t, unnest(range(0, least(256, CAST(length(t) / 2 AS BIGINT) - 49))) AS k FROM t WHERE length(t) >= 100)),
     m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
     g AS (SELECT doc_id, p FROM w JOIN m USING (s) WHERE doc_id > least),
     c AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM g),
     k AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM c),
     i AS (SELECT doc_id, min(p) AS a, max(p) + 49 AS z FROM k GROUP BY doc_id, k),
     v AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM i),
     r AS (SELECT doc_id, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) || substr(first(h), 2 * max(z) + 1) AS kept
           FROM v JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
