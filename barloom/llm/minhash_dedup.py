"""Near-duplicate groups by HyperMinHash.

1. A text becomes the set of hashes of its shingles (three consecutive words, A to Z lower-cased; a text of fewer words
   is one shingle). Texts with the same set are one class, found by its hash; one representative of each goes on.
2. Registers. A hash's first bits name its bucket (BUCKETS in all), the rest is its value; a bucket keeps the least value of
   the set, as its number of leading zeros and the MANTISSA bits that follow, in 16 bits. A bucket without a shingle
   takes the register of the first bucket that has one, in an order of its own (so that small sets fill all registers).
3. Bands. ROWS consecutive registers are a band; sets with an equal band meet. A pair at the threshold of 0.85 misses
   all BANDS bands with a chance of about 4e-7; none is lost because of the size of a band's bucket.
4. Estimates. Of the sets that meet, the registers that agree, less those that sets of their sizes share by accident
   (``accidental``), estimate the Jaccard similarity; pairs whose sizes or estimates rule a link out (REACH, about five standard errors
   under the threshold) go no further. Buckets of up to SMALL sets are compared pair by pair. Larger ones first collapse, in
   blocks of CROWD sets: a set that all but equals a leader is represented by it; the leaders are compared in pairs of
   blocks. Each task is bounded; the work of a bucket grows with the square of the leaders that no leader represents.
5. Verification on whole sets. What may be linked forms coarse groups; only their texts are fetched again, and every
   pair of a group that can matter is decided by its exact intersection. In groups of more than BLOCK sets those that are
   linked with the group's center are one group by that; all others meet each other and them, in pairs of blocks.
6. Components of the true links, by minima that are passed on; no list of pairs within a group is ever written.

Defined cases: null, empty and wordless texts have no shingle and are linked with nothing; repeated rows are in one
group; rows that share an id but not the text are documents of their own; rows with a null id are linked with nothing, are kept, and
have a null component_id; an empty table gives an empty result; texts of any length are used whole; other columns are
not read. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import table, text_of, written
from barloom.llm.components import components, forest
from barloom.llm.ngram_join import _dealt, _edges, _mix, _whole_groups, block_pairs, classes_of, exact_links, key_of, near_center

WORDS = 3
SIMILAR = 0.85
BUCKETS = 128
MANTISSA = 10
ROWS, BANDS = 5, 25
REACH = (0.70, 0.62, 0.55)  # of the estimate: may be linked, by how many of the two represent others
NEAR = 0.93  # of registers that agree: a leader represents the set
SMALL = 64
CROWD = 2048
BLOCK = 512

_VALUE = 53  # bits of a hash that are looked at beside its bucket
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)
_STARTS = np.arange(BUCKETS, dtype=np.uint64) << _SHIFT
_FIRST = np.argsort(_mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, BUCKETS), axis=1)  # each bucket's order of others


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingles:
    """Sets of shingle hashes, as sorted arrays; remembers the hashes of words, up to a bound."""

    def __init__(self, words: int = WORDS):
        self.words, self.memo = words, _WordHashes()

    def __call__(self, text: str) -> np.ndarray:
        if len(self.memo) > 300_000:
            self.memo.clear()
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A to Z only, ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.words + 1)
        out = np.full(n, min(len(h), self.words), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(min(self.words, len(h))):
                out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        return np.unique(out)


def registers(s: np.ndarray) -> np.ndarray:
    """The registers of a set of hashes, which come sorted and are not empty: the first of a bucket is its least."""
    at = np.searchsorted(s, _STARTS)
    least = s[np.minimum(at, len(s) - 1)]
    full = (least >> _SHIFT) == np.arange(BUCKETS, dtype=np.uint64)
    full &= at < len(s)
    value = (least << (np.uint64(64) - _SHIFT)) >> np.uint64(64 - _VALUE)
    zeros = _VALUE - np.frexp(value.astype(np.float64))[1]
    after = (value << zeros.astype(np.uint64)) >> np.uint64(_VALUE - 1 - MANTISSA)
    out = ((zeros << MANTISSA) | (after.astype(np.int64) & ((1 << MANTISSA) - 1))).astype(np.uint16)
    if full.all():
        return out
    return np.where(full, out, out[_FIRST[np.arange(BUCKETS), full[_FIRST].argmax(axis=1)]])


def accidental(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of registers that two sets of n and m hashes, none in common, are expected to have alike."""
    edges = np.append(2.0 ** -np.arange(_VALUE), 0)  # of the values with 0, 1, ... leading zeros

    def shares(size: np.ndarray) -> np.ndarray:
        # a set of fewer hashes than buckets fills each register with one hash
        over = np.exp(np.log1p(-np.minimum(edges, 1 - 1e-12)) * np.maximum(1.0, np.asarray(size, float)[..., None] / BUCKETS))
        return over[..., 1:] - over[..., :-1]

    return (shares(n) * shares(m)).sum(-1) * 2.0**-MANTISSA


def needed(n: np.ndarray, m: np.ndarray, estimate: np.ndarray | float) -> np.ndarray:
    """How many registers have to agree for a corrected estimate of so much: (share - accidental) / (1 - accidental)."""
    by = accidental(n, m)
    return BUCKETS * (estimate + (1 - estimate) * by)


def bands(r: np.ndarray) -> np.ndarray:
    """A number for each band of each row of registers."""
    part = r[:, : ROWS * BANDS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), part.shape[:2])
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + part[:, :, k])
    return out.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, key, size, sketch): hash of the set, its size, its registers; null where there is no shingle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text"))

    def run(batches):
        shingles = Shingles()
        for batch in batches:
            key, size, sketch = [], [], []
            for t in batch.column("text"):
                s = shingles(t.as_py())
                size.append(len(s))
                key.append(key_of(s) if len(s) else None)
                sketch.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(key, pa.binary()), pa.array(size, pa.int64()), pa.array(sketch, pa.binary())], names=["doc", "key", "size", "sketch"])

    return rows.mapInArrow(run, "doc long, key binary, size long, sketch binary")


def _registers_of(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)


def banded(sets: DataFrame) -> DataFrame:
    """sets (node, size, sketch) -> (bucket, node), a row a band."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                node = np.repeat(batch.column("node").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(bands(_registers_of(batch)).ravel()), pa.array(node, pa.int64())], names=["bucket", "node"])

    return sets.select("node", "sketch").mapInArrow(run, "bucket long, node long")


def may_link(r: np.ndarray, size: np.ndarray, full: np.ndarray, i: np.ndarray, j: np.ndarray, similar: float) -> np.ndarray:
    """Whether the rows i and j may be linked, by sizes and estimates. full: 1 where a set represents others."""
    reps = full[i] + full[j]
    # a represented set may be a tenth larger or smaller than its leader
    ok = np.minimum(size[i], size[j]) >= (similar - 0.12 * reps) * np.maximum(size[i], size[j]) - 1e-9
    i, j, reps = i[ok], j[ok], reps[ok]
    agree = (r[i] == r[j]).sum(axis=1)
    ok[ok] = agree >= np.floor(needed(size[i], size[j], np.array(REACH)[reps]))
    return ok


def small_links(rows: DataFrame, similar: float) -> DataFrame:
    """rows (bucket, node, size, sketch) of small buckets -> links (a, b): all pairs of a bucket, kept as a forest."""

    def run(batches):
        for t, _ in _whole_groups(batches, ["bucket"]):
            bucket, node, size, r, pairs = t["bucket"].to_numpy(), t["node"].to_numpy(), t["size"].to_numpy(), _registers_of(t), []
            none = np.zeros(len(bucket), np.int64)
            for d in range(1, len(bucket)):
                i = np.flatnonzero(bucket[d:] == bucket[:-d])
                if not len(i):
                    break
                i = i[may_link(r, size, none, i, i + d, similar)]
                pairs += zip(node[i].tolist(), node[i + d].tolist(), strict=True)
            yield _edges(pairs)

    return _dealt(rows, "bucket").mapInArrow(run, "a long, b long")


def _mean_agreement(r: np.ndarray) -> np.ndarray:
    """Of each sketch with all of them, by counting the values of each register."""
    total = np.zeros(len(r))
    for k in range(BUCKETS):
        _, at, n = np.unique(r[:, k], return_inverse=True, return_counts=True)
        total += n[at]
    return total / (BUCKETS * len(r))


def collapse(rows: DataFrame) -> DataFrame:
    """rows (bucket, salt, node, sketch) of large buckets -> links (a, b, null, null) of sets to the leader that represents
    them, and leaders (a, null, bucket, full)."""

    def run(batches):
        for t, cuts in _whole_groups(batches, ["bucket", "salt"]):
            nodes, r, out = t["node"].to_numpy(), _registers_of(t), []
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own, node, bucket = r[x:y], nodes[x:y], t["bucket"][x].as_py()
                left = np.argsort(-_mean_agreement(own), kind="stable")
                while len(left):
                    lead, left = int(left[0]), left[1:]
                    like = (own[left] == own[lead]).sum(axis=1) >= NEAR * BUCKETS
                    out += [(int(node[lead]), int(n), None, None) for n in node[left[like]]]
                    out.append((int(node[lead]), None, bucket, int(like.any())))
                    left = left[~like]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=["a", "b", "bucket", "full"])

    return _dealt(rows, "bucket", "salt").mapInArrow(run, "a long, b long, bucket long, full long")


def leader_links(rows: DataFrame, similar: float) -> DataFrame:
    """rows (bucket, p, q, side, node, full, size, sketch) -> links (a, b) within or between the blocks, kept as a forest."""

    def run(batches):
        for t, cuts in _whole_groups(batches, ["bucket", "p", "q"]):
            nodes, size, full, sides, p, q = (t[c].to_numpy() for c in ("node", "size", "full", "side", "p", "q"))
            r = _registers_of(t)
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                at, pairs = np.arange(x, y), []
                one = p[x] == q[x]
                left, right = (at, at) if one else (at[sides[x:y] == 0], at[sides[x:y] == 1])
                for k, i in enumerate(left.tolist()):
                    j = right[k + 1 :] if one else right
                    j = j[may_link(r, size, full, np.full(len(j), i), j, similar)]
                    pairs += [(int(nodes[i]), n) for n in nodes[j].tolist()]
                    if len(pairs) > 8 * len(at):
                        pairs = forest(pairs)
                yield _edges(pairs)

    return _dealt(rows, "bucket", "p", "q").mapInArrow(run, "a long, b long")


def candidates(sets: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) that connect all sets that may be linked. sets: (node, size, sketch)."""
    met = banded(sets)
    sized = met.join(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "bucket")
    sized = written(sized, "bands")
    own = sets.select("node", "size", "sketch")
    out = small_links(sized.filter(F.col("members") <= SMALL).select("bucket", "node").join(own, "node"), similar)
    large = sized.filter(F.col("members") > SMALL)
    if not large.isEmpty():
        salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / CROWD)).cast("int")
        crowd = written(collapse(large.select("bucket", salt.alias("salt"), "node").join(own.drop("size"), "node")), "crowds")
        leaders = crowd.filter("b IS NULL").select("bucket", F.col("a").alias("node"), "full")
        pairs = block_pairs(leaders, "bucket", "node", F.lit(True), CROWD).select("bucket", "p", "q", "side", "node", "full")
        out = out.unionByName(crowd.filter("b IS NOT NULL").select("a", "b")).unionByName(leader_links(pairs.join(own, "node"), similar))
    return out.distinct()


def fetched_sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """members (grp, size, node, n, rep, key) with the shingles of each, a row a node."""
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), text_of(text_col).alias("text"))

    def run(batches):
        shingles = Shingles()
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            own = pa.array([key_of(s) == k for s, k in zip(sets, batch.column("key").to_pylist(), strict=True)], pa.bool_())
            columns = [*(batch.column(c) for c in ("grp", "size", "node", "n")), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["grp", "size", "node", "n", "shingles"]).filter(own)

    # sorted and merged at every size: members grow with the input
    joined = members.hint("merge").join(texts, "rep").select("grp", "size", "node", "n", "key", "text")
    found = written(joined.mapInArrow(run, "grp long, size long, node long, n long, shingles binary"), "shingles")
    return found if found.count() == members.count() else found.dropDuplicates(["node"])


def centers(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(grp, center): of each block of CROWD members, the one with the highest average agreement; of those, the highest."""
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / CROWD)).cast("int")
    rows = members.select("grp", salt.alias("salt"), "node").join(sets.select("node", "sketch"), "node")

    def run(batches):
        for t, cuts in _whole_groups(batches, ["grp", "salt"]):
            r, out = _registers_of(t), []
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                mean = _mean_agreement(r[x:y])
                k = int(np.argmax(mean))
                out.append((t["grp"][x].as_py(), t["node"][x + k].as_py(), float(mean[k])))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["grp", "node", "mean"])

    return _dealt(rows, "grp", "salt").mapInArrow(run, "grp long, node long, mean double").groupBy("grp").agg(F.max_by("node", F.struct("mean", "node")).alias("center"))


def true_links(found: DataFrame, members: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) that connect, in all coarse groups, what has a similarity of at least similar. found: from fetched_sets."""
    one = found.filter(F.col("size") <= BLOCK).select("grp", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(0).alias("side"), "node", "n", "shingles")
    tree = lambda rows: exact_links(rows, similar).filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    crowds = members.filter(F.col("size") > BLOCK)
    if crowds.isEmpty():
        return tree(one)
    center = written(centers(crowds, sets), "centers")
    # near_center tells what is within half the distance it is given
    near = written(near_center(found.filter(F.col("size") > BLOCK), center, 2 * similar - 1), "near")
    spokes = near.filter("near").join(center, "grp").filter("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b"))
    far = block_pairs(near.select("grp", "node", "n", "near"), "grp", "node", ~F.col("near"), BLOCK).select("grp", "p", "q", "side", "node", "n")
    return tree(one.unionByName(far.join(near.select("node", "shingles"), "node").select(*one.columns))).unionByName(spokes)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id that links lead to, its own included)."""
    rows = written(sketches(docs, id_col, text_col), "sketches")
    known = rows.filter("doc IS NOT NULL AND key IS NOT NULL")
    classes = classes_of(known)
    sets = written(known.join(classes.select("key", F.col("rep").alias("doc"), "rep", "n", "node"), ["key", "doc"]).drop("doc"), "sets")
    if sets.count() > classes.count():  # rows with the same id and text
        sets = written(sets.dropDuplicates(["node"]), "sets")
    # smaller sets are under the threshold with every other set: at best that has one shingle more
    paired = sets.filter(F.col("size") * 1_000_000 >= round(similar * 1_000_000) * (F.col("size") + 1))
    coarse = written(components(candidates(paired, similar)), "coarse")
    sizes = coarse.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    members = coarse.join(sizes, "component").join(sets.select("node", "n", "rep", "key"), "node").select(F.col("component").alias("grp"), F.col("members").alias("size"), "node", "n", "rep", "key")
    members = written(members, "members")
    found = fetched_sets(docs, members, id_col, text_col)
    groups = components(true_links(found, members, sets, similar))
    least = groups.join(sets.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    of_class = classes.join(groups.join(least, "component").select("node", "least"), "node", "left").select("key", F.coalesce("least", "rep").alias("least"))
    out = rows.join(of_class.hint("merge"), "key", "left")
    own = F.when(F.col("doc").isNotNull(), F.coalesce("least", "doc"))
    return out.select(F.col("doc").alias(id_col), F.col("size").alias("n_shingles"), own.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """docs with one id of each group, the smallest, with all its rows; rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col, similar)
    gone = found.groupBy(F.col(id_col).alias("_gone")).agg(F.bool_and(F.col(id_col) != F.col("component_id")).alias("_all")).filter("_all").select("_gone")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


# pairs by shared shingles, and everything reachable: fit for small tables only
ORACLE = r"""
WITH RECURSIVE w AS (
       SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
             ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS x FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
     l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
     r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id, r.doc_id = min(r.c) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
