"""Similarity join on word n-grams (Jaccard at least 0.8 on five-word shingles) by chosen paths.

1. A text becomes the set of hashes of its shingles (runs of five lower-cased words; a text of fewer words is one
   shingle). Texts with the same set are one class, found by its hash with ordinary combining; only one
   representative of each class goes on.
2. Chosen paths. In each of several independent runs, every set picks shared tokens: token t of a set of n is picked
   if a hash of (run, level, t) is below RATE / (similarity * n), so two sets that share a token pick it together, and
   ever more surely the more they share. Sets meet in the bucket of a picked token. The number of runs follows from the
   chance that a pair at the threshold stays together through all levels, and the target recall; the pair that is
   least likely to meet is a set inside the other. A set too small to be over the threshold with any other set (of
   under four shingles, at 0.8) picks nothing.
3. Small buckets are compared by brute force on sketches (LANES minhashes of a byte). Buckets of more than SMALL sets
   first collapse: in blocks of CROWD sets, a set that all but equals a leader is linked to it and represented by it.
   Leaders whose average similarity to their bucket is so high that splitting would not part them (``central``) are
   compared on the spot, with all leaders of the bucket, in pairs of blocks; the others are split again by tokens
   picked afresh, LEVELS deep. What is left at the last level is compared in pairs of blocks.
4. Linked sets form coarse groups, in which every pair over the threshold lies. Only their shingle sets are fetched, and
   every pair of a group is decided exactly. Groups of more than BLOCK sets have a center: sets within half the distance
   of the threshold from it are all linked to each other (the Jaccard distance is a metric), so they are counted
   without being compared; only sets farther out are compared, with all others, in pairs of blocks that are multiplied as
   matrices. Out come each set's number of links, and a spanning forest of the true links. No list of pairs is ever written.
5. Components of the true links are the final groups.

A sketch only proposes; what counts as a link is exact. Pairs can be lost only where no run brings them together
(recall), never because of the size of a bucket. Sets far from the center of a crowd are sent to each block of it: shuffle
and comparisons there grow as far sets x sets of the group; everything else moves each set a constant number of times.

Defined cases: null, empty and wordless texts have no shingle: each is its own group, without links; repeated rows are
copies (of a text with words: linked to each other); rows that share an id but not the text are sets of their own; with
a null id they can't be told apart and are left out of the comparison, as groups of their own with a null class_id; an
empty table gives an empty result; texts of any length are used whole; other columns are not read, whatever their names.
``drop_similar`` keeps an id with all its rows if any of its rows stays. Ids are integers.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import fresh, parallelism, table, written
from barloom.llm.components import components, forest

WORDS = 5
SIMILAR = 0.8
RECALL = 0.999
RATE = 2.0
LEVELS = 3
SMALL = 64
CROWD = 4096
LANES = 128
NEAR = 0.93  # of lanes that agree: a leader represents the set
REACH = (0.64, 0.55, 0.49)  # of lanes that agree: link, by how many of the two sets represent others
BLOCK = 512
SALTS = 16

_WORD = re.compile(r"\w+")
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _seeds(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


class Shingler:
    """Sets of shingle hashes, as sorted arrays; remembers the hashes of words, up to a bound."""

    def __init__(self, words: int = WORDS):
        self.words, self.memo = words, _WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.memo) > 300_000:
            self.memo.clear()
        words = _WORD.findall((text or "").lower())
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.words + 1)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(min(self.words, len(h))):
                out = (out ^ (out >> np.uint64(29))) * _MIX1 + h[k : k + n]
            return np.unique(_mix(out))


def key_of(s: np.ndarray) -> bytes:
    from hashlib import blake2b

    return blake2b(s.tobytes(), digest_size=16).digest()


def runs_for(similar: float = SIMILAR, recall: float = RECALL, rate: float = RATE, levels: int = LEVELS) -> int:
    """Runs until a pair at the threshold meets with the target's chance, were it to go down all levels. At least it
    shares s of the greater set (all of the smaller one), so that it picks rate / s * s tokens together at each level."""
    meets = (1 - math.exp(-rate)) ** levels
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def central_at(similar: float = SIMILAR, rate: float = RATE) -> float:
    """The average similarity from which sets of a size pick more than one token together: splitting doesn't part them."""
    shared = similar / rate
    return shared / (2 - shared)


def _lane_seeds() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        x = _mix(np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return (x >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1), x.astype(np.uint32)[:, None]


_LANES = _lane_seeds()


def _sketch(s: np.ndarray) -> bytes:
    """A byte of each lane's least hash; all lanes at a time, some hundred shingles at a time."""
    low = (s >> np.uint64(32)).astype(np.uint32)[None, :]
    mul, add = _LANES
    least = np.full(LANES, 0xFFFFFFFF, np.uint32)
    for k in range(0, low.shape[1], 256):
        x = low[:, k : k + 256] * mul
        x += add
        np.minimum(least, x.min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(13)).astype(np.uint8).tobytes()


def _picked(s: np.ndarray, seeds: np.ndarray, similar: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of the set each seed picks, and those tokens."""
    with np.errstate(over="ignore"):
        hit = s[None, :] * seeds[:, None] <= np.uint64(min(2**64 - 1, int(rate / (similar * len(s)) * 2**64)))
    return hit.sum(axis=1), np.broadcast_to(s, hit.shape)[hit].view(np.int64)


def _alone(n: int, similar: float) -> bool:
    """Whether a set of n is under the threshold with every other set (at best it lacks one shingle of that)."""
    return n * 1_000_000 < round(similar * 1_000_000) * (n + 1)


def _level(depth: int) -> str:
    return f"picks_{depth}"


def sketches(docs: DataFrame, id_col: str, text_col: str, similar: float, runs: int) -> DataFrame:
    """(doc, key, sketch, picks_0 ...): the key of the set, and for each level a row of picked tokens for each run."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter("doc IS NOT NULL")
    names = [_level(d) for d in range(LEVELS)]

    def run(batches):
        shingle, seeds = Shingler(), _seeds(runs * LEVELS)
        none = np.zeros(runs * LEVELS, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key, sketch, picks = [], [], []
            for t in batch.column("text"):
                s = shingle(t.as_py())
                key.append(key_of(s) if len(s) else None)
                sketch.append(_sketch(s) if len(s) else None)
                picks.append(_picked(s, seeds, similar, RATE) if len(s) and not _alone(len(s), similar) else none)
            columns = [batch.column("doc"), pa.array(key, pa.binary()), pa.array(sketch, pa.binary())]
            for d in range(LEVELS):  # lists of lists, from where each ends
                own = [(n[d * runs : (d + 1) * runs], x[n[: d * runs].sum() : n[: (d + 1) * runs].sum()]) for n, x in picks]
                ends = np.concatenate([[0], *(n for n, _ in own)]).cumsum()
                inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *(x for _, x in own)])))
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * runs, pa.int32()), inner))
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "key", "sketch", *names])

    return rows.mapInArrow(run, "doc long, key binary, sketch binary, " + ", ".join(f"{n} array<array<long>>" for n in names))


def _whole_groups(batches, keys: list[str], rows: int = 20_000):
    """Tables of whole groups, and where in them each group starts. Rows come sorted by keys."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cut(last: bool):
        t = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            x = t[k].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        at = np.flatnonzero(new)
        end = t.num_rows if last else int(at[-1])
        return t, at[at < end], end

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            t, at, end = cut(False)
            if end:
                yield t.slice(0, end), np.append(at, end)
            held = t.slice(end).to_batches()
            size = t.num_rows - end
    if size:
        t, at, end = cut(True)
        yield t, np.append(at, end)


def _lanes_of(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, LANES)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of lanes that agree."""
    return np.bitwise_count((a == b).view(np.uint64)).sum(-1, dtype=np.int64)


def _mean_agreement(lanes: np.ndarray) -> np.ndarray:
    """Of each sketch with all of them, by counting the bytes of each lane."""
    total = np.zeros(len(lanes))
    for k in range(LANES):
        total += np.bincount(lanes[:, k], minlength=256)[lanes[:, k]]
    return total / (LANES * len(lanes))


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    tree = forest(pairs)
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in tree], pa.int64()), pa.array([y for _, y in tree], pa.int64())], names=["a", "b"])


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(parallelism(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def small_links(rows: DataFrame) -> DataFrame:
    """rows (bucket, node, sketch) of small buckets -> links (a, b): all pairs of a bucket, kept as a forest."""

    def run(batches):
        for t, _ in _whole_groups(batches, ["bucket"]):
            bucket, node, lanes = t["bucket"].to_numpy(), t["node"].to_numpy(), _lanes_of(t)
            reps, pairs = t["full"].to_numpy(), []
            reach = np.array(REACH) * LANES
            for d in range(1, len(bucket)):
                i = np.flatnonzero(bucket[d:] == bucket[:-d])
                if not len(i):
                    break
                i = i[_agree(lanes[i], lanes[i + d]) >= reach[reps[i] + reps[i + d]]]
                pairs += zip(node[i].tolist(), node[i + d].tolist(), strict=True)
            yield _edges(pairs)

    return _dealt(rows, "bucket").mapInArrow(run, "a long, b long")


def collapse(rows: DataFrame, central: float) -> DataFrame:
    """rows (bucket, run, salt, node, full, sketch) of large buckets -> links (a, b, null ...) of sets to the leader that
    represents them, and leaders (a, null, bucket, run, full, central)."""

    def run(batches):
        for t, cuts in _whole_groups(batches, ["bucket", "salt"]):
            nodes, lanes, full = t["node"].to_numpy(), _lanes_of(t), t["full"].to_numpy()
            out: list[tuple] = []
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own, node, mean = lanes[x:y], nodes[x:y], _mean_agreement(lanes[x:y])
                bucket, r = t["bucket"][x].as_py(), t["run"][x].as_py()
                left = np.argsort(-mean, kind="stable")
                while len(left):
                    lead, left = int(left[0]), left[1:]
                    like = _agree(own[left], own[lead]) >= NEAR * LANES
                    out += [(int(node[lead]), int(n), None, None, None, None) for n in node[left[like]]]
                    out.append((int(node[lead]), None, bucket, r, max(int(full[x + lead]), int(like.any())), bool(mean[lead] >= central)))
                    left = left[~like]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "bucket", "run", "full", "central"])

    return _dealt(rows, "bucket", "salt").mapInArrow(run, "a long, b long, bucket long, run int, full int, central boolean")


def block_pairs(rows: DataFrame, group: str, node: str, first: Column, block: int) -> DataFrame:
    """rows with (p, q, side): those for which ``first`` holds meet each other and all others of their group, in pairs of
    blocks of about ``block`` rows; side 1 is block q of a pair of different blocks. Others don't meet each other."""
    rows = rows.withColumn("first", first)
    count = lambda c: F.ceil(F.count_if(c) / block).cast("long")
    sizes = rows.groupBy(group).agg(count(F.col("first")).alias("n_first"), count(~F.col("first")).alias("n_rest"), F.count(F.lit(1)).alias("rows"))
    # salted: a group may be as large as it likes, and most of its rows are those of few groups
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    sizes = sizes.filter("n_first > 0 AND rows > 1").drop("rows").withColumn("salt", salts)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(node, F.lit(2)), F.lit(SALTS)).cast("int"))
    own = F.when(F.col("first"), F.pmod(F.xxhash64(node, F.lit(1)), "n_first")).otherwise(F.col("n_first") + F.pmod(F.xxhash64(node, F.lit(1)), F.greatest("n_rest", F.lit(1))))
    last = F.col("n_first") + F.when(F.col("first"), F.col("n_rest")).otherwise(0) - 1
    met = rows.join(sizes, [group, "salt"]).withColumn("own", own).withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    out = met.withColumns({"p": F.least("own", "met"), "q": F.greatest("own", "met"), "side": (F.col("own") > F.col("met")).cast("int")})
    return out.drop("n_first", "n_rest", "own", "met", "first", "salt")


def leader_links(rows: DataFrame) -> DataFrame:
    """rows (bucket, p, q, side, node, full, sketch) -> links (a, b) within or between the blocks, kept as a forest."""

    def run(batches):
        reach = np.array(REACH) * LANES
        for t, cuts in _whole_groups(batches, ["bucket", "p", "q"]):
            nodes, lanes, full, sides, p, q = t["node"].to_numpy(), _lanes_of(t), *(t[c].to_numpy() for c in ("full", "side", "p", "q"))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                at = np.arange(x, y)
                one = p[x] == q[x]
                left, right = (at, at) if one else (at[sides[x:y] == 0], at[sides[x:y] == 1])
                pairs: list[tuple[int, int]] = []
                own, reps = lanes[right], full[right]
                for k, i in enumerate(left.tolist()):
                    j = np.flatnonzero(_agree(own[k + 1 :] if one else own, lanes[i]) >= reach[full[i] + (reps[k + 1 :] if one else reps)])
                    pairs += [(int(nodes[i]), n) for n in nodes[right[j + k + 1 if one else j]].tolist()]
                    if len(pairs) > 8 * len(at):
                        pairs = forest(pairs)
                yield _edges(pairs)

    return _dealt(rows, "bucket", "p", "q").mapInArrow(run, "a long, b long")


def candidates(sets: DataFrame, runs: int, similar: float = SIMILAR) -> DataFrame:
    """Links (a, b), some repeated, that connect all sets that may be over the threshold. sets: (node, sketch, picks_0 ...)."""
    tokens = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.transform(F.get(_level(0), r), lambda t: F.struct(r.alias("run"), t.alias("t")))))
    level = sets.filter(F.size(_level(0)) > 0).select("node", F.explode(tokens).alias("x")).select(F.xxhash64("x.run", "x.t").alias("bucket"), "x.run", "node", F.lit(0).alias("full"))
    with_sketch = sets.select("node", "sketch")
    small, links = [], []
    for depth in range(LEVELS):
        size = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        # written, like the links of the leaders: a plan holds one step of one level, so the driver's share of it stays small
        sized = written(level.join(size, "bucket"), "sized")
        small.append(sized.filter(F.col("size") <= SMALL).select("bucket", "node", "full"))
        salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / CROWD)).cast("int")
        large = sized.filter(F.col("size") > SMALL).select("bucket", "run", salt.alias("salt"), "node", "full")
        if large.isEmpty():
            break
        crowd = written(collapse(large.join(with_sketch, "node"), central_at(similar)), "crowds")
        links.append(crowd.filter("b IS NOT NULL").select("a", "b"))
        leaders = crowd.filter("b IS NULL").select("bucket", "run", F.col("a").alias("node"), "full", "central")
        stays = F.col("central") if depth < LEVELS - 1 else F.lit(True)
        met = block_pairs(leaders, "bucket", "node", stays, CROWD).select("bucket", "p", "q", "side", "node", "full")
        links.append(written(leader_links(met.join(with_sketch, "node")), "leaders"))
        below = leaders.filter("NOT central")
        if depth == LEVELS - 1 or below.isEmpty():
            break
        picks = sets.select("node", F.col(_level(depth + 1)).alias("picks"))
        # two buckets of a run may pick the same token: the path tells them apart
        level = written(below.join(picks, "node").select("bucket", "run", "node", "full", F.explode(F.get("picks", F.col("run"))).alias("t")).select(F.xxhash64("bucket", "t").alias("bucket"), "run", "node", "full"), "paths")
    every = small[0]
    for s in small[1:]:
        every = every.unionByName(s)
    out = small_links(every.join(with_sketch, "node"))
    for x in links:
        out = out.unionByName(x)
    return out


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share, as products of 0/1 matrices over the shingles that are in several sets."""
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.bincount(at, minlength=len(every)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    row, col = row[keep], column[at[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    cuts = np.searchsorted(col, np.arange(0, int(shared.sum()) + width, width))
    for k in range(len(cuts) - 1):
        m = np.zeros((len(sets), min(width, int(shared.sum()) - k * width)), np.float32) if cuts[k] < cuts[k + 1] else None
        if m is not None:
            m[row[cuts[k] : cuts[k + 1]], col[cuts[k] : cuts[k + 1]] - k * width] = 1
            common += m @ m.T
    return common


def _linked(sets: list[np.ndarray], similar: float) -> np.ndarray:
    """A matrix: which sets have a Jaccard of at least similar, in whole numbers. None with itself."""
    common = _common(sets).astype(np.float64)
    sizes = np.array([len(s) for s in sets])
    hit = common * 1_000_000 >= round(similar * 1_000_000) * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(hit, False)
    return hit


def _tree(hit: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links."""
    out, left = [], np.ones(len(hit), bool)
    for root in range(len(hit)):
        if not left[root]:
            continue
        left[root] = False
        open_ = [root]
        while open_:
            i = open_.pop()
            new = np.flatnonzero(hit[i] & left)
            left[new] = False
            out += [(i, j) for j in new.tolist()]
            open_ += new.tolist()
    return out


def exact_links(rows: DataFrame, similar: float) -> DataFrame:
    """rows (grp, p, q, side, node, n, shingles) -> (node, links, null): links of a set, copies counted, within or between
    the blocks; and (node, null, other): true links that connect."""

    def run(batches):
        for t, cuts in _whole_groups(batches, ["grp", "p", "q"], 2 * BLOCK):
            nodes, n, sides, p, q = (t[c].to_numpy() for c in ("node", "n", "side", "p", "q"))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if y - x < 2:
                    continue
                hit = _linked([np.frombuffer(s, np.uint64) for s in t["shingles"].slice(x, y - x).to_pylist()], similar)
                if p[x] != q[x]:
                    hit &= sides[x:y, None] != sides[None, x:y]
                own, links = nodes[x:y], hit @ n[x:y]
                some, tree = np.flatnonzero(links), _tree(hit)
                a = np.array([i for i, _ in tree], np.int64)
                node = pa.array(np.concatenate([own[some], own[a]]), pa.int64())
                count = pa.array([*links[some].tolist(), *([None] * len(tree))], pa.int64())
                other = pa.array([*([None] * len(some)), *(int(own[j]) for _, j in tree)], pa.int64())
                yield pa.RecordBatch.from_arrays([node, count, other], names=["node", "links", "other"])

    return _dealt(rows, "grp", "p", "q").mapInArrow(run, "node long, links long, other long")


def fetched_sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """members (grp, size, node, n, rep, key) with the shingles of each, a row a node."""
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))

    def run(batches):
        shingle = Shingler()
        for batch in batches:
            sets = [shingle(t.as_py()) for t in batch.column("text")]
            own = pa.array([key_of(s) == k for s, k in zip(sets, batch.column("key").to_pylist(), strict=True)])
            columns = [*(batch.column(c) for c in ("grp", "size", "node", "n")), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["grp", "size", "node", "n", "shingles"]).filter(own)

    # sorted and merged at every size: sending the members to all tasks, as Spark would do with few, would not scale with them
    found = written(members.hint("merge").join(texts, "rep").select("grp", "size", "node", "n", "key", "text").mapInArrow(run, "grp long, size long, node long, n long, shingles binary"), "shingles")
    return found if found.count() == members.count() else found.dropDuplicates(["node"])


def centers(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(grp, center): of each block of CROWD members, the one with the highest average similarity; of those, the highest."""
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / CROWD)).cast("int")
    rows = members.select("grp", salt.alias("salt"), "node").join(sets.select("node", "sketch"), "node")

    def run(batches):
        for t, cuts in _whole_groups(batches, ["grp", "salt"]):
            lanes, out = _lanes_of(t), []
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                mean = _mean_agreement(lanes[x:y])
                k = int(np.argmax(mean))
                out.append((t["grp"][x].as_py(), t["node"][x + k].as_py(), float(mean[k])))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["grp", "node", "mean"])

    return _dealt(rows, "grp", "salt").mapInArrow(run, "grp long, node long, mean double").groupBy("grp").agg(F.max_by("node", F.struct("mean", "node")).alias("center"))


def near_center(rows: DataFrame, center: DataFrame, similar: float) -> DataFrame:
    """rows (grp, size, node, n, shingles) with ``near``: within half the threshold's distance of the group's center."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    own = rows.withColumns({"block": F.pmod(F.xxhash64("node"), blocks), "middle": F.lit(0)})
    middle = rows.join(center, (rows["grp"] == center["grp"]) & (rows["node"] == center["center"])).select(rows["grp"], "size", "node", "n", "shingles")
    middle = middle.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumn("middle", F.lit(-1))

    def run(batches):
        limit = 1_000_000 + round(similar * 1_000_000)
        for t, cuts in _whole_groups(batches, ["grp", "block"], 2 * BLOCK):
            near = np.zeros(t.num_rows, bool)
            data = t["shingles"].to_pylist()
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                c = np.frombuffer(data[x], np.uint64)
                for k in range(x + 1, y):
                    s = np.frombuffer(data[k], np.uint64)
                    common = len(np.intersect1d(c, s, assume_unique=True))
                    near[k] = 2_000_000 * common >= limit * (len(c) + len(s) - common)
            t = t.append_column("near", pa.array(near)).filter(pa.array(t["middle"].to_numpy() == 0))
            yield from t.select(["grp", "node", "n", "near", "shingles"]).combine_chunks().to_batches()

    both = own.unionByName(middle)
    dealt = both.repartition(parallelism(rows.sparkSession), "grp", "block").sortWithinPartitions("grp", "block", "middle")
    return dealt.mapInArrow(run, "grp long, node long, n long, near boolean, shingles binary")


def true_links(docs: DataFrame, members: DataFrame, sets: DataFrame, id_col: str, text_col: str, similar: float) -> DataFrame:
    """(node, links, null) and (node, null, other), as from exact_links, for all coarse groups."""
    found = fetched_sets(docs, members, id_col, text_col)
    one = found.filter(F.col("size") <= BLOCK).select("grp", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(0).alias("side"), "node", "n", "shingles")
    crowds = members.filter(F.col("size") > BLOCK)
    if crowds.isEmpty():
        return exact_links(one, similar)
    center = written(centers(crowds, sets), "centers")
    near = written(near_center(found.filter(F.col("size") > BLOCK), center, similar), "near")
    all_near = near.filter("near").groupBy("grp").agg(F.sum("n").alias("all"))
    inside = near.filter("near").select("grp", "node", "n").join(all_near, "grp").join(center, "grp")
    none = F.lit(None).cast("long")
    counted = inside.select("node", (F.col("all") - F.col("n")).alias("links"), none.alias("other"))
    spokes = inside.filter("node <> center").select("node", none.alias("links"), F.col("center").alias("other"))
    far = block_pairs(near.select("grp", "node", "n", "near"), "grp", "node", ~F.col("near"), BLOCK).select("grp", "p", "q", "side", "node", "n")
    compared = exact_links(one.unionByName(far.join(near.select("node", "shingles"), "node").select(*one.columns)), similar)
    return compared.unionByName(counted).unionByName(spokes)


def classes_of(rows: DataFrame) -> DataFrame:
    """(key, rep, n, node): a class of equal sets, its smallest id, its rows, and a number of its own: rep, or a hash of
    the key where an id has several texts and so stands for several classes."""
    classes = written(rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    shared = classes.groupBy("rep").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("of")).filter("of > 1").drop("of")
    if shared.isEmpty():
        return classes.withColumn("node", F.col("rep"))
    own = F.when(F.col("key") != F.col("least"), F.xxhash64("key")).otherwise(F.col("rep"))
    return classes.join(shared, "rep", "left").select("key", "rep", "n", own.alias("node"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: id, class_id (smallest id that links lead to), rep_id (smallest id with the same set of
    shingles), n_links (other rows with a similarity of at least similar, copies included)."""
    runs = runs_for(similar, recall)
    rows = written(sketches(docs, id_col, text_col, similar, runs), "sketches")
    classes = classes_of(rows)
    one = rows.join(classes.select("key", F.col("rep").alias("doc"), "rep", "n", "node"), ["key", "doc"]).drop("doc")
    sets = written(one, "sets")
    if sets.count() > classes.count():  # rows with the same id and text
        sets = written(sets.dropDuplicates(["node"]), "sets")
    coarse = written(components(candidates(sets, runs, similar)), "coarse")
    sizes = coarse.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = coarse.join(sizes, "component").join(sets.select("node", "n", "rep", "key"), "node").select(F.col("component").alias("grp"), "size", "node", "n", "rep", "key")
    exact = written(true_links(docs, written(members, "members"), sets, id_col, text_col, similar), "exact")
    groups = components(exact.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = exact.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    least = groups.join(sets.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("class_id"))
    linked = groups.join(least, "component").select("node", "class_id").join(counts, "node", "left")
    of_class = classes.join(linked, "node", "left").select("key", "rep", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    known = rows.select("doc", "key").join(of_class, "key", "left")
    out = known.select(F.col("doc").alias(id_col), F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("rep", "doc").alias("rep_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    null = F.lit(None).cast("long")
    lost = docs.filter(F.col(id_col).isNull()).select(null.alias(id_col), null.alias("class_id"), null.alias("rep_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(lost)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group, the one with the smallest id; rows with a null id stay."""
    gone = fresh("gone")
    found = similar_groups(docs, id_col, text_col).groupBy(F.col(id_col).alias(gone)).agg(F.bool_and(F.col(id_col) != F.col("class_id")).alias("all")).filter("all").select(gone)
    return docs.join(found, docs[id_col] == found[gone], "left_anti")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))
