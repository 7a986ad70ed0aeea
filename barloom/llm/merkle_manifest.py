"""Merkle manifest of a table: digests of rows, of languages and of the whole table, with a proof for every row.

Leaves of a group are put in order by ranges: rows (without their texts) are dealt to ranges of (group, order), sorted
within them, and numbered from where their range begins, so no group is ever sorted in one task. Leaves then form
blocks of at most FAN ** LEVELS consecutive ones, whatever group they are of; a block is one row with an ordered array, whose levels
are collapsed by sequence, transform, slice and aggregate. The block roots are the nodes of the next round, with
positions that they have already, and so on until one node is left a group; the roots of the groups are ordered and
collapsed in the same way. A round shuffles FAN ** LEVELS times fewer rows than the one before. On the way back each
block gets the path above it, and at last each leaf: what stands before and after it in each run.

Defined cases: null values have a digest of their own, unlike that of the empty text; a null id sorts before all others; rows
that agree in group and id are ordered by their leaves (equal rows are leaves each); a null group comes first and is
one group; an empty table gives an empty result; texts of any length are hashed whole; a lone leaf is its group's root, and a
lone group's root is the root, then a proof has no sibling; other columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import parallelism, table, written

FAN = 8
LEVELS = 3  # that a block collapses
TAMPERED = 3  # every so many-th id by CRC-32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: Column) -> Column:
    """Lower-case hex SHA-256 of an array of strings, joined by nothing."""
    return F.sha2(F.array_join(parts, ""), 256)


def encoded(value: Column) -> Column:
    """Byte count, colon, value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns.values()]), 256)


def matched(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """The inner join by columns that may be null, which equals null; those of the right side go."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in by})
    return left.join(right, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])).drop(*[f"_{c}" for c in by])


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with ``pos`` (from 0, by ``order`` within each ``by``) and ``n`` (rows of the group). rows must be a stored table:
    its partitions are read more than once."""
    spark = rows.sparkSession
    # the last key deals out rows that agree in all others
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parallelism(spark), *by, *order, "tie")
    own = F.monotonically_increasing_id()
    placed = ranged.sortWithinPartitions(*by, *order, "tie").drop("tie").withColumn("own", own)
    placed = written(placed.select("*", F.shiftright("own", 33).alias("part"), F.col("own").bitwiseAND((1 << 33) - 1).alias("at")).drop("own"), "placed")
    counts = placed.groupBy(*by, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    # a row for each range and group within it: as many as there are ranges and groups, so summed by group
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*by, "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n"))
    return matched(placed, offsets, [*by, "part"]).select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n")


def levels_of(n: Column, fan: int, most: int) -> Column:
    """How many levels a block of a group of n nodes collapses: until one node is left, at most ``most``."""
    out = F.lit(most)
    for k in range(most - 1, -1, -1):
        out = F.when(n <= fan**k, k).otherwise(out)
    return out


def _next_level(nodes: Column, fan: int) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fan).cast("int"))
    return F.transform(runs, lambda i: digest(F.slice(nodes, i * fan + 1, fan)))


def _collapsed(nodes: Column, depth: Column, fan: int, most: int) -> Column:
    """All levels of a block, the given nodes first."""
    steps = F.filter(F.sequence(F.lit(1), F.lit(max(1, most))), lambda k: k <= depth)
    return F.aggregate(steps, F.array(nodes), lambda acc, _: F.concat(acc, F.array(_next_level(F.element_at(acc, -1), fan))))


def _path(levels: Column, at: Column, fan: int) -> Column:
    """What stands before and after node ``at`` (from 0) in the run of each level but the last."""
    below = F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0)))

    def step(nodes: Column, k: Column) -> Column:
        own = F.floor(at / F.pow(F.lit(float(fan)), k)).cast("int")
        within = F.pmod(own, F.lit(fan))
        return F.struct(
            F.array_join(F.slice(nodes, own - within + 1, within), "").alias("before"),
            F.array_join(F.slice(nodes, own + 2, F.lit(fan - 1) - within), "").alias("after"),
        )

    return F.transform(below, step)


_NO_PATH = "array<struct<before:string,after:string>>"


def tree(nodes: DataFrame, by: list[str], most: int, payload: list[str], fan: int = FAN, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """nodes (by, pos, n, node, payload), pos from 0 to n - 1 and n at most ``most`` -> their paths (by, payload, node, path,
    top) and the groups' roots (by, top)."""
    span = fan**levels
    row = F.struct(F.pmod("pos", F.lit(span)).alias("at"), "node", *payload)
    grouped = nodes.groupBy(*by, F.floor(F.col("pos") / span).alias("pos")).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.first("n").alias("n"))
    depth = levels_of(F.col("n"), fan, levels)
    blocks = grouped.withColumn("levels", _collapsed(F.col("rows.node"), depth, fan, levels)).withColumn("root", F.element_at(F.element_at("levels", -1), 1))
    blocks = written(blocks, "blocks")
    if most <= span:
        done = blocks.withColumns({"above": F.array().cast(_NO_PATH), "top": F.col("root")})
        roots = blocks.select(*by, F.col("root").alias("top"))
    else:
        upper = blocks.select(*by, "pos", F.ceil(F.col("n") / span).alias("n"), F.col("root").alias("node"))
        paths, roots = tree(upper.withColumn("block", F.col("pos")), by, -(-most // span), ["block"], fan, levels)
        done = matched(blocks, paths.select(*by, F.col("block").alias("pos"), F.col("path").alias("above"), "top"), [*by, "pos"])
    each = F.transform("rows", lambda r: F.struct(*[r[p].alias(p) for p in payload], r["node"].alias("node"), F.concat(_path(F.col("levels"), r["at"], fan), F.col("above")).alias("path")))
    return done.select(*by, "top", F.inline(each)).select(*by, *payload, "node", "path", "top"), roots


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, leaf, lambda acc, step: F.sha2(F.concat(step["before"], acc, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    return digest(F.transform(path, lambda s: F.concat(s["before"], s["after"])))


def manifest(rows: DataFrame, id_col: str, group_col: str, fields: list[str], changed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """A row for each row: id, leaf, subroot, root, path, and ``other``: the leaf of the row with its ``changed`` columns where
    ``when`` holds, else the leaf itself."""
    columns = {f: F.col(f) for f in fields}
    leaf = leaf_of(columns)
    other = F.when(when, leaf_of(columns | (changed or {}))) if when is not None else F.lit(None).cast("string")
    leaves = written(rows.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf.alias("node"), other.alias("other")), "leaves")
    placed = written(numbered(leaves, ["grp"], ["id", "node"]), "numbered")
    most = placed.agg(F.max("n")).first()[0]
    if most is None:
        return placed.select("id", F.col("node").alias("leaf"), F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(_NO_PATH).alias("path"), "other")
    paths, roots = tree(placed, ["grp"], most, ["id", "other"])
    roots = written(roots.withColumnRenamed("top", "node"), "subroots")
    groups = numbered(roots, [], ["grp"])
    upper, _ = tree(groups, [], roots.count(), ["grp"])
    upper = written(upper.select("grp", F.col("path").alias("above"), F.col("top").alias("root")), "upper")
    return matched(paths, upper, ["grp"]).select("id", F.col("node").alias("leaf"), F.col("top").alias("subroot"), "root", F.concat("path", "above").alias("path"), F.coalesce("other", "node").alias("other"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    found = manifest(docs, "doc_id", "lang", list(FIELDS), {"text": F.translate("text", _UPPER, _LOWER)}, tampered)
    folds = folded(F.col("other"), F.col("path"))
    out = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folds.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


# crc32 has no DuckDB function: its table of 256 entries is built by rule, and folded over the id's digits.
ORACLE = r"""
WITH RECURSIVE bits(k, step, v) AS (
       SELECT k, 0, k FROM (SELECT unnest(range(256)) AS k)
       UNION ALL SELECT k, step + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8),
     crc_table AS (SELECT list(v ORDER BY k) AS t FROM bits WHERE step = 8),
     ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL),
     crc(doc_id, s, i, c) AS (
       SELECT doc_id, s, 0, CAST(4294967295 AS BIGINT) FROM ids
       UNION ALL SELECT doc_id, s, i + 1, xor(c >> 8, CAST(t[1 + (xor(c & 255, ascii(s[i + 1])))] AS BIGINT)) FROM crc, crc_table WHERE i < length(s)),
     tampered AS (SELECT doc_id FROM crc WHERE i = length(s) AND xor(c, 4294967295) % 3 = 0),
     enc AS (SELECT doc_id, lang,
                    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head, text FROM documents),
     leaves AS (SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                       sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS low FROM enc),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos FROM leaves),
     low_tree(lang, level, pos, node, n) AS (
       SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM ranked
       UNION ALL
       SELECT lang, level + 1, p, node, count(*) OVER (PARTITION BY lang)
       FROM (SELECT lang, level, pos // 8 AS p, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM low_tree WHERE n > 1 GROUP BY lang, level, pos // 8)),
     subroots AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM low_tree WHERE n = 1),
     top_tree(level, pos, node, n) AS (
       SELECT 0, pos, subroot, count(*) OVER () FROM subroots
       UNION ALL
       SELECT level + 1, p, node, count(*) OVER ()
       FROM (SELECT level, pos // 8 AS p, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM top_tree WHERE n > 1 GROUP BY level, pos // 8)),
     root AS (SELECT node AS root FROM top_tree WHERE n = 1),
     depth AS (SELECT lang, max(level) AS levels FROM low_tree GROUP BY lang),
     steps AS (SELECT r.doc_id, r.leaf, t.level AS k, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < r.pos // CAST(pow(8, t.level) AS BIGINT)), '') AS before,
                      coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > r.pos // CAST(pow(8, t.level) AS BIGINT)), '') AS after
               FROM ranked r JOIN depth d ON r.lang IS NOT DISTINCT FROM d.lang
               JOIN low_tree t ON t.lang IS NOT DISTINCT FROM r.lang AND t.level < d.levels AND t.pos // 8 = r.pos // CAST(pow(8, t.level + 1) AS BIGINT)
               GROUP BY r.doc_id, r.leaf, t.level
               UNION ALL
               SELECT r.doc_id, r.leaf, 100 + t.level, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < s.pos // CAST(pow(8, t.level) AS BIGINT)), ''),
                      coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > s.pos // CAST(pow(8, t.level) AS BIGINT)), '')
               FROM ranked r JOIN subroots s ON r.lang IS NOT DISTINCT FROM s.lang
               JOIN top_tree t ON t.level < (SELECT max(level) FROM top_tree) AND t.pos // 8 = s.pos // CAST(pow(8, t.level + 1) AS BIGINT)
               GROUP BY r.doc_id, r.leaf, t.level),
     proof AS (SELECT doc_id, leaf, list(struct_pack(b := before, a := after) ORDER BY k) AS path, string_agg(before || after, '' ORDER BY k) AS siblings FROM steps GROUP BY doc_id, leaf),
     start AS (SELECT r.doc_id, r.lang, r.leaf, CASE WHEN t.doc_id IS NULL THEN r.leaf ELSE r.low END AS h, coalesce(p.path, []) AS path, coalesce(p.siblings, '') AS siblings
               FROM ranked r LEFT JOIN tampered t ON r.doc_id = t.doc_id LEFT JOIN proof p ON p.doc_id = r.doc_id AND p.leaf = r.leaf),
     fold(doc_id, leaf, i, h, path) AS (
       SELECT doc_id, leaf, 0, h, path FROM start
       UNION ALL SELECT doc_id, leaf, i + 1, sha256(path[i + 1].b || h || path[i + 1].a), path FROM fold WHERE i < len(path))
SELECT s.doc_id, s.leaf, r.subroot, root.root, sha256(s.siblings) AS proof_sha256, f.h AS folded_root, f.h = root.root AS verified
FROM start s JOIN subroots r ON s.lang IS NOT DISTINCT FROM r.lang CROSS JOIN root
JOIN fold f ON f.doc_id = s.doc_id AND f.leaf = s.leaf AND f.i = len(f.path)
"""
