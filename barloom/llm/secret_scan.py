"""Secret scans with an incremental ledger of blobs.

Every version of every document is content-addressed by the SHA-256 of its text: a blob. The ledger has a row for each
blob and rule version that has been scanned, with what was found. A scan takes the blobs of the documents, leaves out
each pair of blob and rule version that the ledger has, scans each remaining blob once whatever number of paths
has it, and appends; findings are then joined back to all paths that have the blob. The ledger is a Parquet folder
(``open_ledger``, ``update``, ``read_ledger``); a second update with the same documents scans nothing, which the query does and checks.

Positions without leaving the JVM: splitting a text by a pattern gives the stretches between its matches, so the running
sum of the lengths of stretches and matches gives each match's start, in code points.

Rules (kinds) by version: ``base-1`` has assign, access and hex, ``pem-1`` adds headers of private keys. The pattern of
access and hex ask for the least length themselves; that finds the same spans, since a shorter run has no longer part.

Defined cases: null text is the empty text; empty texts have no findings (and one blob); repeated rows and texts are
scanned once and reported for each row; an empty table gives an empty result; columns other than the named ones are
not read; an empty ledger is None. One text is one group: findings of a blob are gathered by blob, never by path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import shared_dir, table, text_of, written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> (rule version, pattern, group whose length counts, least length); in the order in which ties are listed
RULES = {
    "assign": ("base-1", ASSIGN, 2, 8),
    "access": ("base-1", r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": ("base-1", r"[0-9a-f]{32,}", 0, 32),
    "pem": ("pem-1", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
}
BASE = ("assign", "access", "hex")
VERSIONS = tuple(dict.fromkeys(r[0] for r in RULES.values()))


def blobs_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(blob, text): each distinct text once."""
    return docs.select(text_of(text_col).alias("text")).select(F.sha2("text", 256).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))


def _matches(kind: str) -> Column:
    """array<struct<kind, at, gap, len, ok>> of a kind in ``text``, for a text that still has the kind to be scanned for."""
    _, pattern, group, least = RULES[kind]
    p, m, g = f"__p_{kind}", f"__m_{kind}", f"__g_{kind}"
    zipped = F.arrays_zip(p, m, g)
    return F.transform(
        zipped,
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("at"), F.length(z[p]).alias("gap"), F.length(z[m]).alias("len"), (F.length(z[g]) >= least).alias("ok")
        ),
    )


def _parts(kind: str) -> dict[str, Column]:
    version, pattern, group, _ = RULES[kind]
    todo = F.array_contains("todo", version) & F.col("text").rlike(pattern)
    found = lambda x: F.when(todo, x).otherwise(F.array().cast("array<string>"))
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    return {
        f"__p_{kind}": found(F.split("text", pattern, -1)),
        f"__m_{kind}": found(whole),
        f"__g_{kind}": found(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else whole),
    }


SCANNED = "blob string, versions array<string>, findings array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def open_ledger(spark: SparkSession, path: str | None = None) -> str:
    """The folder of a ledger; a new one, in the shared folder, if none is named. Scans append to it."""
    path = path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    spark.createDataFrame([], SCANNED).write.mode("append").parquet(path)
    return path


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCANNED).parquet(path)


def unseen(docs: DataFrame, ledger: DataFrame | None, text_col: str = "text", versions: tuple[str, ...] = VERSIONS) -> DataFrame:
    """(blob, todo array<string>): each blob of docs with the rule versions that the ledger doesn't have for it. Texts stay where they are."""
    everything = F.array(*map(F.lit, versions))
    blobs = docs.select(F.sha2(text_of(text_col), 256).alias("blob")).distinct()
    if ledger is None:
        return blobs.withColumn("todo", everything)
    seen = ledger.select("blob", F.explode("versions").alias("v")).groupBy("blob").agg(F.collect_set("v").alias("seen"))
    none = F.array().cast("array<string>")
    return blobs.join(seen, "blob", "left").select("blob", F.array_except(everything, F.coalesce("seen", none)).alias("todo")).filter(F.size("todo") > 0)


def update(docs: DataFrame, path: str, text_col: str = "text", versions: tuple[str, ...] = VERSIONS) -> int:
    """Scan what the ledger at path has not seen of docs, append it, and return the number of blobs scanned."""
    spark = docs.sparkSession
    ledger = read_ledger(spark, path)
    if ledger.isEmpty():
        before, new = 0, scan(docs, None, text_col, versions)
    else:
        todo = written(unseen(docs, ledger, text_col, versions), "unseen")
        if todo.isEmpty():
            return 0
        before, new = ledger.count(), scan(docs, ledger, text_col, versions, todo)
    new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in ledger.schema)).write.mode("append").parquet(path)
    return read_ledger(spark, path).count() - before


def scan(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", versions: tuple[str, ...] = VERSIONS, todo: DataFrame | None = None) -> DataFrame:
    """New rows for the ledger: (blob, versions array<string>, findings array<struct<start,rank,kind,end>>)."""
    blobs = blobs_of(docs, text_col)
    if ledger is None:
        blobs = blobs.withColumn("todo", F.array(*map(F.lit, versions)))
    else:
        blobs = blobs.join(unseen(docs, ledger, text_col, versions) if todo is None else todo, "blob")
    parts: dict[str, Column] = {}
    for kind in RULES:
        parts |= _parts(kind)
    split = blobs.withColumns(parts).select("blob", "todo", F.concat(*map(_matches, RULES)).alias("all"))
    before = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.array_position(F.array(*map(F.lit, RULES)), F.col("kind")).cast("int")
    end = F.sum(F.col("gap") + F.col("len")).over(before)
    return (
        split.select("blob", F.col("todo").alias("versions"), F.explode_outer("all").alias("m"))
        .select("blob", "versions", "m.*")
        .withColumn("end", end)
        .withColumn("hit", F.when(F.col("ok"), F.struct((F.col("end") - F.col("len")).alias("start"), rank.alias("rank"), "kind", "end")))
        .groupBy("blob")
        .agg(F.first("versions").alias("versions"), F.sort_array(F.collect_list("hit")).alias("findings"))
    )


def by_path(docs: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, blob, findings) for every row of docs; ledger may have several rows a blob, one for each scan."""
    at = docs.select(F.col(id_col), F.sha2(text_of(text_col), 256).alias("blob"))
    known = ledger.filter(F.size("findings") > 0)
    known = known.select("blob", F.explode("findings").alias("f")).groupBy("blob").agg(F.sort_array(F.collect_list("f")).alias("findings"))
    return at.join(known, "blob", "left").select(id_col, "blob", F.coalesce("findings", F.array().cast(known.schema["findings"].dataType)).alias("findings"))


def _listed(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = open_ledger(spark)
    update(docs, path)
    if update(docs, path):  # the same blobs again: the ledger has them all
        raise RuntimeError("the ledger has lost blobs that it had scanned")
    found = by_path(docs, read_ledger(spark, path))
    base = F.filter("findings", lambda f: f["kind"].isin(*BASE))
    count = lambda kind: F.coalesce(F.size(F.filter("findings", lambda f: f["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, BASE),
        F.sha2(F.coalesce(_listed(base), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_listed(F.col("findings")), F.lit("")).alias("spans"),
    )


_SQL_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     k AS (
       SELECT doc_id, 1 AS rank, 'assign' AS kind, string_split_regex(t, '@assign') AS p, regexp_extract_all(t, '@assign', 0) AS m, list_transform(regexp_extract_all(t, '@assign', 2), lambda x: length(x) >= 8) AS ok FROM d
       UNION ALL SELECT doc_id, 2, 'access', string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), list_transform(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16) FROM d
       UNION ALL SELECT doc_id, 3, 'hex', string_split_regex(t, '[0-9a-f]{32,}'), regexp_extract_all(t, '[0-9a-f]{32,}'), list_transform(regexp_extract_all(t, '[0-9a-f]{32,}'), lambda x: true) FROM d
       UNION ALL SELECT doc_id, 4, 'pem', string_split_regex(t, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'), regexp_extract_all(t, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'), list_transform(regexp_extract_all(t, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'), lambda x: true) FROM d),
     e AS (SELECT doc_id, rank, kind, unnest(range(1, len(m) + 1)) AS i, p, m, ok FROM k WHERE len(m) > 0),
     s AS (SELECT doc_id, rank, kind, CAST(list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS BIGINT) AS a, length(m[i]) AS n FROM e WHERE ok[i]),
     g AS (SELECT doc_id, count(CASE WHEN kind = 'assign' THEN 1 END) AS n_assign, count(CASE WHEN kind = 'access' THEN 1 END) AS n_access, count(CASE WHEN kind = 'hex' THEN 1 END) AS n_hex,
             string_agg(CASE WHEN rank < 4 THEN kind || ':' || a || ':' || (a + n) END, ',' ORDER BY a, rank) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rank) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
""".replace("@assign", _SQL_ASSIGN)
