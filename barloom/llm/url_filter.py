"""URL filters: rules by host and path, and link-graph propagation for the pages that no rule decides.

Rules: the longest rule whose host is the url's host or a parent domain of it, and whose path begins the url's path.

Propagation: hosts are nodes; an edge leads from the host of a page to each other host that the page's html links to,
weighted by the number of pages that do. A host's seeds are the shares of its pages that rules allow and block.
Trust is personalised PageRank along the edges from the allowed seeds; distrust is the same against the edges from the
blocked seeds (who links to bad hosts is distrusted). Both are kept unnormalised, score = seed + damping * (weighted
scores of the neighbours), so that a threshold means the same for a graph of any size: a host that no link touches
scores its own share. A host is blocked if its distrust is at least ``threshold`` and above its trust.

Everything is DataFrame work. A pass moves one row an edge and host, and its result is written to the shared folder, which
bounds the plan; passes go on until one adds less than TOLERANCE to every host (each adds at most ``damping`` of the one
before in all, so that is after about 115; PASSES is a stop for a damping near 1). Hosts with very many links or pages make skewed joins only, which adaptive
execution splits, and sums, which combine before they shuffle.

Defined cases: a null url, or one without ``://``, has empty host and path; no rule fits it and it is allowed; null
html has no links; a graph without edges leaves the seeds as they are; repeated pages each count and are each judged;
an empty table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import table, written

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
PASSES = 200
TOLERANCE = 1e-8  # passes end when none adds more to any host
THRESHOLD = 0.5

_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    out = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judged_by_rule(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    return (
        pages.withColumn("host", host_of(F.col(url_col)))
        .withColumn("path", path_of(F.col(url_col)))
        .withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    )


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, pages): links between different hosts."""
    links = F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1)))
    return (
        pages.filter(F.col(html_col).rlike(_LINK))
        .select(host_of(F.col(url_col)).alias("src"), F.explode(links).alias("dst"))
        .withColumn("dst", F.translate("dst", _UPPER, _LOWER))
        .filter("src <> dst AND src <> '' AND dst <> ''")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("pages"))
    )


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, passes: int = PASSES) -> DataFrame:
    """edges (src, dst, pages), seeds (host, trust, distrust) -> (host, trust, distrust) for all hosts that score."""
    seed = seeds.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) AS (kind, seed)")).filter("seed > 0")
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "pages").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "pages")
    )
    out = both.groupBy("kind", "host").agg(F.sum("pages").alias("all"))
    flow = written(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("pages") / F.col("all")).alias("w")), "flow")
    seed = written(seed, "seeds")
    # what a pass adds is what the pass before added, moved along the edges: passes go on until that is next to nothing
    rank = moved = seed.withColumnRenamed("seed", "score")
    for _ in range(passes if not flow.isEmpty() else 0):
        step = flow.join(moved, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("w") * F.col("score") * damping).alias("score"))
        moved = written(step.groupBy("kind", "host").agg(F.sum("score").alias("score")), "moved")
        rank = rank.unionByName(moved)
        most = moved.agg(F.max("score")).first()[0]
        if most is None or most < TOLERANCE:
            break
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(of("trust"), of("distrust"))


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", threshold: float = THRESHOLD, damping: float = DAMPING, passes: int = PASSES) -> DataFrame:
    """One row a page: id, host, path, rule, verdict, trust and distrust of its host."""
    judged = judged_by_rule(pages.select(F.col(id_col).alias("id"), "url"), rules)
    part = lambda verdict: F.count_if(F.col("fit.verdict") == verdict) / F.count(F.lit(1))
    seeds = judged.filter("host <> ''").groupBy("host").agg(part("allow").alias("trust"), part("block").alias("distrust"))
    scores = propagate(host_edges(pages), seeds, damping, passes)
    known = judged.join(scores, "host", "left")
    blocked = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return known.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(blocked, "block"), F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_urls(table(spark, sf_dir, "pages"))
    return found.withColumns({"trust": F.round("trust", 6), "distrust": F.round("distrust", 6)})


def _oracle(passes: int = 40) -> str:
    """The same in SQL, with the passes written out one after the other (what later ones would add is below the sixth digit
    only where few links are; the tables that this is held against have none between hosts)."""
    fits = lambda rule: f"(host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}')"
    longest = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    pick = lambda k: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[k]}'" for r in longest) + " END"
    steps = [
        f"m{k} AS MATERIALIZED (SELECT f.kind, f.dst AS host, sum(f.w * m.score * {DAMPING}) AS score FROM f JOIN m{k - 1} m ON f.kind = m.kind AND f.src = m.host GROUP BY 1, 2)" for k in range(1, passes + 1)
    ]
    return f"""WITH u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     h AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     j AS (SELECT page_id, host, path, {pick(1)} AS rule, {pick(0)} AS verdict FROM h),
     e AS (SELECT src, dst, count(*) AS pages FROM (SELECT host AS src, translate(unnest(list_distinct(regexp_extract_all(html, '{_LINK.replace("'", "''")}', 1))), '{_UPPER}', '{_LOWER}') AS dst FROM h) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
     b AS (SELECT 'trust' AS kind, src, dst, pages FROM e UNION ALL SELECT 'distrust', dst, src, pages FROM e),
     f AS MATERIALIZED (SELECT kind, src, dst, pages / sum(pages) OVER (PARTITION BY kind, src) AS w FROM b),
     s AS (SELECT host, count_if(verdict = 'allow') / count(*) AS trust, count_if(verdict = 'block') / count(*) AS distrust FROM j WHERE host <> '' GROUP BY host),
     m0 AS MATERIALIZED (SELECT 'trust' AS kind, host, trust AS score FROM s WHERE trust > 0 UNION ALL SELECT 'distrust', host, distrust FROM s WHERE distrust > 0),
     {", ".join(steps)},
     r AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END) AS trust, sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) AS distrust FROM ({" UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(passes + 1))}) GROUP BY host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN distrust >= {THRESHOLD} AND distrust > trust THEN 'block' END, 'allow') AS verdict, round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust
FROM j LEFT JOIN r USING (host)
"""


ORACLE = _oracle()
