"""URL verdicts by rules and by trust in the link graph, in DataFrame operations only.

A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with the
rule's path; the longest fitting rule wins. URLs without a rule get their host's verdict: hosts are
seeds by the share of their pages that rules allow (trust) or block (distrust); trust flows along
links as personalised PageRank with damping 0.85, until the scores stand still. Distrust flows against
them: a host takes 0.85 of the mean distrust of what its links lead to, however many other hosts link
there. A host is blocked if its distrust exceeds its trust and reaches ``BLOCK_AT``; both are rounded
to six places first, as sums differ in their last bits by the order in which they are added. (1 -
damping) / 2 is what a host has of its own if half of its pages are blocked.

Links are absolute or protocol-relative ``href`` values; links within a host and hosts with no links
move nothing. Edges are aggregated per pair of hosts before the first join, so a hot host is one row
per target. Null url or no ``://``: empty host and path, which no rule fits and no link reaches; its
verdict is its seeds', allow. Null html has no links. Null ids, repeated rows: each row is judged. Ties:
of rules of equal length none fits one URL twice; equal trust and distrust do not block. Very long
pages are searched for links whole. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Scratch

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, STILL = 0.85, 1e-7
#: Rounds of the SQL form: what is missing after them is below the sixth place.
ROUNDS = 110
BLOCK_AT = (1 - DAMPING) / 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\shref\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct of name and verdict, or null."""
    out = None
    for name, prefix, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        value = F.struct(F.lit(name + prefix).alias("name"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts, w as the share of the links that leave src."""
    links = F.transform(F.regexp_extract_all(F.col("html").cast("string"), F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER))
    pairs = pages.select(host_of(pages["url"].cast("string")).alias("src"), F.explode(links).alias("dst")).filter("src <> dst")
    counts = pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = counts.groupBy("src").agg(F.sum("n").alias("all"))
    return counts.join(total, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("w"))


def propagate(scratch: Scratch, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Fixed point of score = (1 - damping) seed + damping (scores over edges); seeds (kind, node, seed), edges (kind, src, dst, w).

    Scores are written each round; a round shrinks what is missing by the damping at least, and the
    loop ends once no score moves by over ``STILL``.
    """
    base = scratch.table(seeds.select("kind", "node", ((1 - DAMPING) * F.col("seed")).alias("own")))
    scores = scratch.table(base.select("kind", "node", F.col("own").alias("score")))
    while True:
        moved = scores.join(edges.withColumnRenamed("src", "node"), ["kind", "node"]).groupBy("kind", F.col("dst").alias("node")).agg(F.sum(DAMPING * F.col("score") * F.col("w")).alias("in"))
        score = F.coalesce("own", F.lit(0.0)) + F.coalesce("in", F.lit(0.0))
        new = base.join(moved, ["kind", "node"], "full").join(scores.withColumnRenamed("score", "old"), ["kind", "node"], "left")
        new = scratch.table(new.select("kind", "node", score.alias("score"), F.abs(score - F.coalesce("old", F.lit(0.0))).alias("step")))
        scratch.drop(scores)
        scores = new.select("kind", "node", "score")
        scores._scratch_path = new._scratch_path
        if (new.agg(F.max("step")).first()[0] or 0) <= STILL:
            return scores


def url_verdicts(pages: DataFrame, rules=RULES, scratch: Scratch | None = None) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict."""
    scratch = scratch or Scratch(pages.sparkSession)
    url = pages["url"].cast("string")
    judged = pages.select(pages["page_id"].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.when(F.col("r.verdict") == v, 1.0).otherwise(0.0))
    hosts = judged.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("seed")) for k in ("trust", "distrust")])).alias("x")
    seeds = hosts.select("host", kinds).select("x.kind", F.col("host").alias("node"), "x.seed")
    links = scratch.table(host_edges(pages))
    against = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    edges = scratch.table(links.select(F.lit("trust").alias("kind"), "src", "dst", "w").unionByName(against))
    scores = propagate(scratch, seeds, edges)
    trust, distrust = (F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)) for k in ("trust", "distrust"))
    trust, distrust = (F.round(x, 6) for x in (trust, distrust))
    blocked = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= BLOCK_AT)
    verdicts = scores.groupBy(F.col("node").alias("host")).agg(trust.alias("trust"), distrust.alias("distrust")).select("host", F.when(blocked, "block").otherwise("allow").alias("of_host"))
    return judged.join(scratch.table(verdicts), "host", "left").select("page_id", "host", "path", F.col("r.name").alias("rule"), F.coalesce("r.verdict", "of_host", F.lit("allow")).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    case = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES) + " END"
    return rf"""
WITH RECURSIVE cut AS (SELECT page_id, html, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (SELECT page_id, html, host, path, {case} AS rule FROM cut),
judged AS (SELECT *, {verdict} AS own FROM ruled),
raw AS (SELECT host AS src, lower(unnest(regexp_extract_all(html, '(?i)\shref\s*=\s*["'']?(?:https?:)?//([^/?#"''\s<>]+)', 1))) AS dst FROM judged),
counts AS (SELECT src, dst, count(*) AS n FROM raw WHERE src <> dst GROUP BY ALL),
links AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM counts),
edges AS (SELECT 'trust' AS kind, src, dst, w FROM links UNION ALL SELECT 'distrust', dst, src, w FROM links),
seeds AS (SELECT host, avg(CASE WHEN own = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN own = 'block' THEN 1.0 ELSE 0.0 END) AS distrust FROM judged GROUP BY host),
s0 AS (SELECT 'trust' AS kind, host AS node, {1 - DAMPING} * trust AS score FROM seeds UNION ALL SELECT 'distrust', host, {1 - DAMPING} * distrust FROM seeds),
nodes AS (SELECT kind, node, sum(score) AS own FROM (SELECT * FROM s0 UNION ALL SELECT DISTINCT kind, dst, 0.0 FROM edges) GROUP BY ALL),
step AS (SELECT 0 AS r, kind, node, own AS score FROM nodes
UNION ALL SELECT r + 1, kind, node, own + coalesce(moved, 0) FROM (SELECT DISTINCT r FROM step WHERE r < {ROUNDS} AND (SELECT count(*) FROM edges) > 0) CROSS JOIN nodes
  LEFT JOIN (SELECT kind, dst AS node, sum({DAMPING} * score * w) AS moved FROM (SELECT * FROM step) s JOIN edges e USING (kind) WHERE s.node = e.src GROUP BY kind, dst) USING (kind, node)),
verdicts AS (SELECT node AS host, round(sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END), 6) AS t, round(sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END), 6) AS d FROM step WHERE r = (SELECT max(r) FROM step) GROUP BY node)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN d > t AND d >= {BLOCK_AT} THEN 'block' ELSE 'allow' END) AS verdict FROM judged LEFT JOIN verdicts USING (host)"""


ORACLE = _oracle()
