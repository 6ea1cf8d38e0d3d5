"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content. The ledger has a row for each
blob, rule and rule version that has been scanned, with the spans found. A scan takes each distinct
blob once, runs only the rules whose (blob, rule version) the ledger lacks, appends what is new to the
ledger, and joins the findings back to all versions that hold the blob. So a text with a thousand
copies is scanned once, and a new rule version scans each blob again for that rule alone. The ledger
is a Parquet folder; ``LEDGER_CONF`` names one that outlives the run, else each run starts its own.

Rules: the base rules ``assign``, ``access`` and ``hex``, and the added ``pem`` (private key headers)
and ``jwt`` (three base64url parts, the first of them a JSON object). Matches are leftmost and do not
overlap within a rule; failing ones are dropped without retry. Places come from the lengths of the
matches and of the gaps between them, summed in runs of ``RUN`` matches, so the work on a very long text
grows with its matches. Null text: empty. Null ids, repeated rows and ids: each row gets its own
result. Ties: spans of one start are listed by kind. An empty table gives no rows; extra columns are
ignored. Identical blobs are merged before the shuffle, so a hot blob is a row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, exists

#: kind: (rule version, pattern, group whose length counts, least length)
RULES = {
    "assign": (1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (1, r"[0-9a-f]{16,}", 0, 16),
    "pem": (1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    "jwt": (1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
}
BASE = ("assign", "access", "hex")
SPANS = "array<struct<start:bigint,end:bigint>>"
LEDGER = f"blob string, rule string, version int, spans {SPANS}"
#: Session setting that names a ledger's folder.
LEDGER_CONF = "quillon.secrets.ledger"
RUN = 512


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, where a lambda needs it again and again."""
    return F.transform(F.array(value), use)[0]


def rule_spans(text: Column, rule: str) -> Column:
    """Array of (start, end) in code points, for texts that have a match at all.

    Places are running sums. An array that grows by one match is copied each time, so sums run over
    runs of ``RUN`` matches, from the sums before each run.
    """
    _, pattern, group, least = RULES[rule]
    lengths = lambda x: F.transform(x, lambda y: F.char_length(y).cast("long"))
    # the last gap has no match: its size and value are null
    found = F.arrays_zip(
        lengths(F.split(text, pattern, -1)).alias("gap"),
        lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("size"),
        lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("value"),
    )
    zero = F.lit(0).cast("long")
    taken = lambda x: x["gap"] + F.coalesce(x["size"], zero)

    def step(acc, x):
        begin, end = acc["at"] + x["gap"], acc["at"] + taken(x)
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["value"] >= least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def within(run, at):
        return F.aggregate(run, F.struct(at.alias("at"), F.array().cast(SPANS).alias("out")), step, lambda acc: acc["out"])

    def over(runs):
        sums = F.transform(runs, lambda run: F.aggregate(run, zero, lambda acc, x: acc + taken(x)))
        starts = F.aggregate(sums, F.array(zero), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
        return F.flatten(F.zip_with(runs, F.slice(starts, 1, F.size(runs)), within))

    def split(matches):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / RUN).cast("int")), lambda k: F.slice(matches, k * RUN + 1, RUN))

    return bound(found, lambda matches: bound(split(matches), over))


def scan_versions(versions: DataFrame, text_col: str, ledger: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(findings, additions): per blob ``blob`` and one span array per rule; and the ledger's new rows.

    ``ledger`` has blob, rule, version and spans. Its rows of other versions of a rule are not used.
    """
    text = F.coalesce(versions[text_col].cast("string"), F.lit(""))
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        known = blobs.select("blob", "text", *[F.lit(None).cast(SPANS).alias(f"old_{r}") for r in RULES])
    else:
        current = F.expr(" OR ".join(f"(rule = '{r}' AND version = {v[0]})" for r, v in RULES.items()))
        seen = ledger.filter(current).groupBy("blob").agg(*[F.first(F.when(F.col("rule") == r, F.col("spans")), ignorenulls=True).alias(f"old_{r}") for r in RULES])
        known = blobs.join(seen, "blob", "left")
    empty = F.array().cast(SPANS)
    scanned = [F.when(F.col(f"old_{r}").isNotNull(), F.col(f"old_{r}")).when(F.col("text").rlike(RULES[r][1]), rule_spans(F.col("text"), r)).otherwise(empty).alias(r) for r in RULES]
    result = scratch.table(known.select("blob", *scanned, *[F.col(f"old_{r}").isNull().alias(f"new_{r}") for r in RULES]))
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(RULES[r][0]).alias("version"), F.col(r).alias("spans"), F.col(f"new_{r}").alias("is_new")) for r in RULES]))
    additions = result.select("blob", rows.alias("x")).filter("x.is_new").select("blob", "x.rule", "x.version", "x.spans")
    return result.select("blob", *RULES), additions


def joined_spans(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""

    def part(i: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.struct(x["start"].alias("s"), F.lit(i).alias("k"), x["end"].alias("e"), F.lit(kind).alias("n")))

    parts = [part(i, k) for i, k in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda x: F.concat_ws(":", x["n"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger in a folder, or None if there is none yet."""
    return spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else None


def secret_spans(df: DataFrame, ledger: DataFrame | None = None, scratch: Scratch | None = None, append_to: str | None = None) -> DataFrame:
    """Per row: doc_id, counts of the base rules, base_sha256, all spans and the blob's address.

    What ``ledger`` lacked is appended to the folder ``append_to``.
    """
    scratch = scratch or Scratch(df.sparkSession)
    findings, additions = scan_versions(df, "text", ledger, scratch)
    if append_to:
        additions.write.mode("append").parquet(append_to)
    digest = findings.select("blob", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(joined_spans(BASE), 256).alias("base_sha256"), joined_spans(tuple(RULES)).alias("spans"))
    digest = scratch.table(digest)
    paths = df.select(df["doc_id"].cast("long").alias("doc_id"), F.sha2(F.coalesce(df["text"].cast("string"), F.lit("")), 256).alias("blob"))
    return paths.join(digest, "blob").select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "blob")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the ledger; what is new is scanned and added to it."""
    scratch = Scratch(spark)
    path = spark.conf.get(LEDGER_CONF, None) or f"{scratch.base}/ledger"
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_ledger(spark, path), scratch, path)


def _duck(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT r, {rank} AS k, '{kind}' AS kind, s AS start, s + size AS stop FROM (
  SELECT r, size, value, sum(gap + size) OVER (PARTITION BY r ORDER BY i) - size AS s FROM (
    SELECT r, unnest(list_transform(m, lambda x: length(x))) AS size, unnest(list_transform(v, lambda x: length(x))) AS value,
      unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT r, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS v, string_split_regex(text, '{p}') AS g
      FROM docs WHERE regexp_matches(text, '{p}')))) WHERE value >= {least}"""


ORACLE = (
    "WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),\nspans AS ("
    + "\nUNION ALL ".join(_duck(k, i, *v[1:]) for i, (k, v) in enumerate(RULES.items()))
    + r"""),
listed AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (WHERE k < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob
FROM docs LEFT JOIN listed USING (r)"""
)
