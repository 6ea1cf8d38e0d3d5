"""How filters interact: survivors of every subset of five filters, and every order of applying them.

    A  under 200 words                      B  under half of the words are distinct
    C  over 2 % of the characters are A-Z   D  holds one of # $ % & * |
    E  the text of a document with a smaller id

Texts are read once: flags A to D, a SHA-256 of the text and the label go to a table of short rows.
E needs the smallest id of each text. That is a minimum per text with partial sums before the
shuffle, joined back on (text, id), so that a text which a third of the rows share is spread by id.
The rows are then counted by part and flags, at most 32 counts a part and kind of label. A CUBE over
these counts gives, for a part and a set of selected flags, the documents with none of them set:
the survivors of that subset. A step of an order leads from one subset to the next, so its counts are
differences of two survivor rows, joined by part and subset.

Edge cases: a null text is an empty one, it fails A (no words; B and C not, as 0 < 0 is false) and equals
other null and empty texts; a null source is the part ''; repeated rows count each time, and rows of one
id and text do not fail E against each other; a null id is no smaller than any id, has no label and never
fails E; several labels of a document count as one, if any says so; ties do not arise; texts of any length
are taken whole; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Scratch

FILTERS = "ABCDE"
COUNTS = ("docs", "good", "toxic")

_WORDS = r"regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+', 0)"
#: Counts of a text's words, in one expression, so that the words are taken once.
_TALLY = f"transform(array({_WORDS}), w -> struct(size(w) AS words, size(array_distinct(w)) AS kinds))[0]"


def flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and failure flags A to D of every row."""
    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "coalesce(cast(source AS string), '') AS part", "coalesce(cast(text AS string), '') AS body")
    rows = rows.selectExpr("doc_id", "part", "unhex(sha2(body, 256)) AS digest", f"{_TALLY} AS tally", "100L * length(regexp_replace(body, '[^A-Z]+', '')) > 2L * length(body) AS C", "body rlike '[#$%&*|]' AS D")
    return rows.selectExpr("doc_id", "part", "digest", "tally.words < 200 AS A", "100L * tally.kinds < 50L * tally.words AS B", "C", "D")


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``flags`` with E and the label of every row, as a table of the shared folder."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(flags(docs))
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    return rows.selectExpr("doc_id", "part", "A", "B", "C", "D", "first IS NULL AND doc_id IS NOT NULL AS E", "coalesce(good, false) AS good", "coalesce(toxic, false) AS toxic")


def survivors(rows: DataFrame) -> DataFrame:
    """part, subset (bit k: filter k of ABCDE) and counts of rows that fail none of the subset's filters."""
    tally = rows.groupBy("part", *FILTERS).agg(F.count("*").alias("docs"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    cube = tally.cube("part", *FILTERS).agg(F.grouping("part").alias("all_parts"), *(F.grouping(f).alias(f"all_{f}") for f in FILTERS), *(F.sum(c).alias(c) for c in COUNTS))
    subset = " + ".join(f"(1 - all_{f}) * {1 << k}" for k, f in enumerate(FILTERS))
    # A column that is not selected is null, and only selected flags can say that a row fails.
    clean = " AND ".join(f"NOT coalesce({f}, false)" for f in FILTERS)
    out = cube.where("all_parts = 0").selectExpr("part", f"cast({subset} AS int) AS subset", *(f"CASE WHEN {clean} THEN {c} ELSE 0L END AS {c}" for c in COUNTS))
    return out.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in COUNTS))


def _steps(spark: SparkSession) -> DataFrame:
    """The 600 steps of the 120 orders: the filter's bit, the subset before and the subset after."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            rows.append(("".join(order), step, bit, before, before | bit))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int, after int")


def audit(rows: DataFrame) -> DataFrame:
    """One row per part, order and step from rows of ``flagged``."""
    spark = rows.sparkSession
    alive = Scratch(spark).table(survivors(rows))
    full = (1 << len(FILTERS)) - 1

    def of(subset: str, prefix: str) -> DataFrame:
        return alive.selectExpr("part", f"subset AS {subset}", *(f"{c} AS {prefix}_{c}" for c in COUNTS))

    names = spark.createDataFrame([(1 << k, full - (1 << k)) for k in range(len(FILTERS))], "bit int, others int")
    own = (
        of("bit", "one").join(F.broadcast(names), "bit")
        .join(of("others", "rest"), ["part", "others"])
        .join(alive.where("subset = 0").select("part", F.col("docs").alias("all_docs")), "part")
        .join(alive.where(f"subset = {full}").select("part", F.col("docs").alias("last_docs")), "part")
        .selectExpr("part", "bit", "all_docs - one_docs AS fails", "rest_docs - last_docs AS unique_fails")
    )
    pairs = of("before", "had").join(F.broadcast(_steps(spark)), "before").join(of("after", "has"), ["part", "after"])
    taken = pairs.selectExpr("part", "filter_order", "step", "bit", "has_docs AS kept", "had_docs - has_docs AS removed", "had_good - has_good AS good_lost", "had_toxic - has_toxic AS toxic_lost")
    shares = taken.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return taken.join(own, ["part", "bit"]).join(shares, ["part", "bit"]).selectExpr("part", "filter_order", "step", "kept", "removed", "fails - removed AS redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors, removals and overlaps of five filters in every order, for each source."""
    return audit(flagged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


#: Orders, steps and flags are enumerated row by row here, without grouping sets.
ORACLE = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), m AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
    SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           [len(w) < 200,
            100 * len(list_distinct(w)) < 50 * len(w),
            100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body),
            regexp_matches(body, '[#$%&*|]'),
            coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY body), false)] AS fails
    FROM d LEFT JOIN m ON m.doc_id = d.doc_id
), letters AS (
    SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) AS t(letter, nr)
), orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
           [a.nr, b.nr, c.nr, d.nr, e.nr] AS nrs
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.nr NOT IN (b.nr, c.nr, d.nr, e.nr) AND b.nr NOT IN (c.nr, d.nr, e.nr) AND c.nr NOT IN (d.nr, e.nr) AND d.nr <> e.nr
), kinds AS (
    SELECT part, fails, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), steps AS (
    SELECT filter_order, step, nrs[step] AS nr, nrs[1:step - 1] AS before FROM orders, generate_series(1, 5) AS s(step)
), seen AS (
    SELECT part, filter_order, step, nr, docs, good, toxic, fails[nr] AS fails_it,
           len(list_filter(before, lambda b: fails[b])) = 0 AS arrives,
           len(list_filter(fails, lambda x: x)) AS failed
    FROM kinds, steps
), counted AS (
    SELECT part, filter_order, step, nr,
           sum(CASE WHEN arrives AND NOT fails_it THEN docs ELSE 0 END) AS kept,
           sum(CASE WHEN arrives AND fails_it THEN docs ELSE 0 END) AS removed,
           sum(CASE WHEN NOT arrives AND fails_it THEN docs ELSE 0 END) AS redundant,
           sum(CASE WHEN fails_it AND failed = 1 THEN docs ELSE 0 END) AS unique_fails,
           sum(CASE WHEN arrives AND fails_it THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN arrives AND fails_it THEN toxic ELSE 0 END) AS toxic_lost
    FROM seen GROUP BY part, filter_order, step, nr
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, nr) AS BIGINT) AS shapley
FROM counted
"""
