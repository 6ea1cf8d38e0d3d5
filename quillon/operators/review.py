"""Reviews of relevance grades against the plan they were asked for and the corpus they were made on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grades, and the longest note.
GRADES, NOTE = (0, 3), 1000
#: What a pair is, in the order in which it is told.
STATES = ("duplicate", "surplus", "missing", "gone", "stale", "changed", "open", "invalid", "current")


def reconciled(plan: DataFrame, reviews: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row per pair of plan and reviews: query_id, work_id, state, suggested_grade, reviewed_grade.

    ``plan``: query_id, work_id, content_sha256, suggested_grade; ``reviews``: these and reviewed_grade, reviewed,
    note; ``corpus``: work_id, content_sha256 of the works as they are now. States, the first that holds:
    duplicate (reviewed more than once), surplus (not planned), missing (not reviewed), gone (the work is no longer
    there), stale (the work is not the one that was planned or reviewed), changed (another grade was suggested),
    open (no grade yet), invalid (a grade or note out of bounds), current. Repeated rows of the plan count once; a
    null in a key matches nothing. One shuffle by pair, one join by work.
    """
    pair = ["query_id", "work_id"]
    asked = plan.dropDuplicates(pair).select(*pair, F.col("content_sha256").alias("p_hash"), F.col("suggested_grade").alias("p_grade"), F.lit(True).alias("planned"))
    given = reviews.groupBy(*pair).agg(F.count("*").alias("times"), *(F.first(c).alias(f"r_{c}") for c in ("content_sha256", "suggested_grade", "reviewed_grade", "reviewed", "note")))
    now = corpus.dropDuplicates(["work_id"]).select("work_id", F.col("content_sha256").alias("c_hash"), F.lit(True).alias("there"))
    both = asked.join(given, pair, "full").join(now, "work_id", "left")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    state = (
        F.when(F.col("times") > 1, "duplicate")
        .when(F.col("planned").isNull(), "surplus")
        .when(F.col("times").isNull(), "missing")
        .when(F.col("there").isNull(), "gone")
        .when(~same("c_hash", "p_hash") | ~same("c_hash", "r_content_sha256"), "stale")
        .when(~same("p_grade", "r_suggested_grade"), "changed")
        .when(~F.coalesce("r_reviewed", F.lit(False)) | F.col("r_reviewed_grade").isNull(), "open")
        .when(~F.col("r_reviewed_grade").between(*GRADES) | (F.char_length(F.coalesce("r_note", F.lit(""))) > NOTE), "invalid")
        .otherwise("current")
    )
    return both.select(*pair, state.alias("state"), F.coalesce("p_grade", "r_suggested_grade").alias("suggested_grade"), F.col("r_reviewed_grade").alias("reviewed_grade"))


def completeness(report: DataFrame) -> DataFrame:
    """query_id, pairs, current, and ``complete``: all pairs of the query are current."""
    counts = report.groupBy("query_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("state") == "current").alias("current"))
    return counts.withColumn("complete", F.col("pairs") == F.col("current"))


def accepted(report: DataFrame) -> DataFrame:
    """The reviewed grades if every pair is current, else no rows: a review is taken as a whole."""
    open_pairs = report.agg(F.count_if(F.col("state") != "current").alias("n"))
    return report.crossJoin(F.broadcast(open_pairs)).filter("n = 0").select("query_id", "work_id", F.col("reviewed_grade").alias("grade"))
