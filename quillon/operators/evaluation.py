"""Retrieval metrics and evaluation reports as aggregates over rankings and judgements."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_rankings(rankings: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10), truncate_at: int | None = None) -> DataFrame:
    """Per judged query: hit@k, mrr@max(k) and ndcg@k.

    rankings (query_id, id, rank), qrels (query_id, id, grade >= 0). A ranked id without judgement
    has grade 0. mrr takes the first relevant rank of the whole ranking unless ``truncate_at`` is
    set. ndcg has gain 2^grade - 1, discount log2(rank + 1) and the ideal of all judged grades.
    """
    judged = rankings.join(qrels, ["query_id", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    return score_graded(judged, qrels.groupBy("query_id", "grade").agg(F.count("*").alias("n")), cutoffs, truncate_at)


def score_graded(judged: DataFrame, grades: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10), truncate_at: int | None = None) -> DataFrame:
    """``score_rankings`` of ranked ids that have their grades already, for judgements that a rule gives.

    judged (query_id, rank, grade), grades (query_id, grade, n): how many judgements of a query have a grade, a row or more
    each; every query to be scored is there. The pairs that are judged need not be made.
    """
    if not cutoffs or min(cutoffs) < 1:
        raise ValueError("cutoffs must be 1 or more")
    if truncate_at:
        judged = judged.filter(F.col("rank") <= truncate_at)
    last = max(cutoffs)
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1.0
    # an ideal ranking has the best grades first: of each grade as many ranks as it has judgements, up to ``last``
    sums = grades.groupBy("query_id", "grade").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ideal = sums.filter("n > 0").withColumn("before", before).filter(F.col("before") < last)
    ideal = ideal.select("query_id", "grade", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.lit(last)))).alias("rank"))
    dcg = lambda k: F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    ideal = ideal.groupBy("query_id").agg(*[dcg(k).alias(f"ideal@{k}") for k in cutoffs])
    first = F.min(F.when(F.col("grade") > 0, F.col("rank")))
    hits = [F.max(((F.col("rank") <= k) & (F.col("grade") > 0)).cast("int")).alias(f"hit@{k}") for k in cutoffs]
    found = judged.groupBy("query_id").agg(*hits, first.alias("first"), *[dcg(k).alias(f"dcg@{k}") for k in cutoffs])
    both = ideal.join(found, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(
        "query_id",
        *[zero(F.col(f"hit@{k}").cast("double")).alias(f"hit_{k}") for k in cutoffs],
        zero(1.0 / F.col("first")).alias(f"mrr_{last}"),
        *[F.when(F.col(f"ideal@{k}") > 0, zero(F.col(f"dcg@{k}")) / F.col(f"ideal@{k}")).otherwise(0.0).alias(f"ndcg_{k}") for k in cutoffs],
    )


def macro(scores: DataFrame, bucket: str, metrics: list[str]) -> DataFrame:
    """Mean of each metric per bucket and over all queries (bucket null)."""
    return scores.rollup(bucket).agg(F.count("*").alias("queries"), *[F.avg(m).alias(m) for m in metrics])


def nearest_rank(c: str, q: float) -> Column:
    """Nearest-rank percentile: sorted[ceil(q * n) - 1]."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {c})")


def rate(hits: Column, of: Column, empty: float | None = 0.0) -> Column:
    """hits / of, or ``empty`` where there is nothing to count."""
    return F.when(of == 0, F.lit(empty)).otherwise(hits / of)


def disagreement(scores: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """Per query the best method (the first of equals) and the spread; widest first."""
    values = F.array(*[F.col(m) for m in methods])
    names = F.array(*[F.lit(m) for m in methods])
    best = F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))
    return scores.select("query_id", best.alias("best"), (F.array_max(values) - F.array_min(values)).alias("spread"))


def paired_arms(observations: DataFrame, arms: tuple[str, str], values: list[str]) -> DataFrame:
    """Two-level means: trials within a task, then tasks; a row with both arms, deltas and cost ratio.

    Raises if a task lacks a trial in one arm.
    """
    a, b = (observations.filter(F.col("arm") == x).select("task_id", "trial", F.lit(1).alias(f"in_{i}")) for i, x in enumerate(arms))
    unpaired = a.join(b, ["task_id", "trial"], "full").filter("in_0 IS NULL OR in_1 IS NULL")
    if unpaired.limit(1).count():
        raise ValueError("every task needs the same trials in both arms")
    tasks = observations.groupBy("arm", "task_id").agg(*[F.avg(F.col(v).cast("double")).alias(v) for v in values])
    means = tasks.groupBy("arm").agg(F.count("*").alias("tasks"), *[F.avg(v).alias(v) for v in values])
    return means


def paired_deltas(observations: DataFrame, arms: tuple[str, str], values: list[str]) -> DataFrame:
    """Per task, second arm less first arm of the means of its trials."""
    mean = lambda arm, v: F.avg(F.when(F.col("arm") == arm, F.col(v)).cast("double"))
    return observations.groupBy("task_id").agg(*[(mean(arms[1], v) - mean(arms[0], v)).alias(v) for v in values])


def paired_summary(observations: DataFrame, arms: tuple[str, str], delta: str, cost: str) -> DataFrame:
    """One row: mean delta of a value over tasks, both arms' total cost, and their ratio (null where the first is 0)."""
    a, b = (F.sum(F.when(F.col("arm") == x, F.col(cost))) for x in arms)
    mean = paired_deltas(observations, arms, [delta]).agg(F.avg(delta).alias("mean_delta"), F.count(delta).alias("tasks"))
    totals = observations.agg(F.coalesce(a, F.lit(0.0)).alias("cost_first"), F.coalesce(b, F.lit(0.0)).alias("cost_second"))
    return mean.join(F.broadcast(totals), how="cross").withColumn("cost_ratio", F.round(F.when(F.col("cost_first") > 0, F.col("cost_second") / F.col("cost_first")), 6))


def bootstrap_interval(deltas: list[float], resamples: int = 5000, seed: int = 20261011) -> tuple[float, float]:
    """95 % interval of the mean of per-task deltas, a small driver-side list, by resampling."""
    if not deltas:
        raise ValueError("no deltas")
    rng = random.Random(seed)
    means = sorted(sum(rng.choice(deltas) for _ in deltas) / len(deltas) for _ in range(resamples))
    return means[int(0.025 * (resamples - 1))], means[int(0.975 * (resamples - 1))]


def bootstrap_plan(deltas: DataFrame, value: str, resamples: int = 5000, seed: int = 20261011) -> DataFrame:
    """(low, high): the 95 % interval of the mean of a column, by resampling as a plan.

    Each task is drawn Poisson(1) times in each resample, which is resampling for many tasks, so no
    resample is gathered anywhere: a row adds to all sums where it lies. The draws are hashes of task,
    resample and seed, and repeat. ``deltas``: task_id and the column.
    """
    # cumulative chances of 0, 1, 2, ... draws
    chances, total, term = [], 0.0, math.exp(-1)
    for k in range(12):
        total += term
        chances.append(total)
        term /= k + 1
    u = (F.pmod(F.xxhash64(F.col("task_id"), F.col("resample"), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52))
    draws = F.size(F.filter(F.array(*map(F.lit, chances)), lambda c: c <= u))
    drawn = deltas.select("task_id", F.col(value).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample")).withColumn("n", draws)
    means = drawn.groupBy("resample").agg((F.sum(F.col("v") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("mean"))
    low, high = (F.try_element_at(F.array_sort(F.collect_list("mean")), F.lit(int(q * (resamples - 1)) + 1)) for q in (0.025, 0.975))
    return means.agg(low.alias("low"), high.alias("high"))


def empty_result_rate(results: DataFrame) -> DataFrame:
    """Share of queries without a result; results (query_id, n_results)."""
    return results.agg(F.count("*").alias("queries"), F.avg((F.col("n_results") == 0).cast("double")).alias("empty_result_rate"))


def observed_tokens(declared: Column, *parts: Column) -> Column:
    """The larger of a declared total and the sum of its visible parts."""
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.greatest(declared, total)


def consensus(workers: DataFrame) -> DataFrame:
    """Per run: whether at least two workers succeeded and all of those share one signature."""
    ok = F.when(F.col("status") == "ok", F.col("signature"))
    return workers.groupBy("run_id").agg((F.countDistinct(ok) == 1).alias("same"), F.count(ok).alias("succeeded")).select("run_id", "succeeded", (F.col("same") & (F.col("succeeded") >= 2)).alias("consensus"))
