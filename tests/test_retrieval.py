import math

import pytest
from pyspark.sql import functions as F

from quillon.functions.text import tokens
from quillon.operators import evaluation, retrieval


def docs(spark, rows):
    return spark.createDataFrame(rows, "id string, t string").select("id", tokens(F.col("t")).alias("tokens"))


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, t string").select("query_id", tokens(F.col("t")).alias("tokens"))


def python_bm25(corpus: dict, query: list[str]):
    n = len(corpus)
    avg = sum(map(len, corpus.values())) / n
    out = {}
    for d, words in corpus.items():
        s = 0.0
        for t in set(query):
            df = sum(t in w for w in corpus.values())
            tf = words.count(t)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg)) * min(2, query.count(t))
        if s > 0:
            out[d] = s
    return out


def test_bm25_equals_formula_and_ties_by_id(spark):
    texts = {"W2": "graph retrieval graph", "W1": "graph retrieval graph", "W3": "dense vectors", "W4": ""}
    got = {r["id"]: r for r in retrieval.ranked(retrieval.bm25(docs(spark, list(texts.items())), asked(spark, "graph graph graph dense")), None).collect()}
    want = python_bm25({k: v.split() for k, v in texts.items()}, ["graph"] * 3 + ["dense"])
    want = {k.replace("vectors", "vector"): v for k, v in want.items()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k]["score"] == pytest.approx(want[k], abs=1e-8)
    assert got["W1"]["score"] == got["W2"]["score"] and got["W1"]["rank"] < got["W2"]["rank"]


def test_bm25_empty_inputs(spark):
    assert retrieval.bm25(docs(spark, []), asked(spark, "x")).count() == 0
    assert retrieval.bm25(docs(spark, [("a", "x")]), asked(spark, "!!")).count() == 0
    assert retrieval.bm25(docs(spark, [("a", None)]), asked(spark, "x")).count() == 0


def test_scoped_statistics_differ(spark):
    d = docs(spark, [("a", "x y"), ("b", "x z"), ("c", "x")]).withColumn("lang", F.when(F.col("id") == "c", "de").otherwise("en"))
    got = {r["id"]: r["score"] for r in retrieval.bm25(d, asked(spark, "x"), ("lang",)).collect()}
    assert got["c"] == pytest.approx(math.log(1 + 0.5 / 1.5), abs=1e-8) and got["a"] == got["b"]


def test_cosine_and_guards(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])], "id int, vector array<double>")
    q = spark.createDataFrame([(0, [2.0, 0.0])], "query_id int, query_vector array<double>")
    assert {r["id"]: r["score"] for r in retrieval.cosine_scores(v, q).collect()} == {1: 1.0, 2: 0.0, 3: -1.0}
    bad = spark.createDataFrame([([],), ([1.0],), ([1.0, float("nan")],), ([1.0, 2.0],)], "v array<double>")
    assert [r[0] for r in bad.select(retrieval.vector_problem(F.col("v"), 2)).collect()] == ["empty", "dimension", "not_finite", None]


def test_rrf(spark):
    a = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(0, "y", 1)], "query_id int, id string, rank int")
    got = {r["id"]: r["score"] for r in retrieval.fuse([a, b]).collect()}
    assert got == {"x": pytest.approx(1 / 61), "y": pytest.approx(1 / 62 + 1 / 61)}
    with pytest.raises(ValueError):
        retrieval.fuse([a], 0)


def test_budget_is_used_in_rank_order(spark):
    r = spark.createDataFrame([(0, 1, 10, [9]), (0, 2, 20, [9, 11, 21]), (0, 3, 11, [12]), (1, 1, 5, [4, 6, 7])], "query_id int, rank int, id int, neighbours array<int>")
    got = {x["id"]: x["taken"] for x in retrieval.within_budget(r).collect()}
    assert got == {10: [9], 20: [11], 11: [], 5: [4, 6]}


def test_row_numbers_in_bins_equal_one_window(spark):
    df = spark.range(5000).selectExpr("id % 3 AS q", "id", "(id * 7919) % 1000 / 10.0 AS score")
    for down in (True, False):
        whole = retrieval.row_numbers(df, ("q",), "score", "id", "rank", descending=down)
        binned = retrieval.row_numbers(df, ("q",), "score", "id", "rank", descending=down, few=10, bins=16)
        assert whole.columns == binned.columns and whole.exceptAll(binned).count() == 0 and binned.count() == 5000
    assert retrieval.ranked_whole(df.limit(0).withColumnRenamed("q", "query_id")).count() == 0


def test_bounded_join_cuts_at_whole_characters(spark):
    from quillon.operators.chunking import context_within

    cases = [["é" * 10, "abc"], ["a" * 30], ["ab", "字" * 9, "z"], [], ["", "x"], ["x" * 23, "y"], ["x" * 22, "é"]]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, p array<string>")
    got = [r["t"] for r in df.select("k", retrieval.bounded_join(F.col("p"), 23).alias("t")).orderBy("k").collect()]
    assert got[:4] == [context_within(c, 23) for c in cases[:4]] == ["é" * 10 + "\nab", "a" * 23, "ab\n" + "字" * 6, ""]
    assert all(len(t.encode()) <= 23 for t in got) and got[5] == "x" * 23 and got[6] == "x" * 22


def test_evidence_items_have_neighbours_and_context(spark):
    rows = [(f"c{k}", k, f"doc:{k // 4}", f"doc:{'ab'[k % 2]}", f"text {k}", None, f"quote {k}" if k == 2 else None) for k in range(8)] + [("free", 9, None, "doc:a", "alone", "shown", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, ordinal int, parent string, section string, text string, retrieval_text string, evidence_text string")
    best = spark.createDataFrame([("c2", 2.0, 1), ("c3", 1.5, 2), ("free", 1.0, 3)], "id string, score double, rank int")
    got = {r["chunk_id"]: r for r in retrieval.expanded(best, chunks).collect()}
    assert [x["chunk_id"] for x in got["c2"]["expanded_evidence"]] == ["c1", "c3"] and got["c2"]["excerpt"] == "quote 2"
    assert got["c2"]["context"] == "text 1\ntext 2\ntext 3" and got["c3"]["context"] == "text 3" and got["free"]["context"] == "shown"
    more = {r["chunk_id"]: [x["chunk_id"] for x in r["expanded_evidence"]] for r in retrieval.expanded(best, chunks, budget=9).collect()}
    assert more == {"c2": ["c1", "c3", "c0", "c4"], "c3": ["c2", "c5"], "free": []}


def test_evidence_search_outcomes(spark):
    rows = [("c1", "arxiv", "1", "T", "graph retrieval", None, "approved", "h", "h", [1.0, 0.0]), ("c2", "arxiv", "1", "T", "old graph", None, "approved", "h2", "h", [1.0, 0.0]), ("c3", "openalex", "2", "T", "graph", None, "approved", "h", "h", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_type string, source_id string, title string, text string, retrieval_text string, status string, current_sha256 string, content_sha256 string, vector array<double>")
    status, best = retrieval.evidence_search(chunks, " graph ")
    assert status == "ok" and {r["id"] for r in best.collect()} == {"c1", "c3"}
    assert retrieval.evidence_search(chunks, "graph", max_chunks=1)[0] == "corpus_limit_exceeded"
    assert retrieval.evidence_search(chunks, "graph", source_type="none")[0] == "no_results"
    assert retrieval.evidence_search(chunks, "graph", method="dense", query_vector=[1.0, 0.0])[0] == "embeddings_missing"
    status, best = retrieval.evidence_search(chunks, "graph", source_type="arxiv", method="hybrid", query_vector=[1.0, 0.0])
    assert status == "ok" and best.first()["score"] == pytest.approx(2 / 61, abs=1e-6)
    for bad in ({"query": ""}, {"query": "x", "limit": 9}, {"query": "x", "source_id": "1"}, {"query": "x", "method": "dense"}):
        with pytest.raises(ValueError):
            retrieval.evidence_search(chunks, **bad)


def test_metrics_golden(spark):
    r = spark.createDataFrame([("q", "W2", 1), ("q", "W1", 2), ("q", "W3", 3)], "query_id string, id string, rank int")
    g = spark.createDataFrame([("q", "W1", 3), ("q", "W2", 1), ("q", "W3", 0), ("none", "W1", 0)], "query_id string, id string, grade int")
    rows = {x["query_id"]: x for x in evaluation.score_rankings(r, g, (1, 3)).collect()}
    assert rows["q"]["hit_1"] == 1 and rows["q"]["mrr_3"] == 1
    assert rows["q"]["ndcg_3"] == pytest.approx((1 + 7 / math.log2(3)) / (7 + 1 / math.log2(3)))
    assert rows["none"]["ndcg_3"] == 0 and rows["none"]["mrr_3"] == 0
    with pytest.raises(ValueError):
        evaluation.score_rankings(r, g, (0,))


def test_paired_arms(spark):
    good = spark.createDataFrame([("a", 1, "x", 1.0), ("a", 1, "y", 3.0), ("b", 1, "x", 2.0), ("b", 1, "y", 2.0)], "task_id string, trial int, arm string, v double")
    got = {r["arm"]: r["v"] for r in evaluation.paired_arms(good, ("x", "y"), ["v"]).collect()}
    assert got == {"x": 1.5, "y": 2.5}
    with pytest.raises(ValueError):
        evaluation.paired_arms(good.filter("NOT (task_id = 'b' AND arm = 'y')"), ("x", "y"), ["v"])
    deltas = {r["task_id"]: r["v"] for r in evaluation.paired_deltas(good, ("x", "y"), ["v"]).collect()}
    summary = evaluation.paired_summary(good, ("x", "y"), "v", "v").first()
    assert summary["tasks"] == len(deltas) and abs(summary["mean_delta"] - sum(deltas.values()) / len(deltas)) < 1e-9
    tasks = spark.range(400).selectExpr("id AS task_id", "CAST(id % 5 AS double) AS v")
    low, high = evaluation.bootstrap_plan(tasks, "v", 2000).first()
    want = evaluation.bootstrap_interval([float(k % 5) for k in range(400)], 2000)
    assert abs(low - want[0]) < 0.03 and abs(high - want[1]) < 0.03
    assert evaluation.bootstrap_plan(tasks.limit(0), "v").first() == (None, None)
    assert evaluation.bootstrap_interval([0.5, 0.5]) == (0.5, 0.5)


def test_consensus(spark):
    w = spark.createDataFrame([(1, "ok", "s"), (1, "ok", "s"), (2, "ok", "s"), (2, "ok", "t"), (3, "ok", "s"), (3, "bad", "s")], "run_id int, status string, signature string")
    assert {r["run_id"]: r["consensus"] for r in evaluation.consensus(w).collect()} == {1: True, 2: False, 3: False}
