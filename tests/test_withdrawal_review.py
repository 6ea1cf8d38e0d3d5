"""Withdrawals along keys, reviews against plan and corpus, quotes over chunks, table functions, canonical JSON."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.text import json_in_one_form
from quillon.operators import catalog, chunking, retrieval, review, verify
from quillon.sources import writers


def ids(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_withdrawal_takes_all_that_depends_on_it(spark, tmp_path):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "documents": make([(1, "a"), (2, "b"), (None, "c")], "doc long, name string"),
        "versions": make([(1, "v1"), (1, "v2"), (2, "v3"), (None, "v4")], "doc long, version string"),
        "chunks": make([("v1", 10), ("v2", 11), ("v3", 12), (None, 13)], "of string, chunk long"),
        "vectors": make([(10, "m"), (11, "m"), (11, "n"), (12, "m"), (99, "m")], "chunk long, model string"),
        "quotes": make([(12, 1, "x"), (12, 2, "y"), (13, 2, "z")], "chunk long, doc long, q string"),
        "other": make([(1,)], "doc long"),
    }
    links = [("vectors", "chunks", {"chunk": "chunk"}), ("chunks", "versions", {"of": "version"}), ("versions", "documents", {"doc": "doc"}), ("quotes", "documents", {"doc": "doc"}), ("quotes", "chunks", {"chunk": "chunk"})]
    left, gone = catalog.withdrawn(tables, links, "documents", make([(1,), (1,), (None,), (7,)], "doc long"))
    assert {k: ids(v) for k, v in gone.items()} == {"documents": [(1, "a")], "versions": [(1, "v1"), (1, "v2")], "chunks": [("v1", 10), ("v2", 11)], "vectors": [(10, "m"), (11, "m"), (11, "n")], "quotes": [(12, 1, "x")]}
    assert {k: left[k].count() for k in left} == {"documents": 2, "versions": 2, "chunks": 2, "vectors": 2, "quotes": 2, "other": 1}
    assert left["quotes"].columns == tables["quotes"].columns
    with pytest.raises(ValueError, match="circle"):
        catalog.withdrawn(tables, [*links, ("versions", "vectors", {"doc": "chunk"})], "documents", make([(1,)], "doc long"))
    writers.publish(tables, str(tmp_path), 1)
    writers.publish(left, str(tmp_path), 2)
    assert {k: v.count() for k, v in writers.published(spark, str(tmp_path)).items()} == {k: left[k].count() for k in left}


def test_review_states(spark):
    plan = [("q", w, "h", 2) for w in "abcdefgi"] + [("q", "a", "h", 2), ("r", "a", "h", 1)]
    good = lambda w, **k: {"query_id": "q", "work_id": w, "content_sha256": "h", "suggested_grade": 2, "reviewed_grade": 3, "reviewed": True, "note": None} | k
    reviews = [good("a"), good("c"), good("c"), good("d", content_sha256="old"), good("e", suggested_grade=1), good("f", reviewed=None), good("g", reviewed_grade=4), good("z"), good("i"), good("a", query_id="r", suggested_grade=1, note="x" * 1001)]
    corpus = [(w, "h") for w in "abcdefgz"]
    p = spark.createDataFrame(plan, "query_id string, work_id string, content_sha256 string, suggested_grade int")
    r = spark.createDataFrame(reviews, "query_id string, work_id string, content_sha256 string, suggested_grade int, reviewed_grade int, reviewed boolean, note string")
    c = spark.createDataFrame(corpus, "work_id string, content_sha256 string")
    report = review.reconciled(p, r, c)
    got = {(x.query_id, x.work_id): x.state for x in report.collect()}
    assert got == {("q", "a"): "current", ("q", "b"): "missing", ("q", "c"): "duplicate", ("q", "d"): "stale", ("q", "e"): "changed", ("q", "f"): "open", ("q", "g"): "invalid", ("q", "z"): "surplus", ("q", "i"): "gone", ("r", "a"): "invalid"}
    assert set(got.values()) == set(review.STATES)
    assert {x.query_id: x.complete for x in review.completeness(report).collect()} == {"q": False, "r": False}
    assert review.accepted(report).count() == 0
    whole = review.reconciled(p.filter("work_id = 'a' AND query_id = 'q'"), r.filter("work_id = 'a' AND query_id = 'q'"), c)
    assert ids(review.accepted(whole)) == [("q", "a", 3)] and review.completeness(whole).first().complete


def brute_places(chunks, quotes):
    out = []
    for doc in {d for d, _, _ in chunks}:
        words = [(w, o) for d, o, t in sorted((c for c in chunks if c[0] == doc), key=lambda c: c[1]) for w in (t or "").split()]
        for q, quote in quotes:
            ws = (quote or "").split()
            for k in range(len(words) - len(ws) + 1):
                if ws and [w for w, _ in words[k : k + len(ws)]] == ws:
                    out.append((doc, q, words[k][1], words[k + len(ws) - 1][1]))
    return sorted(out)


def test_quotes_over_chunks_equal_a_search_of_the_whole(spark):
    rng = random.Random(2)
    chunks = [(d, o, rng.choice([None, "", " "]) if rng.random() < 0.15 else "  ".join(rng.choice(["a", "b", "cc"]) for _ in range(rng.randrange(1, 6)))) for d in range(12) for o in range(12)]
    quotes = [(k, " ".join(rng.choice(["a", "b", "cc"]) for _ in range(rng.randrange(1, 9)))) for k in range(40)] + [(90, None), (91, ""), (92, "none of these")]
    c = spark.createDataFrame(chunks, "doc_id long, ordinal int, text string")
    q = spark.createDataFrame(quotes, "quote_id long, quote string")
    want = brute_places(chunks, quotes)
    assert ids(verify.containing_across(c, q)) == sorted(want, key=str) and any(a != b for *_, a, b in want)
    assert ids(verify.containing_across(c, q.filter("quote_id = 91"))) == [] and verify.containing_across(c.filter("false"), q).count() == 0
    one = q.filter("length(quote) < 3")
    assert ids(verify.containing_across(c, one)) == sorted((p for p in want if len(dict(quotes)[p[1]]) < 3), key=str)


def test_blocks_of_queries_give_all_pairs(spark):
    vectors = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "id long, vector array<double>")
    queries = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(23)], "query_id long, query_vector array<double>")
    assert ids(retrieval.cosine_scores(vectors, queries, 4).select("query_id", "id", F.round("score", 9))) == ids(retrieval.cosine_scores(vectors, queries).select("query_id", "id", F.round("score", 9)))
    assert verify.query_pairs(vectors.select("id"), queries, 5).count() == 115


def test_a_search_keeps_its_status(spark):
    text = [(k, "arxiv", "s", "", f"graph number {k}", None, "approved", "h", "h", [1.0, float(k)]) for k in range(6)]
    chunks = spark.createDataFrame(text, "chunk_id long, source_type string, source_id string, title string, text string, retrieval_text string, status string, current_sha256 string, content_sha256 string, vector array<double>")
    assert retrieval.evidence_search(chunks, "graph", max_chunks=5) == ("corpus_limit_exceeded", None)
    status, best = retrieval.evidence_search(chunks, "graph", max_chunks=None)
    assert status == "ok" and best.count() == 5
    assert retrieval.evidence_search(chunks, "nothing")[0] == "no_results"


def test_table_functions_equal_the_operator(spark):
    rows = [(1, 0, "e0", 1, "paragraph", ["s"], "one " * 900, None, 1), (1, 1, "e1", 1, "table", None, "Table 1\nx", [["a", "b"], ["1", "2"]], 1), (1, 2, "e2", 2, "paragraph", None, None, None, 1), (2, 0, "e0", 1, "paragraph", ["t"], "fine", None, 1), (2, 1, "e1", None, "paragraph", ["t"], "no page", None, 1), (2, 2, "e2", 3, "paragraph", ["t"], "after", None, 1), (3, 0, "x", 1, "table", None, "t", [["h" * 2000], ["1"]], 1)]
    elements = spark.createDataFrame(rows, chunking.ELEMENTS)
    want = ids(chunking.chunk_element_table(elements))
    assert [(r[0], r[-1] is None) for r in want].count((1, True)) == 3 and sum(r[0] == 2 for r in want) == 1 and [r for r in want if r[0] == 2][0][1] is None
    chunking.register_table_functions(spark)
    elements.createOrReplaceTempView("elements_to_cut")
    got = ids(spark.sql("SELECT * FROM element_chunks(TABLE(elements_to_cut) PARTITION BY doc_id ORDER BY order_index)"))
    assert [r for r in got if r[0] == 1] == [r for r in want if r[0] == 1]
    # Rows come as they are cut: a document that is refused keeps those before, and ends with the error.
    assert [r[-1] is None for r in got if r[0] == 2] == [True, False] and [r for r in got if r[0] == 3] == [r for r in want if r[0] == 3]
    spark.createDataFrame([(7, "first\n\nsecond part\n \nthird"), (8, None)], "doc_id long, text string").createOrReplaceTempView("texts_to_cut")
    lateral = spark.sql("SELECT c.doc_id, c.ordinal, c.text FROM element_chunks(TABLE(SELECT e.* FROM texts_to_cut t, LATERAL text_elements(t.doc_id, t.text) e) PARTITION BY doc_id ORDER BY order_index) c")
    assert ids(lateral) == [(7, 0, "first"), (7, 1, "second part"), (7, 2, "third")]


def test_json_of_any_shape_in_one_form(spark):
    values = [{"b": [1, {"z": None, "é": True}], "a": {"y": "q\"\\\n", "x": {}}}, [3, []], "s", 12, 1.5, None]
    rows = [(k, json.dumps(v), json.dumps(v, indent=2)) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k int, a string, b string").select("k", json_in_one_form(F.col("a")).alias("a"), json_in_one_form(F.col("b")).alias("b"))
    for r in df.collect():
        assert r.a == r.b == json.dumps(values[r.k], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    bad = spark.createDataFrame([("{",), ('{"a":1,"a":2}',), (None,), ("",)], "a string").select(json_in_one_form(F.col("a")).alias("a"))
    assert [r.a for r in bad.collect()] == [None] * 4
