import pytest
from pyspark.sql import functions as F

from quillon.operators import catalog


def test_upsert_keeps_first_and_moves_last(spark):
    old = spark.createDataFrame([("a", "v1", 1, 5), ("b", "v1", 2, 2)], "k string, p string, first_seen_at int, last_seen_at int")
    new = spark.createDataFrame([("a", "v2", 7), ("a", "v3", 9), ("c", "v1", 9)], "k string, p string, seen_at int")
    got = {tuple(r) for r in catalog.upsert_current(old, new, "k", ["p"]).collect()}
    assert got == {("a", "v3", 1, 9), ("b", "v1", 2, 2), ("c", "v1", 9, 9)}


def test_import_is_idempotent(spark):
    rows = spark.createDataFrame([("a", "h1"), ("b", "h2")], "k string, h string")
    assert catalog.append_if_absent(rows, rows, ["k", "h"]).count() == 0
    assert catalog.import_summary(rows, rows, "k", "h").first().asDict() == {"received": 2, "new_works": 0, "new_versions": 0, "unchanged": 2}
    changed = spark.createDataFrame([("a", "h9"), ("z", "h1")], "k string, h string")
    assert catalog.import_summary(rows, changed, "k", "h").first().asDict() == {"received": 2, "new_works": 1, "new_versions": 2, "unchanged": 0}


def test_two_candidates_or_links_block_the_crosswalk(spark):
    left = spark.createDataFrame([("W1", "d"), ("W2", "d"), ("W3", "e"), ("W4", "f"), ("W5", None)], "left_id string, norm string")
    right = spark.createDataFrame([("a", "d", 0), ("b", "e", 1), ("c", "e", 2), ("x", "f", 3), ("n", None, 4)], "right_id string, norm string, position int")
    links = spark.createDataFrame([("W4", "q")], "left_id string, right_id string")
    assert [tuple(r) for r in catalog.unique_crosswalk(left, right, links).collect()] == [("W3", "b", "e")]


def test_frozen_match_needs_equal_sets(spark):
    items = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (3, "a", "x"), (3, "b", "z"), (4, "a", "x"), (4, "b", "y"), (4, "c", "w")], "snapshot_id int, key string, sha string")
    wanted = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, sha string")
    assert [r[0] for r in catalog.frozen_match(items, wanted).collect()] == [1]


def test_unique_remap_and_nulls(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "old_id int, k string")
    new = spark.createDataFrame([(11, "a"), (12, "b"), (13, "b"), (14, None)], "new_id int, k string")
    assert {tuple(r) for r in catalog.unique_remap(old, new, ["k"]).collect()} == {(1, 11, True), (2, 2, False), (3, 3, False)}


def test_delete_cascades_and_leaves_a_tombstone(spark):
    t = spark.createDataFrame([(1,), (2,)], "k int")
    left, stones = catalog.delete_with_tombstone({"documents": t, "chunks": t}, spark.createDataFrame([(2,), (3,)], "k int"), ["k"], " bad   licence ")
    assert all([r[0] for r in x.collect()] == [1] for x in left.values())
    assert [tuple(r) for r in stones.collect()] == [(2, "bad licence")]
    with pytest.raises(ValueError):
        catalog.delete_with_tombstone({"d": t}, t, ["k"], "x")


def test_embedding_batch_is_all_or_nothing(spark):
    schema = "chunk_id string, content_sha256 string, vector array<double>"
    stored = spark.createDataFrame([("a", "h", [0.0, 0.0])], schema)
    active = spark.createDataFrame([("a", "h"), ("b", "h")], "chunk_id string, content_sha256 string")
    got = catalog.replace_embeddings(stored, spark.createDataFrame([("a", "h", [1.0, 1.0]), ("b", "h", [2.0, 2.0])], schema), active, 2)
    assert {r["chunk_id"]: r["vector"] for r in got.collect()} == {"a": [1.0, 1.0], "b": [2.0, 2.0]}
    for bad in ([("a", "old", [1.0, 1.0])], [("a", "h", [1.0])], [("a", "h", [1.0, 1.0])] * 2, [("a", "h", [1.0, float("inf")])]):
        with pytest.raises(ValueError):
            catalog.replace_embeddings(stored, spark.createDataFrame(bad, schema), active, 2)


def test_abstract_index(spark):
    rows = [({"Retrieval": [0], "works": [1], "well": [2]},), (None,), ({},), ({"t": [-1]},), ({"a": [0], "b": [0]},), ({"x" * 2001: [0]},), ({"a": [50_000]},), ({"a": [0], "b": [5]},)]
    df = spark.createDataFrame(rows, "i map<string,array<int>>").select(catalog.abstract_from_index(F.col("i")).alias("a")).select("a.*")
    got = [tuple(r) for r in df.collect()]
    assert got == [("available", "Retrieval works well"), ("missing", None), ("missing", None), ("invalid", None), ("invalid", None), ("oversized", None), ("invalid", None), ("available", "a b")]


def test_paging_compare_ledger(spark):
    works = spark.createDataFrame([(1, "Beta", 2000), (2, "alpha", 2000), (3, "gamma", None), (4, "100% x", 2010)], "k int, t string, y int")
    assert [r["k"] for r in catalog.title_page(works, None, "t", "y", "k", 10, 0).collect()] == [4, 2, 1, 3]
    assert [r["k"] for r in catalog.title_page(works, "0% ", "t", "y", "k", 10, 0).collect()] == [4]
    missing, rows = catalog.compare_ordered(works, [3, 9, 1], "k", ["t"])
    assert missing == [9] and [r["k"] for r in rows.collect()] == [3, 1]
    assert [r["k"] for r in catalog.year_range(works, "y", 2000, 2005).orderBy("k").collect()] == [1, 2]
    events = spark.createDataFrame([("r", "running", 1, 0), ("r", "failed", 3, 2), ("r", "completed", 5, 3), ("s", "running", 2, 1)], "run_id string, status string, at int, seq int")
    assert {tuple(r) for r in catalog.ledger_state(events).collect()} == {("r", 1, "failed", 3), ("s", 2, "running", 2)}


def test_works_and_citation_hop(spark):
    raw = [{"id": "https://openalex.org/W1", "display_name": "One", "referenced_works": ["https://openalex.org/W2"], "authorships": [{"author": {"id": "A1", "display_name": "Ann"}}, {"author": {"id": "A2"}}]}, {"id": "https://openalex.org/W3", "title": "Three", "referenced_works": ["https://openalex.org/W1"]}]
    from quillon.sources.readers import WORK

    works = catalog.work_view(spark.createDataFrame(raw, WORK))
    rows = {r["work_id"]: r for r in works.collect()}
    assert rows["W1"]["title"] == "One" and rows["W1"]["authors"] == ["Ann"] and rows["W1"]["status"] == "missing"
    assert {tuple(r) for r in catalog.citation_hop(works, "W1").collect()} == {("W2", "cites"), ("W3", "cited_by")}


def test_ingest_gate_lineage_and_reviews(spark):
    manifests = spark.createDataFrame([("arxiv", "1", None), ("arxiv", "2", None), ("arxiv", "3", "license")], "source_type string, source_id string, problem string")
    works = spark.createDataFrame([("arxiv", "1", "T")], "source_type string, source_id string, title string")
    accepted, refused = catalog.ingest_gate(manifests, works)
    assert [tuple(r) for r in accepted.collect()] == [("arxiv", "1", "T")]
    assert {(r["source_id"], r["problem"]) for r in refused.collect()} == {("2", "paper not in the catalogue"), ("3", "license")}
    row = {c: "x" for c in catalog.LINEAGE_FIELDS}
    schema = ", ".join(f"{c} string" for c in catalog.LINEAGE_FIELDS)
    two = spark.createDataFrame([tuple(row.values()), tuple({**row, "parser_version": "y"}.values()), tuple({**row, "parser_version": None}.values())], schema)
    assert catalog.content_key(two).select("content_sha256").distinct().count() == 3
    review = "source_type string, source_id string, license_id string, license_url string, license_evidence_url string, reviewer string, attribution string, reviewed_at int"
    stored = spark.createDataFrame([("arxiv", "1", "l", "u", "e", "r", "a", 1), ("arxiv", "2", "l", "u", "e", "r", "a", 1)], review)
    new = spark.createDataFrame([("arxiv", "1", "l", "u", "e", "r", "a", 9), ("arxiv", "2", "l", "u", "e", "other", "a", 9), ("arxiv", "3", "l", "u", "e", "r", "a", 9)], review)
    assert {r["source_id"]: r["reviewed_at"] for r in catalog.carry_reviews(new, stored).collect()} == {"1": 1, "2": 9, "3": 9}
