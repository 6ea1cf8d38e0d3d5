"""Faults that show on larger tables: what is shuffled, held in one task or rounded, on small tables made for each."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.operators import catalog, chunking, retrieval, ruled, verify
from quillon.plans import catalogue


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def nodes(plan, name):
    """All nodes of that name in a JVM plan."""
    children = plan.children()
    found = [n for k in range(children.size()) for n in nodes(children.apply(k), name)]
    return found + [plan] if plan.nodeName().startswith(name) else found


def kinds(plan):
    """Types of a JVM plan's columns."""
    out = plan.output()
    return [out.apply(k).dataType().simpleString() for k in range(out.size())]


def test_no_word_takes_its_chunk_into_the_join(spark):
    c = spark.createDataFrame([(1, 0, "a b c d"), (1, 1, "e a b"), (2, 0, "c d e"), (2, 1, "a  " + "long" * 30)], "doc_id long, ordinal int, text string")
    q = spark.createDataFrame([(1, "c d e a"), (2, "a b"), (3, "d e a " + "long" * 30), (4, "b e"), (5, "a b")], "quote_id long, quote string")
    found = verify.containing_across(c, q)
    join = nodes(found._jdf.queryExecution().optimizedPlan(), "Join")[0]
    assert not [t for k in (0, 1) for t in kinds(join.children().apply(k)) if t.startswith("array")]
    want = [(1, 1, 0, 1), (1, 2, 0, 0), (1, 2, 1, 1), (1, 5, 0, 0), (1, 5, 1, 1), (2, 1, 0, 1), (2, 3, 0, 1)]
    assert rows(found) == sorted(want, key=str) == rows(verify.containing_across(c, q, few=0))


def against_sql(spark, folder, name, **tables):
    """A query on tables of its own, and its SQL in DuckDB."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    mine = catalogue.QUERIES[name](spark, str(folder))
    theirs = con.execute(f"SELECT {', '.join(mine.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    return rows(mine), sorted(theirs, key=str)


def test_halves_are_rounded_as_in_the_sql(spark, tmp_path):
    s = spark.createDataFrame([(1, 2.5), (2, 3.5), (4, -0.5), (6, -7.5), (7, 9.4)], "s_suppkey long, s_acctbal double")
    c = spark.createDataFrame([(1, 2.0), (2, 3.0), (4, 4.5), (6, 0.0), (7, -8.5), (8, 8.6), (9, None)], "c_custkey long, c_acctbal double")
    mine, theirs = against_sql(spark, tmp_path, "crosswalk_unique_key", supplier=s, customer=c)
    assert mine == theirs and len(mine) == 5


def odd_vectors(spark):
    """Vectors with copies, a zero, nulls, other lengths and numbers that are none; queries likewise."""
    odd = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0]), (103, [1.0, 2.0]), (104, []), (105, [float("nan"), 1.0, 1.0]), (106, [float("inf"), 1.0, 1.0]), (107, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0])]
    plain = [(k, [float(k % 5), float(k % 3) - 1, 0.1 * k]) for k in range(20, 60)]
    kind = lambda i, v: f"{i} long, {v} array<double>"
    return spark.createDataFrame(odd + plain, kind("id", "vector")), spark.createDataFrame(odd + plain[:5] + [(900, [1.0] * 4)], kind("query_id", "query_vector"))


@pytest.mark.parametrize("k", [1, 3, 10, 60])
def test_best_cosines_in_bins_are_those_of_all_pairs(spark, k):
    v, q = odd_vectors(spark)
    want = rows(retrieval.ranked(retrieval.cosine_scores(v, q), k).select("query_id", "id", "score", "rank"))
    for size in ((8192, 2048), (7, 4)):
        assert str(rows(retrieval.cosine_top(v, q, k, *size))) == str(want)
    assert retrieval.cosine_top(v.filter("false"), q, k).count() == 0 == retrieval.cosine_top(v, q.filter("false"), k).count()


def test_vectors_and_grades_are_not_joined_with_every_query(spark, sf_dir):
    for name in ("cosine_batch", "ir_metrics_per_query"):
        crossed = nodes(catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan(), "Join")
        assert not [j for j in crossed if j.condition().isEmpty() and "embedding#" in j.toString() and j.right().maxRows().isEmpty()]


def test_a_task_holds_a_bounded_number_of_pairs(spark, monkeypatch):
    docs = spark.createDataFrame([(k, ["a", "b", f"t{k % 7}"]) for k in range(30)], "id long, tokens array<string>")
    asked = spark.createDataFrame([(1, ["a", "t3"]), (2, ["b", "t3", "t4"]), (3, [])], "query_id long, tokens array<string>")
    ways = (lambda: retrieval.ranked(retrieval.bm25(docs, asked), 4), lambda: retrieval.token_overlap(docs, asked, 1, 4))
    before = [rows(way()) for way in ways]
    monkeypatch.setattr(retrieval, "PAIRS_A_TASK", 3)
    for way, want in zip(ways, before):
        df = way()
        dealt = nodes(df._jdf.queryExecution().optimizedPlan(), "RepartitionByExpression")
        assert dealt and {n.optNumPartitions().get() for n in dealt} == {20} and rows(df) == want
    monkeypatch.setattr(retrieval, "BROADCAST_QUERY_TERMS", 0)
    assert [rows(way()) for way in ways] == before


def test_an_inverted_index_is_made_within_its_row(spark, sf_dir):
    texts = [(1, "a b a c a"), (2, ""), (3, None), (4, "one"), (5, "b b b"), (6, "é ab zz ab")]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {r[0]: r[1] for r in df.select("id", catalog.inverted_index(F.split("text", " "))).collect()}
    assert got == {k: None if t is None else {w: [i for i, x in enumerate(t.split(" ")) if x == w] for w in t.split(" ")} for k, t in texts}
    assert df.select(catalog.inverted_index(F.array().cast("array<string>"))).first()[0] is None
    assert not nodes(catalogue.QUERIES["abstract_from_inverted_index"](spark, sf_dir)._jdf.queryExecution().optimizedPlan(), "Aggregate")


def test_batches_are_taken_apart_a_part_at_a_time():
    texts = ["x" * 400, None, "", "é" * 300, "y" * 2000, "z"]
    lists = [[1] * 50, None, [], [2] * 40, [3] * 300, [4]]
    batch = pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string()), "l": pa.array(lists, pa.list_(pa.int64()))})
    for column, most, size in (("t", 1000, lambda v: len((v or "").encode())), ("l", 800, lambda v: 8 * len(v or []))):
        for whole in (batch, batch.slice(1, 4), batch.slice(4)):
            parts = list(chunking.slices(whole, column, most))
            assert pa.Table.from_batches(parts).to_pylist() == whole.to_pylist() and len(parts) > 1
            assert all(p.num_rows == 1 or sum(map(size, p.column(column).to_pylist())) <= most for p in parts)
    assert list(chunking.slices(batch.slice(0, 0), "t")) == []
    assert [b.num_rows for b in chunking.record_batches([(1,)] * 5, pa.schema([("a", pa.int64())]), 2)] == [2, 2, 1]


def test_ruled_pages_are_dealt_to_a_stated_number_of_tasks(spark):
    strokes = spark.createDataFrame([(k, 1, 50.0, 10.0 * j, 90.0, 10.0 * j) for k in range(3) for j in range(3)], "doc_id long, page_number int, x0 double, top double, x1 double, bottom double")
    edges = ruled.rules(strokes)
    dealt = nodes(edges._jdf.queryExecution().optimizedPlan(), "RepartitionByExpression")
    assert [n.optNumPartitions().get() for n in dealt] == [int(spark.conf.get("spark.sql.shuffle.partitions"))] and edges.count() == 9
