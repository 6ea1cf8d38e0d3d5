"""The filter audit against a loop over documents and orders."""

from collections import Counter
from itertools import permutations
import random
import re

import duckdb
import pytest

from quillon.llm import filter_audit


def brute(docs, labels):
    good, toxic = ({i for i, *m in labels if i is not None and m[k] == 1} for k in (0, 1))
    ids: dict = {}
    for i, text, _ in docs:
        if i is not None:
            ids[text or ""] = min(i, ids.get(text or "", i))
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and ids[text] < i,
        }
        rows.append((source or "", fails, i in good, i in toxic))
    out, share = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                failing = sum(r[1][f] for r in mine)
                only = sum(r[1][f] and sum(r[1].values()) == 1 for r in mine)
                out[part, order, step] = (len(left), len(gone), failing - len(gone), only, sum(r[2] for r in gone), sum(r[3] for r in gone))
                share[part, f] += len(gone)
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows_of(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    vocabulary = ["ein", "Wort", "two", "words", "ÀB", "HOCH", "$5", "a|b", "x\ty", "é"]
    texts = [None, "", " \n"] + [" ".join(rng.choice(vocabulary[: rng.randrange(1, 11)]) + str(rng.randrange(n)) for _ in range(rng.choice([5, 150, 199, 200, 260]))) for n in [1, 2, 50, 400] * 12]
    docs = [(k if k % 17 else None, rng.choice(texts), rng.choice(["a", "b", None, "", "c"])) for k in range(300)]
    docs += docs[:5]
    labels = [(rng.randrange(300), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)] + [(None, 1, 1)]
    return docs, labels


def test_equals_a_loop(spark, made):
    docs, labels = made
    df = spark.createDataFrame([(*d, 1, True) for d in docs], "doc_id long, text string, source string, A int, good boolean")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows_of(filter_audit.audit(filter_audit.flagged(df, marks))) == brute(docs, labels)


def test_equals_its_sql(made, spark, tmp_path):
    docs, labels = made
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = filter_audit.op13_filter_audit(spark, str(tmp_path)).toPandas()
    want = con.execute(filter_audit.ORACLE).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(got[want.columns].itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.flagged(docs, marks)).count() == 0
    one = docs.union(spark.createDataFrame([(1, None, None)], docs.schema))
    got = rows_of(filter_audit.audit(filter_audit.flagged(one, marks)))
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
