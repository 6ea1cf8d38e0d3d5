"""Whitening against numpy on the whole matrix, and its edge cases."""

import numpy as np
import pytest

from quillon.llm import whitening


def brute(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviations = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviations, centred @ u / np.sqrt(e), e / np.trace(v)


def held(rows, valid):
    n, deviations, white, shares = brute([v for _, v in valid])
    k = white.shape[1]
    assert len(rows) == len(valid) * k
    by = {(r.vec_id, r.component): r for r in rows}
    mine = np.array([[by[i, c].whitened for c in range(1, k + 1)] for i, _ in valid])
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-9
    for (i, _), d in zip(valid, deviations):
        for c in range(1, k + 1):
            row = by[i, c]
            assert row.n == n and row.deviation == d == int(row.deviation_wide)
            assert row.explained == pytest.approx(shares[c - 1], rel=1e-9)
            assert row.identity_error < 1e-9


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)


def test_query_equals_numpy(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    valid = [(r.vec_id, r.embedding) for r in rows if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding)]
    held(whitening.op12_whitening(spark, sf_dir).collect(), valid)


def test_bad_rows_are_dropped_and_repeats_count(spark):
    rng = np.random.default_rng(3)
    good = [(k, rng.normal(size=5).astype(np.float32).tolist()) for k in range(300)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf")] + [0.0] * 4), (904, []), (905, [1.0, 2.0]), (906, [3e38] * 5)]
    df = table(spark, [(i, v, None) for i, v in [*good, *bad]])
    held(whitening.whitened(df).collect(), good)
    twice = whitening.whitened(df.union(df)).where("vec_id = 0").collect()
    assert len(twice) == 10 and {r.n for r in twice} == {600}


def test_components_without_variance_are_null(spark):
    rows = [(k, [float(k % 7), float(k % 7), 2.5]) for k in range(70)]
    got = whitening.whitened(table(spark, [(i, v, None) for i, v in rows])).collect()
    assert {r.component for r in got if r.whitened is not None} == {1}
    assert {round(r.explained, 9) for r in got if r.component == 1} == {1.0} and {r.identity_error < 1e-9 for r in got} == {True}
    one = whitening.whitened(table(spark, [(1, [0.5, 0.25], None)])).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in one] == [(1, 0, None, None)] * 2


def test_deviations_beyond_a_long(spark):
    rows = [(0, [1e8, 0.0]), (1, [-1e8, 1.0]), (2, [0.0, 2.0])]
    got = {r.vec_id: r for r in whitening.whitened(table(spark, [(i, v, None) for i, v in rows], "double")).collect()}
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((3 * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert [int(got[i].deviation_wide) for i in range(3)] == want
    assert [got[i].deviation for i in range(3)] == [d if d < 1 << 63 else None for d in want] and max(want) >= 1 << 63


def test_empty_table(spark):
    empty = whitening.whitened(table(spark, []).where("false"))
    assert empty.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.count() == 0
