"""PCA whitening of embeddings: mean and covariance in two passes, eigenvectors, projection of all rows.

Entries become integers x = floor(1024 c) + 100000, so the sums S and the count n of the first pass are
exact and the mean is S / n. The second pass adds, in every partition, the outer products of the
centred rows as one matrix product a block, so nothing large is subtracted from anything large; the
partial matrices meet in ``treeAggregate``. What reaches the driver is one dims x dims matrix.
LAPACK gives its eigenvectors, and the projection (dims x components) goes to the tasks with the map
function. A third pass takes the covariance of the whitened rows themselves, for the check value.

Only partial results, one a partition, are RDD rows: the data stays in Arrow batches.

Edge cases: a row without a vector, with a null or non-finite entry, or with an x beyond 2^40 (where
sums of it would not fit) is dropped; empty vectors count as vectors without entries and are dropped
too. All vectors are to have one length; where they differ, the length that most rows have counts
(the longer one of two), and other rows are dropped. Components without variance (an eigenvalue of at
most 1e-12 of the trace) have a null ``whitened`` and stay out of the check value. A deviation beyond
a long is null in ``deviation`` and stands in ``deviation_wide`` in any case, up to 38 digits. Repeated
rows count each time, ties of eigenvalues are in LAPACK's order, an empty table gives an empty result,
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SCALE, SHIFT = 1024, 100_000
#: Beyond this an x is dropped with its row; 2^22 rows of a partition's block still add up in a long.
LARGEST = 1 << 40
COMPONENTS = 8
#: Share of the trace up to which an eigenvalue counts as none.
NO_VARIANCE = 1e-12
#: Rows of one matrix product; sums over so many rows fit in a long.
BLOCK_ROWS = 4096


class Fit(NamedTuple):
    """What the projection needs: counts, sums, eigenvectors of the kept components, and the check value."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None


def _vectors(batch: pa.RecordBatch, length: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, x) of the valid vectors of a batch, for each length or the one asked for."""
    lists = batch.column("embedding")
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    for size in np.unique(sizes) if length is None else [length]:
        at = np.flatnonzero(sizes == size)
        for begin in range(0, len(at) if size else 0, BLOCK_ROWS):
            rows = at[begin : begin + BLOCK_ROWS]
            flat = lists.take(pa.array(rows)).flatten()
            entries = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), size)
            entries = np.floor(SCALE * entries) + SHIFT
            good = (np.abs(entries) <= LARGEST).all(axis=1)
            if good.any():
                yield int(size), rows[good], entries[good].astype(np.int64)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: as longs where they fit, as Python integers beyond."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _deviations(centred: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows."""
    largest = int(np.abs(centred).max(initial=0))
    if centred.shape[1] * largest * largest < 1 << 62:
        return (centred * centred).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in centred.tolist()]


def _partials(df: DataFrame, rows_of):
    """The pickled result of ``rows_of(batches)`` of every partition, as an RDD."""
    import pickle

    def run(batches):
        yield pa.RecordBatch.from_pydict({"part": [pickle.dumps(rows_of(batches))]})

    return df.mapInArrow(run, "part binary").rdd.map(lambda row: pickle.loads(row[0]))


def _counts(batches) -> dict[int, tuple[int, list[int]]]:
    """By length: number of vectors and exact sums of x."""
    found: dict[int, tuple[int, list[int]]] = {}
    for batch in batches:
        for size, rows, x in _vectors(batch):
            found = _add_counts(found, {size: (len(rows), x.sum(axis=0).tolist())})
    return found


def _add_counts(a: dict, b: dict) -> dict:
    out = dict(a)
    for size, (n, sums) in b.items():
        m, before = out.get(size, (0, [0] * size))
        out[size] = (m + n, [p + q for p, q in zip(before, sums)])
    return out


def _moments(rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and centred outer products of a block."""
    mean = rows.mean(axis=0)
    centred = rows - mean
    return len(rows), mean, centred.T @ centred


def _add_moments(a, b):
    """Joins two blocks' moments without leaving the centred form."""
    if a is None or b is None:
        return a if b is None else b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def fitted(df: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Whitening of the vectors of ``embedding``; None if there is no valid vector."""
    df = df.select("embedding")
    counts = _partials(df, _counts).treeAggregate({}, _add_counts, _add_counts)
    if not counts:
        return None
    length, (n, sums) = max(counts.items(), key=lambda item: (item[1][0], item[0]))

    def products(batches):
        total = np.zeros((length, length))
        for batch in batches:
            for _, _, x in _vectors(batch, length):
                centred = _centred(x, n, sums).astype(np.float64) / n
                total += centred.T @ centred
        return total

    covariance = _partials(df, products).treeAggregate(np.zeros((length, length)), np.add, np.add) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace, kept = float(np.trace(covariance)), min(components, length)
    fit = Fit(n, sums, vectors[:, :kept].copy(), values[:kept].copy(), trace, None)
    live = _live(fit)
    if not live.any():
        return fit

    def whitened(batches):
        found = None
        for batch in batches:
            for _, _, x in _vectors(batch, length):
                found = _add_moments(found, _moments(_projected(x, fit)[1][:, live]))
        return found

    total = _partials(df, whitened).treeAggregate(None, _add_moments, _add_moments)
    return fit._replace(identity_error=float(np.abs(total[2] / total[0] - np.eye(int(live.sum()))).max()))


def _live(fit: Fit) -> np.ndarray:
    return fit.values > NO_VARIANCE * fit.trace


def _projected(x: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """n x - S of rows, and their whitened components; a component without variance is NaN."""
    centred = _centred(x, fit.n, fit.sums)
    live = _live(fit)
    scale = np.where(live, 1 / np.sqrt(np.where(live, fit.values, 1)), np.nan)
    return centred, (centred.astype(np.float64) / fit.n) @ fit.vectors * scale


def projected(df: DataFrame, fit: Fit) -> DataFrame:
    """vec_id, deviation, deviation_wide and the array ``whitened`` of each row whose vector is valid."""
    length = len(fit.sums)
    schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("deviation_wide", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            for _, rows, x in _vectors(batch, length):
                centred, white = _projected(x, fit)
                exact = _deviations(centred)
                wide = pa.array([str(d) if d < 10**38 else None for d in exact], pa.string()).cast(pa.decimal128(38, 0))
                flat = pa.array(white.ravel(), from_pandas=True)
                ends = pa.array(np.arange(len(rows) + 1) * white.shape[1], pa.int32())
                fits = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), fits, wide, pa.ListArray.from_arrays(ends, flat)], schema=schema)

    return df.selectExpr("cast(vec_id AS long) AS vec_id", "embedding").mapInArrow(run, "vec_id long, deviation long, deviation_wide decimal(38,0), whitened array<double>")


def whitened(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per valid vector and component, with the share of variance and the check value."""
    fit = fitted(df, components)
    if fit is None:
        fit = Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, None)
        df = df.limit(0)
    shares = [float(v / fit.trace) if fit.trace > 0 else None for v in fit.values]
    literal = ", ".join("cast(null AS double)" if s is None else f"{s!r}D" for s in shares)
    error = "cast(null AS double)" if fit.identity_error is None else f"{fit.identity_error!r}D"
    rows = projected(df, fit).selectExpr("*", "posexplode(whitened) AS (at, score)")
    return rows.selectExpr(
        "vec_id",
        "at + 1 AS component",
        f"{fit.n}L AS n",
        "deviation",
        "score AS whitened",
        f"array({literal})[at] AS explained" if shares else "cast(null AS double) AS explained",
        f"{error} AS identity_error",
        "deviation_wide",
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight strongest whitened components of every valid vector of ``embeddings``."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
