"""SimHash near-duplicates with the generalised pigeonhole principle.

Fingerprint: ASCII-lowered words, k-word shingles with repeats, XXH64 (seed 42) of each, and a bit
is set if it is set in over half of the hashes. Fewer than k words give one shingle of all words;
no words give fingerprint zero, which links like any other.

Search for links of at most ``distance`` differing bits among the distinct fingerprints:

1. The 64x64 table of how often two bits agree is summed over all fingerprints, and greedily
   correlated bits are put into the same of m groups, so that some groups discriminate well.
2. A histogram of each group's values gives the estimated candidates of every threshold, and dynamic
   programming picks thresholds t_i >= -1 with sum(t_i + 1) = distance + 1 of least cost. By the
   generalised pigeonhole principle a linked pair differs by at most t_i bits in some group i.
3. Every fingerprint goes to its own bucket of each group with t_i >= 0, and to all buckets within
   t_i bits; a bucket's pairs are verified on all 64 bits. A bucket gives a spanning forest of its
   links, never all its pairs. Buckets of more than ``TILE`` rows are split into tiles, and every
   pair of tiles is one unit of work, so no task holds more than two tiles at a time.
4. Components of the forest come from star contraction (graph.py).

Exact copies are one fingerprint from the start. m follows from the number of fingerprints, so that
a bucket holds 64 of them on average. The driver sees 4096 agreement counts, at most 2^14 histogram
rows a group, and counters. Null text: empty. Null doc_id: kept; component_id is the smallest id
that is not null in the component, or null. Repeated rows and ids: each row gets its result. Ties (a bit
set in just half of the hashes): not set. Very long texts are read whole, one at a time. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, mapped, slices
from quillon.llm.graph import components

BITS = 64
TILE = 2048
PREFIX = 14
FEW_HOT = 100_000


def shingles(text: str | None, k: int) -> np.ndarray:
    """Hashes of a text's k-word shingles, with repeats."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= k:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.fromiter((digest(joined[s:e], 42) for s, e in spans), np.uint64, n - k + 1)


def fingerprint(text: str | None, k: int) -> int:
    """Unsigned 64-bit SimHash of a text."""
    return simhash(shingles(text, k))


def simhash(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of hashes, with repeats."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).view(np.uint8)
        counts += np.unpackbits(part, bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, fp) per row, fp as the signed long of the same bits."""
    source = df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("string").alias("text"))
    arrow = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def rows_of(part: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, k) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
        return {"doc_id": part.column(0), "fp": fps}

    return mapped(source, rows_of, "doc_id long, fp long", arrow)


def bit_matrix(fps: np.ndarray) -> np.ndarray:
    """n x 64 array of bits, bit 0 first."""
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), bitorder="little").reshape(-1, BITS)


def group_bits(distinct: DataFrame, m: int) -> list[list[int]]:
    """m groups of bits; each grows greedily by the bit most correlated with it, from sums over all rows."""

    def sums(batches):
        total = np.zeros((BITS, BITS), np.int64)
        n = 0
        for batch in batches:
            for part in slices(batch, 1 << 15):
                b = bit_matrix(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)).astype(np.float32)
                total += (b.T @ b).astype(np.int64)
                n += len(b)
        yield pa.RecordBatch.from_pydict({"k": np.arange(BITS * BITS + 1), "n": np.append(total.ravel(), n)}, schema=pa.schema([("k", pa.int64()), ("n", pa.int64())]))

    got = dict(distinct.select("fp").mapInArrow(sums, "k long, n long").groupBy("k").agg(F.sum("n")).collect())
    n = max(1, got.get(BITS * BITS, 0))
    both = np.array([got.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS) / n
    p = both.diagonal()
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = set(range(BITS)), []
    for g in range(m):
        width = BITS // m + (g < BITS % m)
        rest = sorted(left)
        seed = max(rest, key=lambda i: (corr[i, rest].sum(), -i))
        group = [seed]
        left.discard(seed)
        while len(group) < width:
            best = max(sorted(left), key=lambda i: (corr[i, group].sum(), -i))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def group_values(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a group, packed."""
    u = fps.view(np.uint64)
    out = np.zeros(len(u), np.int64)
    for k, bit in enumerate(group):
        out |= ((u >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    return out


def flips(width: int, t: int) -> list[int]:
    """XOR masks of at most t bits, zero first."""
    return [sum(1 << b for b in c) for d in range(t + 1) for c in combinations(range(width), d)]


def allocate(distinct: DataFrame, groups: list[list[int]], distance: int) -> list[int]:
    """Thresholds by dynamic programming on the estimated candidates of each group and threshold.

    They go up to 2, or as far as ``distance`` needs: beyond about 15 bits, buckets are many.
    """

    def count(batches):
        total = [np.zeros(1 << min(PREFIX, len(g)), np.int64) for g in groups]
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, g in enumerate(groups):
                total[i] += np.bincount(group_values(fps, g[:PREFIX]), minlength=len(total[i]))
        for i, c in enumerate(total):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"i": np.full(len(at), i), "v": at, "n": c[at]}, schema=pa.schema([("i", pa.int64()), ("v", pa.int64()), ("n", pa.int64())]))

    hist = [np.zeros(1 << min(PREFIX, len(g))) for g in groups]
    for i, v, n in distinct.select("fp").mapInArrow(count, "i long, v long, n long").groupBy("i", "v").agg(F.sum("n")).collect():
        hist[i][v] = n
    choices = []
    for g, h in zip(groups, hist):
        costs = {-1: 0.0}
        for t in range(0, min(max(3, -(-(distance + 1) // len(groups))), distance + 1, len(g))):
            masks = flips(min(PREFIX, len(g)), t)
            index = np.arange(len(h))
            pairs = sum(float((h * h[index ^ x]).sum()) for x in masks) / 2.0 ** max(0, len(g) - PREFIX)
            costs[t] = pairs + 300.0 * h.sum() * len(flips(len(g), t))
        choices.append(costs)
    need = distance + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for costs in choices:
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, picks) in best.items():
            for t, c in costs.items():
                total = min(need, have + t + 1)
                if total not in step or cost + c < step[total][0]:
                    step[total] = (cost + c, [*picks, t])
        best = step
    return best[need][1]


def _forest(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    a: list[int] = []
    b: list[int] = []
    u = fps.view(np.uint64)
    n = len(u)
    if n <= 512:
        near = np.bitwise_count(u[:, None] ^ u[None, :]) <= distance
        if near.sum() == n:
            return a, b
    rest = np.arange(n)
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        front = np.array([seed])
        while len(front) and len(rest):
            hit = np.zeros(len(rest), bool)
            for at in range(0, len(front), 256):
                todo = np.flatnonzero(~hit)
                if not len(todo):
                    break
                d = np.bitwise_count(u[front[at : at + 256], None] ^ u[rest[todo]][None, :]) <= distance
                hit[todo[d.any(0)]] = True
            front, rest = rest[hit], rest[~hit]
            a += fps[front].tolist()
            b += [int(fps[seed])] * len(front)
    return a, b


def links(scratch: Scratch, distinct: DataFrame, distance: int) -> DataFrame:
    """(a, b): a forest whose components are those of all pairs at most ``distance`` bits apart."""
    n = distinct.count()
    width = max(12, int(np.ceil(np.log2(max(2, n)))) - 6)
    m = max(1, min(distance + 1, BITS // width))
    groups = group_bits(distinct, m)
    limits = allocate(distinct, groups, distance)
    masks = [np.array(flips(len(g), t), np.int64) if t >= 0 else None for g, t in zip(groups, limits)]

    def probe(batches):
        for batch in batches:
            for part in slices(batch, 4096):
                fps = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for i, x in enumerate(masks):
                    if x is not None:
                        value = group_values(fps, groups[i])
                        key = (value[:, None] ^ x[None, :]) | (i << 56)
                        yield pa.RecordBatch.from_pydict({"key": key.ravel(), "fp": np.repeat(fps, len(x))}, schema=pa.schema([("key", pa.int64()), ("fp", pa.int64())]))

    probes = distinct.select("fp").mapInArrow(probe, "key long, fp long")
    hot = scratch.table(probes.groupBy("key").count().filter(F.col("count") > TILE).select("key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")))
    few = hot.count() <= FEW_HOT
    rows = probes.join(F.broadcast(hot) if few else hot, "key", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    other = F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("key", "fp", F.coalesce(mine, F.lit(0)).alias("mine"), other.alias("other"))
    rows = rows.select("key", F.least("mine", "other").alias("ta"), F.greatest("mine", "other").alias("tb"), "fp")
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches):
        held: list[np.ndarray] = []
        group_key = None
        a: list[int] = []
        b: list[int] = []

        def close():
            fps = np.concatenate(held) if len(held) > 1 else held[0]
            if len(fps) > 1:
                x, y = _forest(np.unique(fps), distance)
                a.extend(x)
                b.extend(y)

        for batch in batches:
            key, ta, tb, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(key):
                continue
            cut = np.flatnonzero((key[1:] != key[:-1]) | (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])) + 1
            for s, e in zip(np.append(0, cut), np.append(cut, len(key))):
                now = (key[s], ta[s], tb[s])
                if now != group_key:
                    if held:
                        close()
                    held, group_key = [], now
                held.append(fp[s:e].astype(np.int64))
            if len(a) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=edge)
                a, b = [], []
        if held:
            close()
        yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=edge)

    return rows.repartition("key", "ta", "tb").sortWithinPartitions("key", "ta", "tb").mapInArrow(verify, "a long, b long")


def fingerprint_classes(scratch: Scratch, prints: DataFrame, distance: int) -> DataFrame:
    """(fp, component_id) per distinct fingerprint of ``prints`` (doc_id, fp), a written table."""
    distinct = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = scratch.table(components(scratch, links(scratch, distinct.select("fp"), distance)))
    rooted = scratch.table(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = scratch.table(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return scratch.table(rooted.join(ids, "root").select("fp", "component_id"))


def near_duplicate_classes(df: DataFrame, k: int = 4, distance: int = 4) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id."""
    scratch = Scratch(df.sparkSession)
    prints = scratch.table(fingerprints(df, k))
    classes = fingerprint_classes(scratch, prints, distance)
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
