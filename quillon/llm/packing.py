"""Best-fit packing by a distributed grouping genetic algorithm.

Documents become token ids (byte-level BPE, then an end token) and, where longer than a sequence,
pieces: full ones, and before them one of what is left over. Full pieces are sequences of their own.
All other pieces are dealt by hash to islands of about ``ISLAND`` pieces. An island evolves
packings of its pieces; pieces of one length are interchangeable, so a packing is a list of bins of
lengths. Crossover injects whole well-filled bins of one parent into the other, drops the other's
bins that would use a piece twice, and places the displaced pieces by replacement and best fit;
mutation dissolves the worst bins. After each epoch the best-filled bin patterns of all islands (a bounded table) migrate to all
islands, which inject them where they have the lengths. Last, the bins that are not well filled are
dealt anew as whole bins, and islands of them from all over evolve once more; the packing that they
come with is in the population, so this never costs a sequence. Seeds are fixed, so results repeat.

Null text: empty, one piece of the end token alone. Null ids, repeated rows and ids: each row is
packed for itself. Ties: pieces of one length are interchangeable and taken by uid, of equal packings
the first found stays. An empty table gives no pieces. Very long texts are encoded whole, one at a
time. Extra columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, slices

CAPACITY = 1024
END_TOKEN = 2
ISLAND = 8192
EPOCHS, POPULATION, PATIENCE = 2, 4, 8
ELITES = 256
WELL_FILLED = 0.99


def encoder(path: str):
    """The tokenizer file's byte-level BPE as a fast encoder; ids equal those of ``tokenizers``.

    Ranks are the ids of the file's vocabulary; its added tokens are matched in texts, as there.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(back[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in added}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def token_ids(encoding, text: str | None) -> np.ndarray:
    """Ids of a text and the end token."""
    return np.append(np.array(encoding.encode(text or "", allowed_special="all"), "<u4"), np.array([END_TOKEN], "<u4"))


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    first = n - capacity * (-(-n // capacity) - 1)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(df: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 and a number uid."""
    source = df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("string").alias("text"))
    arrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("uid", pa.int64())])

    def run(batches):
        import public_tokenizers

        encoding = encoder(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = token_ids(encoding, text)
                    for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                        rows.append((doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes()), uid))
                        uid += 1
                yield pa.RecordBatch.from_pydict({f.name: [r[i] for r in rows] for i, f in enumerate(arrow)}, schema=arrow)

    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, uid long")


Bin = tuple[int, ...]


def best_fit(bins: list[list[int]], items: list[int], capacity: int) -> list[list[int]]:
    """Put items, longest first, each into the bin it fills best, or into a new one."""
    free = sorted((capacity - sum(b), k) for k, b in enumerate(bins))
    for n in items:
        at = bisect_left(free, (n, -1))
        if at < len(free):
            room, k = free.pop(at)
            bins[k].append(n)
        else:
            room, k = capacity, len(bins)
            bins.append([n])
        if room > n:
            insort(free, (room - n, k))
    return bins


def replaced(loose: list[list[int]], displaced: list[int], capacity: int) -> list[int]:
    """Fill bins better by giving one of their pieces for one or two displaced ones; what is displaced then, ascending.

    Small pieces are easier to place than large ones, so each exchange brings bins nearer to full.
    """
    pool = sorted(displaced)
    for b in loose:
        free = capacity - sum(b)
        for k, x in enumerate(b):
            if not free or not pool:
                break
            at = bisect_right(pool, x + free) - 1
            one = pool[at] if at >= 0 else 0
            i, j, two, pair = 0, at, 0, None
            while i < j and two < x + free:
                total = pool[i] + pool[j]
                if total > x + free:
                    j -= 1
                else:
                    if total > two:
                        two, pair = total, (i, j)
                    i += 1
            if max(one, two) <= x:
                continue
            if two > one:
                b[k : k + 1] = [pool[pair[0]], pool[pair[1]]]
                del pool[pair[1]], pool[pair[0]]
                free -= two - x
            else:
                b[k] = pool.pop(at)
                free -= one - x
            insort(pool, x)
            break
    return pool


def repaired(kept: list[Bin], left: Counter, others: list[Bin], capacity: int) -> list[Bin]:
    """A packing with ``kept`` bins, those of ``others`` that use no piece twice, and the rest by replacement and best fit."""
    whole, loose = list(kept), []
    for b in others:
        need = Counter(b)
        if all(left[n] >= c for n, c in need.items()):
            left.subtract(need)
            if sum(b) >= WELL_FILLED * capacity:
                whole.append(b)
            else:
                loose.append(list(b))
    displaced = replaced(loose, list(left.elements()), capacity)
    return whole + [tuple(b) for b in best_fit(loose, displaced[::-1], capacity)]


def fitness(bins: list[Bin], capacity: int) -> tuple[int, int]:
    """Fewer bins, then more uneven filling; smaller is better."""
    return len(bins), -sum(sum(b) ** 2 for b in bins)


def crossover(a: list[Bin], b: list[Bin], stock: Counter, rng: random.Random, capacity: int) -> list[Bin]:
    """Inject a run of a's well-filled bins into b."""
    good = [x for x in a if sum(x) >= WELL_FILLED * capacity]
    if not good:
        return b
    s, e = sorted(rng.choices(range(len(good) + 1), k=2))
    left = stock.copy()
    inject = good[s:e]
    for x in inject:
        left.subtract(x)
    return repaired(inject, left, b, capacity)


def immigrate(bins: list[Bin], migrants: list[Bin], stock: Counter, capacity: int) -> list[Bin]:
    """Inject each migrant pattern once where the lengths are there."""
    left, inject = stock.copy(), []
    for x in migrants:
        need = Counter(x)
        if all(left[n] >= c for n, c in need.items()):
            left.subtract(need)
            inject.append(x)
    return repaired(inject, left, bins, capacity)


def mutate(bins: list[Bin], rng: random.Random, capacity: int) -> list[Bin]:
    """Dissolve the worst bins and some others; place what they held by replacement and best fit."""
    order = sorted(bins, key=sum)
    worst = max(1, len(order) // 20)
    picked = set(range(worst)) | {rng.randrange(len(order)) for _ in range(worst)}
    loose = [list(b) for k, b in enumerate(order) if k not in picked]
    rng.shuffle(loose)
    items = replaced(loose, [n for k in picked for n in order[k]], capacity)
    items.sort(key=lambda n: -n + rng.random() * 16)
    return [tuple(b) for b in best_fit(loose, items, capacity)]


def evolve(lengths: list[int], start: list[Bin] | None, migrants: list[Bin], seed: int, capacity: int = CAPACITY) -> list[Bin]:
    """The best packing of an island's lengths after one epoch.

    It ends at the lower bound, or when ``PATIENCE`` children in a row were no better than the best.
    """
    rng = random.Random(seed)
    stock = Counter(lengths)
    down = sorted(lengths, reverse=True)
    people = [[tuple(b) for b in best_fit([], down, capacity)]]
    bound = -(-sum(lengths) // capacity)
    if start:
        people.append(start)
    if migrants:
        people.append(immigrate(min(people, key=lambda p: fitness(p, capacity)), migrants, stock, capacity))
    stale = 0
    while min(map(len, people)) > bound and stale < PATIENCE:
        people.sort(key=lambda p: fitness(p, capacity))
        best = fitness(people[0], capacity)
        if len(people) < POPULATION:
            child = mutate(people[0], rng, capacity)
        else:
            a, b = rng.sample(people[: POPULATION // 2 + 1], 2)
            child = mutate(crossover(a, b, stock, rng, capacity), rng, capacity)
        people = [*people[: POPULATION - 1], child]
        # a better filling of as many bins counts too, but not without end: each step must save 0.1 % of it
        stale = 0 if len(child) < best[0] or (len(child) == best[0] and fitness(child, capacity)[1] < 1.001 * best[1]) else stale + 1
    return min(people, key=lambda p: fitness(p, capacity))


def _epoch(rows: DataFrame, migrants: list[Bin], epoch: int, capacity: int) -> DataFrame:
    """One epoch on every island: rows with bin and offset of the island's best packing."""

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["uid"].to_numpy(), table["length"].to_numpy()))
        table = table.take(pa.array(order))
        lengths = table["length"].to_pylist()
        start = None
        if epoch:
            held: dict[int, list[int]] = {}
            for b, n in zip(table["bin"].to_pylist(), lengths):
                held.setdefault(b, []).append(n)
            start = [tuple(x) for x in held.values()]
        best = evolve(lengths, start, migrants, table["island"][0].as_py() * 1009 + epoch, capacity)
        first: dict[int, int] = {}
        for k, n in enumerate(lengths):
            first.setdefault(n, k)
        bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, b in enumerate(best):
            at = 0
            for n in b:
                row = first[n]
                first[n] = row + 1
                bins[row], offsets[row] = k, at
                at += n
        out = table.drop_columns(["bin", "offset"])
        return out.append_column("bin", pa.array(bins)).append_column("offset", pa.array(offsets))

    return rows.groupBy("island").applyInArrow(run, rows.schema)


def _merge_loose(scratch: Scratch, state: DataFrame, islands: int, capacity: int, island: int) -> DataFrame:
    """A last epoch on islands made of whole bins that are not well filled, from all islands."""
    if islands < 2:
        return state
    fill = F.sum("length").over(Window.partitionBy("island", "bin"))
    marked = scratch.table(state.withColumn("loose", fill < WELL_FILLED * capacity))
    loose = marked.filter("loose").drop("loose")
    merged = max(1, -(-loose.count() // island))
    home = F.pmod(F.xxhash64("island", "bin"), F.lit(merged)) + islands
    again = loose.withColumns({"bin": F.shiftleft("island", 32) + F.col("bin"), "island": home})
    again = scratch.table(_epoch(again, [], EPOCHS, capacity))
    return marked.filter("NOT loose").drop("loose").unionByName(again)


def packed(df: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, island: int = ISLAND, scratch: Scratch | None = None) -> DataFrame:
    """A row per piece with sequence_id and offset."""
    scratch = scratch or Scratch(df.sparkSession)
    all_pieces = scratch.table(pieces(df, tokenizer, capacity))
    loose = all_pieces.filter(F.col("length") < capacity)
    islands = max(1, -(-loose.count() // island))
    zero = F.lit(0).cast("long")
    state = loose.withColumns({"island": F.pmod(F.xxhash64("uid"), F.lit(islands)), "bin": zero, "offset": zero})
    migrants: list[Bin] = []
    for epoch in range(EPOCHS):
        state = scratch.table(_epoch(state, migrants, epoch, capacity))
        if epoch + 1 < EPOCHS:
            patterns = state.groupBy("island", "bin").agg(F.sort_array(F.collect_list("length"), asc=False).alias("pattern"), F.sum("length").alias("fill"))
            best = patterns.filter(F.col("fill") >= WELL_FILLED * capacity).groupBy("pattern", "fill").agg(F.count("*").alias("n")).orderBy(F.desc("fill"), "n", "pattern").limit(ELITES)
            migrants = [tuple(r["pattern"]) for r in best.collect()]
    state = _merge_loose(scratch, state, islands, capacity, island)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = all_pieces.filter(F.col("length") >= capacity).select(*columns, (-1 - F.col("uid")).alias("sequence_id"), zero.alias("offset"))
    return full.unionByName(state.select(*columns, (F.shiftleft("island", 32) + F.col("bin")).alias("sequence_id"), "offset"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
