"""Benchmark decontamination by greedy string tiling.

Words are lower-cased and lose surrounding ASCII punctuation. Seeds are the 5-word runs of the
benchmark; an item shorter than that is its own seed, and counts only if it is rare: one that stands in more than
``COMMON_DOCS`` rows and more than ``COMMON_SHARE`` of all rows (as "the" would) says nothing about a text, is left out,
and ``common_items`` lists it. Where a benchmark has such short items, a pass over all rows counts them first. A document's runs are found among them by
Karp-Rabin hashes. Items whose seeds in a document could cover at least ``MIN_COVERAGE`` of their words are
tiled: the longest match of words that are not yet marked, in item and document, is marked as a tile,
again and again, until no match of 5 words (or of the whole item, if shorter) is left. The longest
length is found by running Karp-Rabin hashes over the unmarked words, halving the lengths between the
least and the last one; all free matches of that length are then marked from left to right, each hash
hit compared word by word. Tiles never overlap, so a passage whose parts were reordered is still
covered. An item leaks into a document if its tiles cover at least ``MIN_COVERAGE`` of its words.
Pairs of places are never listed, so a text that says one phrase a thousand times costs no more than
another of its length.

The benchmark is the stated query set: it is read in blocks of at most ``BLOCK_CHARS`` characters,
each block's seed index is broadcast (its size is bounded by that), and all documents are scanned
against it in one narrow pass; the driver holds a block at a time. Null texts have no words, and items
without words match nothing. Null ids, repeated rows and ids: each row gets its results. Ties between
longest matches: the first in the item, then in the document. Very long texts are read whole, one at a
time. Empty tables give no rows. Extra columns are ignored, or carried along by the stage.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from copy import copy
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import mapped, slices

RUN = 5
#: Rows, and share of all rows, in which an item shorter than a run may stand and still count.
COMMON_DOCS, COMMON_SHARE = 20, 0.01
MIN_COVERAGE = 0.6
BLOCK_CHARS = 8_000_000
PUNCTUATION = ".,;:!?\"'()[]{}<>-_/\\|*#$%&@+=~^`"
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit value per word number, spread over all bits."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


class Rolling:
    """Karp-Rabin hashes of a word sequence: prefix sums give the hash of any window at once."""

    def __init__(self, ids: np.ndarray):
        self.prefix = np.zeros(len(ids) + 1, np.uint64)
        self.power = np.ones(len(ids) + 1, np.uint64)
        if len(ids):
            np.multiply.accumulate(np.full(len(ids), BASE), out=self.power[1:])
            np.add.accumulate(mixed(ids) * self.power[:-1], out=self.prefix[1:])

    def windows(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the windows of ``size`` words that start at the given places."""
        return (self.prefix[at + size] - self.prefix[at]) * self.power[len(self.power) - 1 - at]


def run_hashes(ids: np.ndarray, size: int = RUN) -> np.ndarray:
    """Hashes of all windows of ``size`` word numbers, the same for equal windows of any sequence."""
    h = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    x = mixed(ids)
    for k in range(size):
        h = h * BASE + x[k : len(ids) - size + 1 + k]
    return h ^ (h >> np.uint64(29))


class Index:
    """Seeds of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words: dict[str, int] = {}
        self.ids, self.seqs = [], []
        for item_id, text in items:
            words = [self.words.setdefault(w, len(self.words)) for w in plain_words(text)]
            if words:
                self.ids.append(item_id)
                self.seqs.append(np.array(words, np.int64))
        self._index()

    def _index(self) -> None:
        self.sizes = np.array([len(s) for s in self.seqs], np.int64)
        self.base = np.concatenate(([0], np.cumsum(self.sizes)))
        # by seed length: hash, item and place of each seed, in the order of the hashes
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(RUN, len(s)) for s in self.seqs}):
            of = [i for i, s in enumerate(self.seqs) if min(RUN, len(s)) == size]
            keys = [run_hashes(self.seqs[i], size) for i in of]
            key = np.concatenate(keys)
            item = np.concatenate([np.full(len(k), i) for i, k in zip(of, keys)])
            at = np.concatenate([np.arange(len(k)) for k in keys])
            order = np.argsort(key, kind="stable")
            self.seeds[size] = key[order], item[order], at[order]

    def part(self, places: list[int], ids: list[int | None]) -> Index:
        """An index of the items at some places, under other ids."""
        out = copy(self)
        out.ids, out.seqs = ids, [self.seqs[k] for k in places]
        out._index()
        return out

    def numbers(self, text: str) -> np.ndarray:
        """Word numbers of a text, -1 for words that no item has."""
        get = self.words.get
        out = []
        for w in text.lower().split():
            n = get(w)
            if n is None:
                w = w.strip(PUNCTUATION)
                if not w:
                    continue
                n = get(w, -1)
            out.append(n)
        return np.array(out, np.int64)

    def candidates(self, doc: np.ndarray, size: int) -> np.ndarray:
        """Items of a seed length whose seeds in the document could cover enough of them."""
        key, item, at = self.seeds[size]
        if len(doc) < size:
            return np.zeros(0, np.int64)
        valid = np.lib.stride_tricks.sliding_window_view(doc >= 0, size).all(1)
        there = np.unique(run_hashes(doc, size)[valid])
        low, high = np.searchsorted(key, there, "left"), np.searchsorted(key, there, "right")
        n = (high - low)[high > low]
        if not len(n):
            return np.zeros(0, np.int64)
        place = np.repeat(low[high > low] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        covered = np.unique(((self.base[item[place]] + at[place])[:, None] + np.arange(size)).ravel())
        owner = np.searchsorted(self.base, covered, "right") - 1
        items, most = np.unique(owner, return_counts=True)
        return items[most >= MIN_COVERAGE * self.sizes[items]]

    def leaks(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, words of the item, tiled words, tiles) of items that leak into a text."""
        doc = self.numbers(text)
        found = np.sort(np.concatenate([self.candidates(doc, size) for size in self.seeds])) if self.seeds else ()
        rolling = Rolling(doc) if len(found) else None
        out = []
        for k in found:
            seq = self.seqs[k]
            tiles = tiling(seq, doc, rolling)
            total = sum(t[2] for t in tiles)
            if total and total >= MIN_COVERAGE * len(seq):
                out.append((self.ids[k], len(seq), total, len(tiles)))
        return out


def plain_words(text: str) -> list[str]:
    """Lower-cased words without surrounding punctuation."""
    return [w for w in (x.strip(PUNCTUATION) for x in text.lower().split()) if w]


def free_starts(free: np.ndarray, size: int) -> np.ndarray:
    """Places of the windows of ``size`` words that hold no marked word."""
    if len(free) < size:
        return np.zeros(0, np.int64)
    taken = np.concatenate(([0], np.cumsum(~free)))
    return np.flatnonzero(taken[size:] == taken[:-size])


def tiling(item: np.ndarray, doc: np.ndarray, rolling: Rolling | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in document, length), longest first."""
    least = min(RUN, len(item))
    # words that the item lacks end every match
    open_doc, open_item = np.isin(doc, item) & (doc >= 0), np.ones(len(item), bool)
    words = rolling or Rolling(doc)
    own = Rolling(np.concatenate([item, np.full(max(0, len(doc) - len(item)), -1)]))
    if len(own.power) != len(words.power):
        words = Rolling(np.concatenate([doc, np.full(len(own.power) - len(words.power), -1)]))

    def shared(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        i, j = free_starts(open_item, size), free_starts(open_doc, size)
        x, y = own.windows(i, size), words.windows(j, size)
        in_item, in_doc = np.isin(x, y), np.isin(y, x)
        return i[in_item], x[in_item], j[in_doc], y[in_doc]

    tiles, top = [], len(item)
    while True:
        low, high = least - 1, min(top, len(doc))
        while low < high:
            middle = (low + high + 1) // 2
            if len(shared(middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < least:
            return tiles
        i, x, j, y = shared(low)
        order = np.argsort(y, kind="stable")
        j, y = j[order], y[order]
        first, end = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
        next_of: dict[int, int] = {}
        marked = len(tiles)
        for a, f, e in zip(i.tolist(), first.tolist(), end.tolist()):
            if not open_item[a : a + low].all():
                continue
            k = next_of.get(f, f)
            while k < e:
                b = int(j[k])
                k += 1
                if open_doc[b : b + low].all() and (item[a : a + low] == doc[b : b + low]).all():
                    tiles.append((a, b, low))
                    open_item[a : a + low] = False
                    open_doc[b : b + low] = False
                    break
            next_of[f] = k
        # a length of which only unequal windows share a hash is passed by
        top = low - (len(tiles) == marked)


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """Seed indexes of the benchmark, a bounded block at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        text = row[1] or ""
        if held and size + len(text) > block_chars:
            yield Index(held)
            held, size = [], 0
        held.append((row[0], text))
        size += len(text)
    yield Index(held)


def short_counts(source: DataFrame, index: Index) -> dict[int, int]:
    """Rows of source (doc_id, text) in which each short item stands, by the item's place in the index."""
    short = [k for k, s in enumerate(index.seqs) if len(s) < RUN]
    if not short:
        return {}
    shared = source.sparkSession.sparkContext.broadcast(index.part(short, short))

    def count(batches):
        for batch in batches:
            n = Counter(r[0] for t in batch.column(1).to_pylist() if t for r in shared.value.leaks(t))
            yield pa.RecordBatch.from_pydict({"item": list(n), "n": list(n.values())}, schema=pa.schema([("item", pa.int64()), ("n", pa.int64())]))

    # as many rows as the block has short items
    found = {r["item"]: r["n"] for r in source.mapInArrow(count, "item long, n long").groupBy("item").agg(F.sum("n").alias("n")).collect()}
    shared.unpersist()
    return found


def rare_blocks(docs: DataFrame, benchmark: DataFrame, block_chars: int) -> Iterator[tuple[Index, list[tuple[int | None, int, int]]]]:
    """Indexes of the benchmark's blocks without common short items, and (item_id, n_words, n_docs) of what each leaves out."""
    source, total = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), None
    for index in benchmark_blocks(benchmark, block_chars):
        counts = short_counts(source, index)
        if counts and total is None:
            total = docs.count()
        common = {k: n for k, n in counts.items() if n > max(COMMON_DOCS, COMMON_SHARE * total)}
        if common:
            places = [k for k in range(len(index.seqs)) if k not in common]
            out = [(index.ids[k], len(index.seqs[k]), n) for k, n in sorted(common.items())]
            yield index.part(places, [index.ids[k] for k in places]), out
        else:
            yield index, []


def common_items(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, n_words and n_docs of the short items that are too common to be looked for."""
    rows = [r for _, out in rare_blocks(docs, benchmark, block_chars) for r in out]
    return docs.sparkSession.createDataFrame(rows, "item_id long, n_words long, n_docs long")


def leaked_items(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row per (row of docs, leaked item): doc_id, item_id, n_item_words, n_tiled, n_tiles, coverage."""
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    names = ("doc_id", "item_id", "n_item_words", "n_tiled", "n_tiles")
    arrow = pa.schema([*((n, pa.int64()) for n in names), ("coverage", pa.float64())])

    def against(index) -> DataFrame:
        def rows_of(part: pa.RecordBatch) -> dict:
            rows = [(d, *r) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if t for r in index.value.leaks(t)]
            return {n: [r[k] for r in rows] for k, n in enumerate(names)} | {"coverage": [r[3] / r[2] for r in rows]}

        return mapped(source, rows_of, "doc_id long, item_id long, n_item_words long, n_tiled long, n_tiles long, coverage double", arrow)

    context = docs.sparkSession.sparkContext
    return reduce(DataFrame.unionByName, [against(context.broadcast(x)) for x, _ in rare_blocks(docs, benchmark, block_chars)])


def clean_documents(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, unchanged, into which no item leaks."""
    context = docs.sparkSession.sparkContext
    text_at, out = docs.columns.index("text"), docs
    for block, _ in rare_blocks(docs, benchmark, block_chars):
        index = context.broadcast(block)

        def keep(batches, index=index):
            for batch in batches:
                mask = [not (t and index.value.leaks(t)) for part in slices(batch) for t in part.column(text_at).to_pylist()]
                yield batch.filter(pa.array(mask, pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
