"""Exact repeats of at least ``length`` words, by fixed-block anchors.

Blocks are the non-overlapping runs of ``(length + 1) // 2`` words of every document, counted from
its start, so every run of ``length`` words holds at least one whole block of its own document.

1. Index and probe. Hashes of all rolling windows of block size are dealt by hash to buckets; the
   windows at block borders are the index, all others probe it. A window hits if its hash is an
   indexed block's and occurs at two places or more. Windows travel as packed chunks of up to 65,536
   windows (four bytes of hash and two of place each), so a bucket's share of a chunk is one row.
   These hashes only nominate; a collision costs time, not correctness.
2. Extend. Texts with hits are joined to them, exact copies as one text with its number of copies,
   and all ``length``-word windows over a hit are dealt by hash and compared on 96 bits of it: 64 and
   32 are sent, and the bucket follows from the first. Windows found at two places are repeats;
   overlapping ones form the maximal repeats.
3. Cut. All words under such windows go; judged on the input, not on what is left.

Neither step forms pairs of documents: a passage that a third of all rows share costs one entry per
place. The number of buckets follows the characters of the input, so a bucket's size stays bounded.
Null texts have no words. Null ids, repeated rows and ids: each row gets its own result, and equal rows
repeat each other. Ties: of equal windows all go, the first too. Very long texts are cut into chunks
that overlap by a window. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, slices

LENGTH = 35
CHUNK = 1 << 16
BUCKET_CHARS = 12_000_000
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
ROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary()), ("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string())])
ROW_SQL = "bucket int, chunk long, data binary, doc_id long, k1 long, k2 long, n_words long, sha string"
SEGMENT = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("start", "<u4"), ("n", "<u4")])


class Rolling:
    """Hashes of all windows of a word-hash array by prefix sums modulo 2^64."""

    def __init__(self, multiplier: int):
        self.m, self.inverse = multiplier | 1, pow(multiplier | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate((one, np.full(n, self.m, np.uint64))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate((one, np.full(n, self.inverse, np.uint64))), dtype=np.uint64)

    def windows(self, hashes: np.ndarray, length: int) -> np.ndarray:
        n = len(hashes)
        self._powers(n + 1)
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * self.up[:n], dtype=np.uint64)))
        w = (prefix[length:] - prefix[:-length]) * self.down[: n - length + 1]
        w ^= w >> np.uint64(32)
        w *= np.uint64(0xD6E8FEB86659FD93)
        w ^= w >> np.uint64(32)
        w *= np.uint64(0xD6E8FEB86659FD93)
        return w ^ (w >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def split_words(text: str | None) -> list[bytes]:
    """Words between the characters U+0020 and U+0009 to U+000D, as UTF-8."""
    return (text or "").encode().split()


class Chunks:
    """Collects windows of segments and packs each full chunk by bucket.

    Equal windows of a chunk are sent once, with the number of places (2 for more), and the header
    lists which windows they stand for; so a passage that fills the input costs a row per chunk.
    """

    def __init__(self, buckets: int, task: int, pack):
        self.buckets, self.pack, self.next = buckets, pack, task << 32
        self.held: list = []
        self.size = 0

    def add(self, k1: int, k2: int, start: int, keys: tuple[np.ndarray, ...], aligned: np.ndarray, copies: int):
        """Windows start, start + 1, ... of a document; yields rows of chunks that got full."""
        for at in range(0, len(aligned), CHUNK):
            cut = slice(at, at + CHUNK)
            n = len(aligned[cut])
            if self.size + n > CHUNK:
                yield from self.flush()
            self.held.append((k1, k2, start + at, n, (*(k[cut] for k in keys), aligned[cut], np.full(n, copies, np.uint8))))
            self.size += n

    def flush(self):
        if not self.held:
            return
        chunk, self.next = self.next, self.next + 1
        segments = np.array([h[:4] for h in self.held], SEGMENT)
        *keys, aligned, copies = (np.concatenate([h[4][i] for h in self.held]) for i in range(len(self.held[0][4])))
        self.held, self.size = [], 0
        order = np.lexsort(keys[::-1])
        fresh = np.zeros(len(order), bool)
        fresh[0] = True
        for k in keys:
            fresh[1:] |= k[order][1:] != k[order][:-1]
        starts = np.flatnonzero(fresh)
        first = order[starts]
        twins = np.stack((order[~fresh], first[np.cumsum(fresh) - 1][~fresh])).astype("<u2")
        yield (-1 - (chunk ^ chunk >> 32) % 4096, chunk, np.array([len(segments)], "<u4").tobytes() + segments.tobytes() + twins.tobytes())
        aligned = np.logical_or.reduceat(aligned[order], starts)
        copies = np.minimum(2, np.add.reduceat(copies[order], starts, dtype=np.int64)).astype(np.uint8)
        keys = [k[first] for k in keys]
        bucket = ((keys[0] >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            at = order[cut[b] : cut[b + 1]]
            yield (int(b), chunk, self.pack(first[at].astype("<u2"), *(k[at] for k in keys), aligned[at], copies[at]))


def header_places(header: bytes, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segments, places): a chunk's hits with the equal windows they stand for, sorted."""
    n = int(np.frombuffer(header, "<u4", 1)[0])
    segments = np.frombuffer(header, SEGMENT, n, 4)
    twins = np.frombuffer(header, "<u2", -1, 4 + n * SEGMENT.itemsize).reshape(2, -1)
    mask = np.zeros(int(segments["n"].sum()), bool)
    mask[hits] = True
    mask[twins[0]] = mask[twins[1]]
    return segments, np.flatnonzero(mask)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    n = len(rows)
    full = {"bucket": [r[0] for r in rows], "chunk": [r[1] for r in rows], "data": [r[2] for r in rows]}
    return pa.RecordBatch.from_pydict(full | {name: [None] * n for name in ("doc_id", "k1", "k2", "n_words", "sha")}, schema=ROW)


def _anchors(buckets: int, length: int, block: int):
    """Map side of step 1: one row per document, chunk headers, and packed windows per bucket."""

    def pack(at, w, aligned, copies):
        order = np.argsort(~aligned, kind="stable")
        sizes = np.array([len(at), aligned.sum()], "<u4").tobytes()
        return sizes + (w[order] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + at[order].tobytes() + np.packbits(copies[order] > 1).tobytes()

    def run(batches):
        roll = Rolling(MULTIPLIERS[0])
        chunks = Chunks(buckets, TaskContext.get().partitionId(), pack)
        count = 0
        for batch in batches:
            for part in slices(batch):
                ids, k1s, k2s, texts = (part.column(i).to_pylist() for i in range(4))
                rows: list[tuple] = []
                words_of, shas = [], []
                for k1, k2, text in zip(k1s, k2s, texts):
                    words = split_words(text)
                    words_of.append(len(words))
                    shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    if len(words) >= length:
                        w = roll.windows(word_hashes(words), block)
                        rows += chunks.add(k1, k2, 0, (w,), np.arange(len(w)) % block == 0, 1)
                n = len(ids)
                count += n
                yield pa.RecordBatch.from_pydict({"bucket": [-1 - (count + i) % 4096 for i in range(n)], "chunk": [None] * n, "data": [None] * n, "doc_id": ids, "k1": k1s, "k2": k2s, "n_words": words_of, "sha": shas}, schema=ROW)
                if rows:
                    yield _batch(rows)
        if rows := list(chunks.flush()):
            yield _batch(rows)

    return run


def _whole(batches) -> tuple[pa.Table | None, list]:
    """Window rows of a task as one table, and the batches of header and document rows."""
    own, rest = [], []
    for batch in batches:
        mask = pc.greater_equal(batch.column(0), 0)
        own.append(batch.filter(mask))
        rest.append(batch.filter(pc.invert(mask)))
    return (pa.Table.from_batches(own) if own else None), rest


def _answer(chunks: list[int], places: list[np.ndarray]) -> pa.RecordBatch:
    return _batch([(0, c, p.astype("<u2").tobytes()) for c, p in zip(chunks, places)])


def _by_row(hit: np.ndarray, sizes: list[int], at: list[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum(sizes)
    return [a[hit[e - s : e]] for s, e, a in zip(sizes, ends, at)]


def _probe(batches):
    """Reduce side of step 1: (chunk, places) of windows whose hash is a block's and occurs twice."""
    table, rest = _whole(batches)
    yield from rest
    if table is None or not table.num_rows:
        return
    buckets, chunk_ids, data = (table.column(i).to_pylist() for i in range(3))
    keys, marks, sizes, at, twice = [], [], [], [], []
    for bucket, blob in zip(buckets, data):
        n, aligned = map(int, np.frombuffer(blob, "<u4", 2))
        keys.append(np.frombuffer(blob, "<u4", n, 8).astype(np.uint64) | np.uint64(bucket << 32))
        mark = np.zeros(n, bool)
        mark[:aligned] = True
        marks.append(mark)
        sizes.append(n)
        at.append(np.frombuffer(blob, "<u2", n, 8 + 4 * n))
        twice.append(np.unpackbits(np.frombuffer(blob, np.uint8, -1, 8 + 6 * n), count=n))
    key, mark, copies = np.concatenate(keys), np.concatenate(marks), np.concatenate(twice) + 1.0
    del keys, data
    index = np.unique(key[mark])
    if not len(index):
        return
    place = np.minimum(np.searchsorted(index, key), len(index) - 1)
    found = index[place] == key
    total = np.bincount(place[found], copies[found], minlength=len(index))
    hit = found & (total[place] >= 2)
    places = _by_row(hit, sizes, at)
    keep = [i for i, p in enumerate(places) if len(p)]
    for s in range(0, len(keep), 5000):
        yield _answer([chunk_ids[i] for i in keep[s : s + 5000]], [places[i] for i in keep[s : s + 5000]])


def _places(rows: DataFrame) -> DataFrame:
    """(k1, k2, at): word positions of each document's hits, from answers and chunk headers."""
    answers = rows.filter("chunk is not null").select("chunk", "bucket", "data")

    def run(batches):
        header, chunk, hits = None, None, []

        def close():
            if chunk is None or not hits:
                return
            seg, place = header_places(header, np.concatenate([np.frombuffer(h, "<u2") for h in hits]))
            ends = np.cumsum(seg["n"])
            which = np.searchsorted(ends, place, side="right")
            cut = np.flatnonzero(np.diff(which)) + 1
            for s, e in zip(np.append(0, cut), np.append(cut, len(place))):
                i = which[s]
                at = place[s:e] - (ends[i] - seg["n"][i]) + seg["start"][i]
                yield int(seg["k1"][i]), int(seg["k2"][i]), int(seg["start"][i]), at.astype("<u4").tobytes()

        def flush(out):
            return pa.RecordBatch.from_pydict({"k1": [r[0] for r in out], "k2": [r[1] for r in out], "start": [r[2] for r in out], "at": [r[3] for r in out]}, schema=pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("at", pa.binary())]))

        out: list = []
        for batch in batches:
            for c, b, d in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if c != chunk:
                    out += close()
                    header, chunk, hits = None, c, []
                if b < 0:
                    header = d
                else:
                    hits.append(d)
            if len(out) > 2000:
                yield flush(out)
                out = []
        out += close()
        yield flush(out)

    dealt = answers.repartition("chunk").sortWithinPartitions("chunk", "bucket")
    pieces = dealt.mapInArrow(run, "k1 long, k2 long, start long, at binary")
    once = pieces.groupBy("k1", "k2", "start").agg(F.max("at").alias("at"))
    return once.groupBy("k1", "k2").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", F.hex("at").alias("at")))), lambda x: x["at"]), "").alias("at"))


def _extend(buckets: int, length: int, block: int):
    """Map side of step 2: all windows of the full length over a hit, by 96 bits of hash."""

    def pack(at, high, low, _, copies):
        return np.array([len(at)], "<u4").tobytes() + high.astype("<u8").tobytes() + low.astype("<u4").tobytes() + at.tobytes() + copies.tobytes()

    def run(batches):
        rolls = [Rolling(m) for m in MULTIPLIERS[1:]]
        chunks = Chunks(buckets, TaskContext.get().partitionId(), pack)
        for batch in batches:
            for part in slices(batch):
                rows: list[tuple] = []
                for k1, k2, text, copies, at in zip(*(part.column(i).to_pylist() for i in range(5))):
                    words = word_hashes(split_words(text))
                    if len(words) < length:
                        continue
                    n = len(words) - length + 1
                    near = covered(np.frombuffer(bytes.fromhex(at), "<u4").astype(np.int64) - (length - block), length - block + 1, n)
                    high, low = (r.windows(words, length) for r in rolls)
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], near.view(np.int8), [0]))))
                    for s, e in zip(edge[::2], edge[1::2]):
                        rows += chunks.add(k1, k2, int(s), (high[s:e], low[s:e]), np.zeros(e - s, bool), min(copies, 2))
                if rows:
                    yield _batch(rows)
        if rows := list(chunks.flush()):
            yield _batch(rows)

    return run


def _repeats(batches):
    """Reduce side of step 2: (chunk, places) of windows at two places or more."""
    table, rest = _whole(batches)
    yield from rest
    if table is None or not table.num_rows:
        return
    _, chunk_ids, data = (table.column(i).to_pylist() for i in range(3))
    highs, lows, weights, sizes, at = [], [], [], [], []
    for blob in data:
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        highs.append(np.frombuffer(blob, "<u8", n, 4))
        lows.append(np.frombuffer(blob, "<u4", n, 4 + 8 * n))
        at.append(np.frombuffer(blob, "<u2", n, 4 + 12 * n))
        weights.append(np.frombuffer(blob, np.uint8, n, 4 + 14 * n))
        sizes.append(n)
    high, low, weight = np.concatenate(highs), np.concatenate(lows), np.concatenate(weights)
    del highs, lows, data
    order = np.lexsort((low, high))
    h, w = high[order], low[order]
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])))
    group = np.cumsum(fresh) - 1
    total = np.bincount(group, weight[order])
    hit = np.zeros(len(high), bool)
    hit[order] = total[group] >= 2
    places = _by_row(hit, sizes, at)
    keep = [i for i, p in enumerate(places) if len(p)]
    for s in range(0, len(keep), 5000):
        yield _answer([chunk_ids[i] for i in keep[s : s + 5000]], [places[i] for i in keep[s : s + 5000]])


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in [start, start + length) of some start; starts may be negative."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.clip(starts, 0, n), 1)
    np.add.at(step, np.clip(starts + length, 0, n), -1)
    return np.cumsum(step[:n]) > 0


def repeated_words(df: DataFrame, length: int = LENGTH, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, cuts): per row doc_id, k1, k2, n_words, sha of its words; and per text with
    repeats k1, k2, n_removed, kept_sha256 and kept (the words left, joined by a space)."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    block = (length + 1) // 2
    text = F.coalesce(df["text"].cast("string"), F.lit(""))
    source = df.select(df["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(17), text).alias("k2"), text.alias("text"))
    chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))
    anchored = source.mapInArrow(_anchors(buckets, length, block), ROW_SQL).repartitionById(buckets, "bucket")
    first = scratch.table(anchored.mapInArrow(_probe, ROW_SQL))
    places = _places(first)
    texts = source.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    hit = scratch.table(texts.join(places, ["k1", "k2"]).select("k1", "k2", "text", F.least("copies", F.lit(2)).alias("copies"), "at"))
    extended = hit.mapInArrow(_extend(buckets, length, block), ROW_SQL).repartitionById(buckets, "bucket")
    second = scratch.table(extended.mapInArrow(_repeats, ROW_SQL))
    final = hit.select("k1", "k2", "text").join(_places(second), ["k1", "k2"])
    out = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                k1, k2, texts, at = (part.column(i) for i in range(4))
                removed, shas, kept = [], [], []
                for t, a in zip(texts.to_pylist(), at.to_pylist()):
                    words = split_words(t)
                    gone = covered(np.frombuffer(bytes.fromhex(a), "<u4").astype(np.int64), length, len(words))
                    left = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                    removed.append(int(gone.sum()))
                    shas.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.decode())
                yield pa.RecordBatch.from_pydict({"k1": k1, "k2": k2, "n_removed": removed, "kept_sha256": shas, "kept": kept}, schema=out)

    cuts = final.mapInArrow(cut, "k1 long, k2 long, n_removed long, kept_sha256 string, kept string")
    return first.filter("sha is not null").select("doc_id", "k1", "k2", "n_words", "sha"), cuts


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    documents, cuts = repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch=scratch)
    digest = scratch.table(cuts.drop("kept"))
    return documents.join(digest, ["k1", "k2"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


#: The rule on the words themselves: windows of 35 words by the digest of their words, which hold no space.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
p AS (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
s AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
again AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
starts AS (SELECT r, i, i AS begin_at FROM s SEMI JOIN again USING (h)),
m AS (SELECT k.r, k.i, word, max(begin_at) OVER (PARTITION BY k.r ORDER BY k.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM k LEFT JOIN starts ON starts.r = k.r AND starts.i = k.i),
t AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""
