"""Near-dedup of the pipeline: of texts that share most of their word shingles, one stays.

Texts are linked if the Jaccard similarity of their sets of k-word shingles is ``similarity`` or more;
a group is what links connect, and its row of the smallest doc_id stays. Texts with the same set are
one from the start, texts without words are one set.

1. Candidates are the links of the SimHash operator (simhash.py, over the same k-word shingles), found by
   the generalised pigeonhole principle. They are not enough: two texts of similarity 0.8 differ in
   about 10 of 64 bits, and a search that wide meets unrelated texts by the square of the corpus. So
   texts that share a band of their MinHash signatures are candidates too; ``BANDS`` bands of
   ``BAND_ROWS`` miss a pair of similarity 0.8 with a probability of 3e-6.
2. A bucket's centre is its member with the most company in all its buckets. Every member is compared
   with its buckets' centres, on all shingles. That joins copies of one text in work that grows with
   their number.
3. Buckets whose members are still in several components are gathered into groups that share members.
   A group is cut into tiles by texts and shingles, and a pair of tiles is a unit of work: texts of
   different components are compared on all their shingles, if their signatures agree in at least
   ``LIKELY`` of their places, which a pair of similarity 0.8 misses with a probability of 4e-6.
4. Components of all links come from star contraction (graph.py).

Null text: no words. Null ids: kept; a component without ids keeps its first row, of repeated ids the
first row stays. Very long texts are read whole, one at a time. An empty table gives no rows. Extra
columns are carried along, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quillon.llm.common import Scratch, mapped
from quillon.llm.graph import components
from quillon.llm.simhash import links, shingles, simhash

BANDS, BAND_ROWS = 32, 5
XORS, ODDS = (np.random.default_rng(s).integers(0, 2**64, BANDS * BAND_ROWS, np.uint64) | np.uint64(o) for s, o in ((1, 0), (2, 1)))
LIKELY = 0.66
TILE_TEXTS, TILE_SHINGLES = 512, 1_000_000
#: Rows whose ids are broadcast at most; more are joined by sort-merge.
FEW = 500_000
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def signature(distinct: np.ndarray) -> np.ndarray:
    """MinHash values of a set of shingle hashes."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(distinct), 4096):
        least = np.minimum(least, ((distinct[None, at : at + 4096] ^ XORS[:, None]) * ODDS[:, None]).min(1))
    return least


def band_keys(distinct: np.ndarray) -> np.ndarray:
    """A key per band of the signature, which also tells the band."""
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(signature(distinct).reshape(BANDS, BAND_ROWS))], np.uint64)


def described(df: DataFrame, k: int) -> DataFrame:
    """Rows of (row, rid, doc_id, cls, fp, bands): each input row with what its text's shingles give."""
    text_at, id_at = df.columns.index("text"), df.columns.index("doc_id")
    source = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("rid"))
    bands = pa.list_(pa.int64())
    added = [("doc_id", pa.int64()), ("cls", pa.int64()), ("fp", pa.int64()), ("bands", bands)]

    def add(batches):
        for batch in batches:
            texts, ids = (batch.column(0).field(i) for i in (text_at, id_at))
            cls, fps, keys = [], [], []
            for at in range(0, batch.num_rows, 256):
                for t in texts.slice(at, 256).cast(pa.string()).to_pylist():
                    hashes = shingles(t, k)
                    distinct = np.unique(hashes)
                    cls.append(xxhash.xxh64_intdigest(distinct.tobytes()))
                    fps.append(simhash(hashes))
                    keys.append(band_keys(distinct).view(np.int64) if len(distinct) else [])
            columns = [pc.cast(ids, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (cls, fps)), pa.array(keys, bands)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=pa.schema([*batch.schema, *(pa.field(n, t) for n, t in added)]))

    longs = [StructField(n, LongType()) for n in ("doc_id", "cls", "fp")]
    return source.mapInArrow(add, StructType([*source.schema.fields, *longs, StructField("bands", ArrayType(LongType()))]))


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar; sets (cls, set)."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("all"))
    return both.filter(F.col("n") >= similarity * (F.col("all") - F.col("n")) - 1e-9).select("a", "b")


def tile_links(sets: list[np.ndarray], comps: list[int], side: list[bool] | None, similarity: float) -> list[tuple[int, int]]:
    """Places of similar sets of different components, a spanning forest of them.

    With ``side`` only sets of different sides are compared.
    """
    n = len(sets)
    signatures = np.array([signature(s) & np.uint64(255) for s in sets], np.uint8).reshape(n, -1)
    sizes = np.array([len(s) for s in sets])
    root = np.unique(np.array(comps, np.int64), return_inverse=True)[1]
    sides = np.zeros(n, bool) if side is None else np.array(side)
    held: dict[int, frozenset] = {}
    out = []
    for a in range(n):
        later = np.arange(n) > a if side is None else (sides != sides[a]) & ~sides[a]
        near = later & (root != root[a]) & (np.minimum(sizes, sizes[a]) >= similarity * np.maximum(sizes, sizes[a]) - 1e-9)
        near = np.flatnonzero(near)
        if not len(near):
            continue
        near = near[(signatures[near] == signatures[a]).mean(1) >= LIKELY]
        for b in near.tolist():
            if root[a] == root[b]:
                continue
            x, y = (held.setdefault(k, frozenset(sets[k].tolist())) for k in (a, b))
            same = len(x & y)
            if same >= similarity * (len(x) + len(y) - same) - 1e-9:
                out.append((a, b))
                root[root == root[b]] = root[a]
    return out


def remaining(scratch: Scratch, member: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between components of one bucket; member (key, cls, centre), roots (cls, root)."""
    named = scratch.table(member.join(roots, "cls", "left").select("key", "cls", "centre", F.coalesce("root", "cls").alias("root")))
    mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    mixed = scratch.table(named.join(mixed, "key", "left_semi"))
    groups = components(scratch, mixed.select(F.col("cls").alias("a"), F.col("centre").alias("b"))).withColumnRenamed("node", "cls").withColumnRenamed("root", "grp")
    rows = groups.join(mixed.select("cls", "root").distinct(), "cls").join(sets, "cls").select("grp", "cls", "root", "set")
    rows = scratch.table(rows)
    tiles = F.ceil(F.greatest(F.count("*") / TILE_TEXTS, F.sum(F.size("set")) / TILE_SHINGLES)).cast("int")
    tiles = scratch.table(rows.groupBy("grp").agg(tiles.alias("tiles")))
    mine = F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")
    rows = rows.join(tiles, "grp").select("grp", "cls", "root", "set", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    rows = rows.select("grp", F.least("mine", "other").alias("ta"), F.greatest("mine", "other").alias("tb"), "mine", "cls", "root", "set")

    def verify(batches):
        now, held = None, []

        def found():
            if len(held) < 2:
                return [], []
            cls, tile, roots, sets = zip(*held)
            side = None if now[1] == now[2] else [t == now[2] for t in tile]
            pairs = tile_links(list(sets), list(roots), side, similarity)
            return [cls[i] for i, _ in pairs], [cls[j] for _, j in pairs]

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            values = zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), batch.column(5).to_pylist())
            lists = batch.column(6)
            for k, (key, (cls, tile, root)) in enumerate(zip(keys, values)):
                if key != now:
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found()], schema=PAIR)
                    now, held = key, []
                held.append((cls, tile, root, lists[k].values.to_numpy().view(np.uint64)))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found()], schema=PAIR)

    return rows.repartition("grp", "ta", "tb").sortWithinPartitions("grp", "ta", "tb").mapInArrow(verify, "a long, b long")


def similar_classes(scratch: Scratch, rows: DataFrame, k: int, similarity: float, distance: int) -> DataFrame:
    """(cls, root) of the texts with a link; rows (rid, cls, fp, bands, text)."""
    classes = scratch.table(rows.groupBy("cls").agg(F.min("rid").alias("rid"), F.min("fp").alias("fp"), F.first("bands").alias("bands")))
    # candidates of the SimHash operator: its links, and texts of one fingerprint
    least = scratch.table(classes.groupBy("fp").agg(F.min("cls").alias("of_fp")))
    wide = links(scratch, least.select("fp"), distance)
    for c in ("a", "b"):
        wide = wide.join(least.select(F.col("fp").alias(c), F.col("of_fp").alias(f"of_{c}")), c)
    near = wide.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).unionByName(classes.join(least, "fp").select(F.col("cls").alias("a"), F.col("of_fp").alias("b")))
    # candidates of the bands
    keys = classes.select("cls", F.explode("bands").alias("key"))
    shared = scratch.table(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    member = scratch.table(keys.join(shared, "key"))
    company = scratch.table(member.groupBy("cls").agg(F.sum("n").alias("company")))
    centre = scratch.table(member.join(company, "cls").groupBy("key").agg(F.max_by("cls", F.struct("company", "cls")).alias("centre")))
    member = scratch.table(member.join(centre, "key").select("key", "cls", "centre"))
    near = near.unionByName(member.select(F.col("cls").alias("a"), F.col("centre").alias("b"))).filter("a <> b")
    pairs = scratch.table(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    need = pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(member.select("cls")).distinct()
    # by row, not by class: a class may be a third of all rows
    wanted = scratch.table(classes.select("cls", "rid").join(need, "cls"))
    few = wanted.count() <= FEW
    texts = rows.select("rid", "text").join(F.broadcast(wanted) if few else wanted, "rid").select("cls", "text")
    arrow = pa.schema([("cls", pa.int64()), ("set", pa.list_(pa.int64()))])
    sets = scratch.table(mapped(texts, lambda part: {"cls": part.column(0), "set": [np.unique(shingles(t, k)).view(np.int64) for t in part.column(1).to_pylist()]}, "cls long, set array<long>", arrow))
    edges = scratch.table(compared(pairs, sets, similarity))
    roots = components(scratch, edges).withColumnRenamed("node", "cls")
    edges = edges.unionByName(remaining(scratch, member, scratch.table(roots), sets, similarity))
    return components(scratch, edges).withColumnRenamed("node", "cls")


def near_deduplicated(df: DataFrame, k: int = 5, similarity: float = 0.8, distance: int = 4) -> DataFrame:
    """The row of the smallest doc_id of each group, unchanged, with the input's columns.

    Rows are written once with a number, so that each later read sees the same rows.
    """
    scratch = Scratch(df.sparkSession)
    rows = scratch.table(described(df, k))
    roots = similar_classes(scratch, rows.select("rid", "cls", "fp", "bands", F.col("row.text").cast("string").alias("text")), k, similarity, distance)
    named = scratch.table(rows.select("doc_id", "rid", "cls").join(scratch.table(roots), "cls", "left").select("doc_id", "rid", F.coalesce("root", "cls").alias("root")))
    first = named.groupBy("root").agg(F.min_by("rid", F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first"))
    gone = scratch.table(named.select("rid").join(first.select(F.col("first").alias("rid")), "rid", "left_anti"))
    few = gone.count() <= FEW
    return rows.join(F.broadcast(gone) if few else gone.hint("merge"), "rid", "left_anti").select("row.*")
