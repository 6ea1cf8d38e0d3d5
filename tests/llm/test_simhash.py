import re

import numpy as np
import xxhash

from quillon.llm import neardedup, simhash
from quillon.llm.common import Scratch
from quillon.llm.graph import components


def brute_fingerprint(text, k=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(pairs, distance=4):
    """component_id per (doc_id, fingerprint) by union of all pairs."""
    fps = sorted({f for _, f in pairs})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    u = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(u[i] ^ u) <= distance):
            parent[find(f)] = find(fps[j])
    least = {}
    for d, f in pairs:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return {(d, f): least.get(find(f)) for d, f in pairs}


def check(df):
    rows = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicate_classes(df).collect()]
    want = classes_of([(d, int(f, 16)) for d, f, _ in rows])
    assert all(want[(d, int(f, 16))] == c for d, f, c in rows)
    return rows


def test_documents_equal_brute_force(documents):
    rows = check(documents)
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for d, f, _ in rows[:60]:
        assert f == f"{brute_fingerprint(texts[d]):016x}"


def test_edges(make):
    rows = check(make([(5, None), (3, ""), (3, ""), (None, " \t"), (1, "one two"), (1, "One TWO"), (9, "z " * 70_000), (None, "q r s t u v")]))
    found = sorted((d if d is not None else -1, c) for d, f, c in rows if f == "0" * 16)
    assert found == [(-1, 3), (3, 3), (3, 3), (5, 3)]
    assert [c for d, _, c in rows if d is None and c is None] == [None]
    assert simhash.near_duplicate_classes(make([])).count() == 0


def test_links_in_hot_tiles_and_skewed_bits(spark, monkeypatch):
    """A group much larger than a tile, in buckets that share most bits."""
    monkeypatch.setattr(simhash, "TILE", 64)
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 63))
    fps = {base}
    while len(fps) < 600:
        x = int(rng.choice(list(fps))) if rng.random() < 0.5 else base
        for b in rng.integers(0, 64, rng.integers(1, 7)):
            x ^= 1 << int(b)
        fps.add(x & (1 << 64) - 1)
    signed = [int(np.uint64(f).astype(np.int64)) for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    scratch = Scratch(spark)
    got = dict(components(scratch, simhash.links(scratch, scratch.table(df), 4)).collect())
    want = classes_of([(i, f) for i, f in enumerate(sorted(fps))])
    by_root = {}
    for i, f in enumerate(sorted(fps)):
        by_root.setdefault(got.get(signed[i], signed[i]), set()).add(want[(i, f)])
    assert all(len(x) == 1 for x in by_root.values()) and len(by_root) == len(set(want.values()))


def test_thresholds_follow_the_pigeonhole(spark):
    df = spark.createDataFrame([(int(x),) for x in np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 2000)], "fp long")
    for m in (1, 2, 3, 4, 5):
        groups = simhash.group_bits(df, m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        if m > 1:
            assert sum(t + 1 for t in simhash.allocate(df, groups, 4)) >= 5


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = dict(components(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}
    assert components(Scratch(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def test_stage_keeps_the_first_of_each_group(make):
    df = make([(2, "a b c d e f g"), (1, "A b c d e f g"), (1, "A b c d e f g"), (3, "other words stand in this text"), (None, "alone here with no id at all"), (4, None), (5, "")])
    out = neardedup.near_deduplicated(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 1, 3, 4]
    assert neardedup.near_deduplicated(make([])).count() == 0


def test_stage_drops_pairs_of_similarity_080(make):
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows, sets = [], {}
    for k in range(60):
        base = words(120)
        other = list(base)
        for at in rng.choice(120, 1 + k % 6, replace=False):
            other[at] = "changed"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    near = {2 * k + 1 for k in range(60) if len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1])}
    kept = {r["doc_id"] for r in neardedup.near_deduplicated(make(rows)).collect()}
    assert 10 < len(near) < 50 and kept == {i for i, _ in rows} - near


def near_rows(n, rng, change):
    """Copies of one text with a few words changed in each, and what similarity 0.8 makes of them."""
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    rows = []
    for k in range(n):
        words = list(base)
        for at in rng.choice(150, 1 + k % change, replace=False):
            words[at] = f"c{k}"
        rows.append((k, " ".join(words)))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(146)} for _, t in rows]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same >= 0.8 * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return rows, {find(k) for k in range(n)}


def test_stage_joins_a_group_as_all_pairs_do(make, monkeypatch):
    """A group that falls into several components, in tiles much smaller than it."""
    monkeypatch.setattr(neardedup, "TILE_TEXTS", 16)
    monkeypatch.setattr(neardedup, "FEW", 5)
    rows, want = near_rows(150, np.random.default_rng(7), 9)
    kept = {r["doc_id"] for r in neardedup.near_deduplicated(make(rows)).collect()}
    assert kept == want and 3 < len(want) < 140


def test_tile_links_are_a_forest_of_all_links():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(rng.choice(pool[(k // 6) * 20 : (k // 6) * 20 + 130], 120, replace=False)) for k in range(60)]
    for side in (None, [k % 2 == 0 for k in range(60)]):
        got = neardedup.tile_links(sets, list(range(60)), side, 0.8)
        near = [(a, b) for a in range(60) for b in range(a) if (side is None or side[a] != side[b]) and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
        classes = []
        for edges in (got, near):
            root = list(range(60))
            for a, b in edges:
                x, y = root[a], root[b]
                root = [x if r == y else r for r in root]
            classes.append({frozenset(i for i in range(60) if root[i] == r) for r in root})
        assert classes[0] == classes[1] and len(got) == 60 - len(classes[0]) and near


def test_wide_distances_find_all_links(spark):
    rng = np.random.default_rng(4)
    fps = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 40)]
    fps += [f ^ sum(1 << int(b) for b in rng.choice(62, 16, replace=False)) for f in fps[:20]]
    scratch = Scratch(spark)
    got = dict(components(scratch, simhash.links(scratch, scratch.table(spark.createDataFrame([(f,) for f in fps], "fp long")), 16)).collect())
    assert all(got[fps[k]] == got[fps[40 + k]] for k in range(20))
