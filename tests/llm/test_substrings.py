import hashlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import substrings


def brute(rows, length):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + length]) for _, w in docs for k in range(len(w) - length + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(df, length):
    documents, cuts = substrings.repeated_words(df, length)
    got = documents.join(cuts.drop("kept"), ["k1", "k2"], "left").collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"] or 0, r["kept_sha256"] or r["sha"]) for r in got), key=str)


def test_documents_equal_brute_force(documents):
    assert run(documents, 35) == brute([tuple(r) for r in documents.select("doc_id", "text").collect()], 35)


@pytest.mark.parametrize("length", [2, 5, 6])
def test_small_alphabet_and_edges(make, length):
    rng = np.random.default_rng(length)
    rows = [(i, " ".join(rng.choice(list("abcdef"), rng.integers(0, 40)))) for i in range(40)]
    rows += [(1, None), (1, None), (None, "a b c d e f a b c d e f"), (99, ""), (98, "same text twice here now ok"), (97, "same text twice here now ok"), (96, "same text  twice here now ok")]
    df = make(rows)
    assert run(df, length) == brute(rows, length)


def test_chunk_borders_and_long_texts(make, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 50)
    rng = np.random.default_rng(0)
    words = [str(x) for x in rng.integers(0, 10**6, 3000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1000:1200])), (3, " ".join(words[2990:] + words[:30]))]
    assert run(make(rows), 12) == brute(rows, 12)


def test_empty_table(make):
    assert run(make([]), 35) == []
