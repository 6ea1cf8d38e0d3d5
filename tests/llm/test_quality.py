import math
import re
from collections import Counter, defaultdict

import numpy as np

from quillon.llm import quality


def brute_repeats(words):
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            hit |= {k, k + 1, k + 2}
    return len(hit)


def test_base_counts_equal_brute_force(documents):
    rows = {r["doc_id"]: r for r in quality.quality_verdicts(documents).collect()}
    for doc_id, text in documents.select("doc_id", "text").collect():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        r = rows[doc_id]
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if line.strip(" \t\n\r\x0b\x0c"):
                dup += line in seen
                seen.add(line)
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), dup, brute_repeats(words))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["base_failed"] == (len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])


MARKS = ".,;:!?\"'()[]{}-_/\\@+=~^`#*$%&|<>"


def lowered_words(text):
    """ASCII-lowered words without surrounding ASCII punctuation."""
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w).strip(MARKS) for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def char_class(c):
    if ord(c) > 127:
        return 7
    if c.isalpha():
        return 0 if c.islower() else 1
    if c.isdigit():
        return 2
    if c in " \t\n\r\x0b\x0c":
        return 3
    if ord(c) < 32 or ord(c) == 127:
        return 6
    return 5 if c in "#*$%&|<>@+=~^`\\_{}[]/" else 4


def brute_reference(rows):
    """Per language: classes of passing texts, common words of all texts with their counts in passing ones."""
    every, passing, classes = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        every[lang or ""].update(lowered_words(text))
        if len(words) >= 50 and 100 * brute_repeats(words) <= 50 * len(words):
            passing[lang or ""].update(lowered_words(text))
            classes[lang or ""].update(map(char_class, text))
    out = {}
    for lang in classes:
        total = every[lang].total()
        common = {w: passing[lang][w] for w, n in every[lang].items() if w and 256 * n >= total}
        out[lang] = ([classes[lang][k] for k in range(8)], {**common, "": passing[lang].total() - sum(common.values())})
    return out


def brute_distance(p, q):
    def entropy(x):
        return -sum(v * math.log2(v) for v in x if v > 0)

    p, q = [v / sum(p) for v in p], [v / sum(q) for v in q]
    return math.sqrt(max(0, entropy([(a + b) / 2 for a, b in zip(p, q)]) - (entropy(p) + entropy(q)) / 2))


def test_reference_and_verdicts_equal_brute_force(documents):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()]
    want = brute_reference([r[1:] for r in rows])
    got = quality.language_reference(documents)
    assert got.keys() == want.keys()
    for lang, (classes, words) in got.items():
        assert classes.tolist() == want[lang][0] and {w.decode(): n for w, n in words.items()} == want[lang][1]
    judged = {r["doc_id"]: r for r in quality.quality_verdicts(documents).collect()}
    for doc_id, text, lang in rows:
        r = judged[doc_id]
        classes, words = want[lang]
        if r["n_words"] < 50:
            assert r["char_distance"] == r["word_distance"] == 0
            continue
        hist = Counter(w if w in words else "" for w in lowered_words(text))
        chars = Counter(map(char_class, text))
        c = brute_distance([chars[k] for k in range(8)], classes)
        w = brute_distance([hist[k] for k in words], list(words.values()))
        assert abs(r["char_distance"] - c) < 1e-6 and abs(r["word_distance"] - w) < 1e-6
        fine = c <= 0.26 + 0.4 / math.sqrt(r["n_words"]) and (r["n_words"] < 100 or w <= 0.22 + 1.4 / math.sqrt(r["n_words"]))
        assert r["kept"] == (fine and not r["base_failed"])


def test_verdicts_do_not_depend_on_partitions(documents, monkeypatch):
    extra = documents.limit(40).selectExpr("doc_id + 100000 AS doc_id", "concat('rare ', repeat('rare ', 30), text) AS text", "lang", "source", "n_chars")
    df = documents.unionByName(extra)
    listed = lambda d: sorted(map(str, quality.quality_verdicts(d).collect()))
    whole = listed(df.repartition(1))
    assert listed(df.repartition(7)) == whole
    monkeypatch.setattr(quality, "LANGUAGES", 2)
    assert quality.language_blocks(df) > 1 and listed(df) == whole


def test_divergent_documents_go_and_clean_ones_stay(spark, make):
    prose = "the cat and the dog of a house in the town with a garden for them to see and be by it is was that not on as "
    clean = [(k, " ".join(prose.split()[k % 7 :] + [f"{a}{b}x" for a in "qwertyuiop" for b in "asdfghj"])) for k in range(60)]
    junk = [(100, " ".join(w + "$$$&&&%%%" for w in clean[0][1].split())), (101, "short"), (102, None), (None, "a b c " * 100)]
    rows = {r["doc_id"]: r for r in quality.quality_verdicts(make(clean + junk)).collect()}
    assert all(rows[k]["kept"] for k, _ in clean)
    assert not any(rows[k]["kept"] for k in (100, 101, 102, None))
    kept = quality.quality_verdicts(make(clean + junk), carry=True)
    assert kept.columns == make([]).columns and {r["doc_id"] for r in kept.collect()} == {k for k, _ in clean}


def test_edges(make):
    assert quality.quality_verdicts(make([])).count() == 0
    got = quality.quality_verdicts(make([(1, "", None, None, None), (1, "w " * 100_000, None, None, None)])).collect()
    assert sorted(r["n_words"] for r in got) == [0, 100_000]
    assert quality.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1.0
