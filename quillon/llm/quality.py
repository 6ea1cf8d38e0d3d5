"""Quality rules by distribution divergence.

Every document gives two histograms: character classes (lower, upper, digit, space, ASCII
punctuation, ASCII symbol, control, non-ASCII) and the common words of its language with one rest
class. A language's reference is the sum of these histograms over all its documents that pass the
base rules, and its common words are all words (ASCII-lowered, without surrounding ASCII
punctuation) that hold at least 1/256 of the language's words in the whole corpus.
A document is rejected if it fails a base rule or if the Jensen-Shannon distance (base 2, 0 to 1)
of a histogram from the reference exceeds its threshold, level + noise / sqrt(words). Short documents are guarded: the word
histogram is only judged from ``MIN_WORDS_FOR_WORDS`` words on, the character histogram from 50.

The reference is found exactly in two passes. Each batch reports the words that hold 1/2048 of its
words in a language; a word whose reported counts plus the most it can have in the other batches
stay below 1/256 of the language cannot be common. The second pass counts the words that are left
over the whole corpus, and only these counts decide, so the reference does not depend on how rows are
dealt to partitions. At most 256 words a language are common. Languages are taken in blocks of
``LANGUAGES`` (by hash of the name), each with its own reference and pass, so the driver and the
tasks hold a bounded table however many different values ``lang`` has.

Null text: no words, base_failed. Null language: the language "". A language without passing
documents has no reference, and its documents are judged by the base rules alone. Null ids, repeated
rows and ids: each row is judged, and each counts in the reference. Very long texts are read whole,
one at a time. Ties: a word of exactly 1/256 is common, a distance equal to its threshold passes. An
empty table gives no rows. Extra columns are ignored, or carried along with ``carry``.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, mapped, slices

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COMMON_SHARE = 1 / 256
REPORT_SHARE = COMMON_SHARE / 8
#: A threshold is a level plus a term for sampling noise, which falls with the root of the words.
CHAR_LEVEL, CHAR_NOISE = 0.26, 0.4
WORD_LEVEL, WORD_NOISE = 0.22, 1.4
MIN_WORDS_FOR_WORDS = 100
SYMBOLS = "#*$%&|<>"
#: Languages whose references are held at a time.
LANGUAGES = 1000
CLASS, PASSING, OTHER = 0, 1, 2
PUNCTUATION = b".,;:!?\"'()[]{}-_/\\@+=~^`#*$%&|<>"


def _class_table() -> np.ndarray:
    """Class of each UTF-8 byte; continuation bytes are class 8 and not counted."""
    t = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            t[b] = 8 if b < 0xC0 else 7
        elif c.islower():
            t[b] = 0
        elif c.isupper():
            t[b] = 1
        elif c.isdigit():
            t[b] = 2
        elif c in " \t\n\r\x0b\x0c":
            t[b] = 3
        elif b < 0x20 or b == 0x7F:
            t[b] = 6
        else:
            t[b] = 5 if c in "#*$%&|<>@+=~^`\\_{}[]/" else 4
    return t


CLASS_OF = _class_table()


def char_classes(data: bytes) -> np.ndarray:
    """Counts of the eight character classes in UTF-8 text."""
    return np.bincount(CLASS_OF[np.frombuffer(data, np.uint8)], minlength=9)[:8]


def normal_word(w: bytes) -> bytes:
    """A word as the histograms see it; the argument is already lower-cased."""
    return w.strip(PUNCTUATION)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pair = seq[:-1] * len(ids) + seq[1:]
    if len(ids) < 2_000_000:
        key = pair[:-1] * len(ids) + seq[2:]
    else:
        key = np.unique(pair, return_inverse=True)[1][:-1] * len(ids) + seq[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def base_counts(text: str, data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    seen: set[str] = set()
    dup = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(" \t\n\r\x0b\x0c"):
                seen.add(line)
    rep = repeated_words(words)
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\r\x0b\x0c")
    return n, chars, sum(text.count(c) for c in SYMBOLS), dup, rep, n < MIN_WORDS or 100 * rep > MAX_REPEAT_PERCENT * n


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of two count vectors; 0 where one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()) / 2
    return float(np.sqrt(max(d, 0.0)))


def _source(df: DataFrame) -> DataFrame:
    return df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("string").alias("text"), F.coalesce(df["lang"].cast("string"), F.lit("")).alias("lang"))


def language_blocks(df: DataFrame) -> int:
    """Blocks of at most about ``LANGUAGES`` different languages; one where there are no more than that."""
    n = _source(df).agg(F.approx_count_distinct("lang", 0.02)).first()[0]
    return 1 if n <= LANGUAGES else -(-2 * n // LANGUAGES)


def _of_block(df: DataFrame, lang: Column, block: int, blocks: int) -> DataFrame:
    return df if blocks == 1 else df.filter(F.pmod(F.xxhash64(F.coalesce(lang.cast("string"), F.lit(""))), F.lit(blocks)) == block)


def language_reference(df: DataFrame, scratch: Scratch | None = None) -> dict[str, tuple[np.ndarray, dict[bytes, int]]]:
    """Per language: character class counts, and count of each common word with b"" as the rest.

    Two passes over all rows; the driver gets per language a few hundred words and one histogram.
    """
    scratch = scratch or Scratch(df.sparkSession)
    source = _source(df).select("text", "lang")
    reported_schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64()), ("of", pa.int64())])
    counted_schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("kind", pa.int32()), ("n", pa.int64())])

    def rows_in(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    def report(batches):
        for batch in batches:
            counts: dict[str, Counter] = defaultdict(Counter)
            for part in slices(batch):
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    counts[lang].update((text or "").encode().lower().split())
            rows = []
            for lang, c in counts.items():
                total = c.total()
                merged: Counter = Counter()
                for w, n in c.items():
                    merged[normal_word(w)] += n
                merged.pop(b"", None)
                rows.append((lang, None, total, 0))
                rows += [(lang, w, n, total) for w, n in merged.items() if n >= REPORT_SHARE * total]
            yield rows_in(rows, reported_schema)

    reported = source.mapInArrow(report, "lang string, word binary, n long, of long").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("of").alias("of"))
    reported = scratch.table(reported)
    totals = {r["lang"]: r["total"] for r in reported.filter("word is null").select("lang", F.col("n").alias("total")).collect()}
    of_lang = F.broadcast(reported.filter("word is null").select("lang", F.col("n").alias("total")))
    bound = F.col("n") + REPORT_SHARE * (F.col("total") - F.col("of")) >= COMMON_SHARE * F.col("total")
    candidates: dict[str, set[bytes]] = defaultdict(set)
    for r in reported.filter("word is not null").join(of_lang, "lang").filter(bound).select("lang", "word").collect():
        candidates[r["lang"]].add(bytes(r["word"]))
    candidates = dict(candidates)

    def count(batches):
        for batch in batches:
            classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(8, np.int64))
            passing: dict[str, Counter] = defaultdict(Counter)
            others: dict[str, Counter] = defaultdict(Counter)
            for part in slices(batch):
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = (text or "").encode()
                    words = data.split()
                    found = word_histogram(data.lower().split(), candidates.get(lang, set()))
                    n = len(words)
                    if n < MIN_WORDS or 100 * repeated_words(words) > MAX_REPEAT_PERCENT * n:
                        others[lang].update(found)
                    else:
                        classes[lang] += char_classes(data)
                        passing[lang].update(found)
            rows = [(lang, b"%d" % k, CLASS, int(v)) for lang, c in classes.items() for k, v in enumerate(c)]
            rows += [(lang, w, kind, n) for kind, held in ((PASSING, passing), (OTHER, others)) for lang, c in held.items() for w, n in c.items()]
            yield rows_in(rows, counted_schema)

    found: dict[str, tuple[np.ndarray, Counter, Counter]] = {}
    for r in source.mapInArrow(count, "lang string, word binary, kind int, n long").groupBy("lang", "word", "kind").agg(F.sum("n").alias("n")).collect():
        of = found.setdefault(r["lang"], (np.zeros(8, np.int64), Counter(), Counter()))
        if r["kind"] == CLASS:
            of[0][int(bytes(r["word"]))] = r["n"]
        else:
            of[r["kind"]][bytes(r["word"])] = r["n"]
    final = {}
    for lang, (classes, passing, others) in found.items():
        if not classes.any():
            continue
        common = sorted(w for w in candidates.get(lang, ()) if passing[w] + others[w] >= COMMON_SHARE * totals[lang])
        words = {w: passing[w] for w in common}
        final[lang] = (classes, {**words, b"": passing.total() - sum(words.values())})
    return final


def word_histogram(lowered: list[bytes], common: set[bytes]) -> Counter:
    """Counts of the common words, with b"" for all others."""
    out: Counter = Counter()
    rest = 0
    for w in lowered:
        if w in common:
            out[w] += 1
        elif (v := w.strip(PUNCTUATION)) in common:
            out[v] += 1
        else:
            rest += 1
    out[b""] = rest
    return out


def divergence(data: bytes, reference) -> tuple[float, float]:
    """Distances of the character and the word histogram from a language reference."""
    classes, words = reference
    hist = word_histogram(data.lower().split(), words.keys() - {b""})
    keys = list(words)
    return js_distance(char_classes(data).astype(float), classes.astype(float)), js_distance(np.array([hist[k] for k in keys], float), np.array([words[k] for k in keys], float))


def quality_verdicts(df: DataFrame, carry: bool = False, reference: dict | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Per row: the base counts, base_failed, both distances and kept; with ``carry`` only kept input rows, unchanged."""
    if reference is not None:
        return _judged(df, carry, reference)
    scratch = scratch or Scratch(df.sparkSession)
    blocks = language_blocks(df)
    parts = [_of_block(df, df["lang"], b, blocks) for b in range(blocks)]
    return reduce(DataFrame.unionByName, [_judged(p, carry, language_reference(p, scratch)) for p in parts])


def _judged(df: DataFrame, carry: bool, ref: dict) -> DataFrame:
    def judge(text: str | None, lang: str):
        text = text or ""
        data = text.encode()
        words = data.split()
        counts = base_counts(text, data, words)
        chars = common = 0.0
        if lang in ref and counts[0] >= MIN_WORDS:
            chars, common = divergence(data, ref[lang])
        kept = not counts[5] and chars <= CHAR_LEVEL + CHAR_NOISE * counts[0] ** -0.5 and (counts[0] < MIN_WORDS_FOR_WORDS or common <= WORD_LEVEL + WORD_NOISE * counts[0] ** -0.5)
        return (*counts, chars, common, kept)

    if carry:
        text_at, lang_at = df.columns.index("text"), df.columns.index("lang")

        def keep(batches):
            for batch in batches:
                mask = []
                for part in slices(batch):
                    mask += [judge(t, g or "")[-1] for t, g in zip(part.column(text_at).to_pylist(), part.column(lang_at).to_pylist())]
                yield batch.filter(pa.array(mask, pa.bool_()))

        return df.mapInArrow(keep, df.schema)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")
    kinds = (pa.int64(),) * 5 + (pa.bool_(), pa.float64(), pa.float64(), pa.bool_())
    arrow = pa.schema([("doc_id", pa.int64()), *zip(names, kinds)])

    def rows_of(part: pa.RecordBatch) -> dict:
        rows = [judge(t, g) for t, g in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
        return {"doc_id": part.column(0), **{n: [r[i] for r in rows] for i, n in enumerate(names)}}

    return mapped(_source(df), rows_of, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean", arrow)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
