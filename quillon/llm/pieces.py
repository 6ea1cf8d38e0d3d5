"""Byte-pair encoding with SentencePiece models, as rounds of merges over flat numpy arrays.

A word is a run of space marks with what follows up to the next mark. No piece holds a mark after
another character, so words never merge with each other, and each distinct word of a block of texts
is encoded once. All distinct words lie in one flat array of symbols. A round finds the least rank
of a pair in every segment, merges its places from the left in all segments at the same time, and
closes the gaps; segments without a pair leave. It ends when no pair remains.

A merge may bring up a pair of no greater rank, which the library would take before the next place.
A round therefore stops in a segment behind the first merge that does so, and the rest waits for the
next round; the ids are those of merging one pair at a time.

Segments are parts of words: two neighbouring characters that stand together in no piece cannot be
merged across. Runs of space marks are joined last, by a table of what single merges from the left
give; the model is checked for the conditions under which this is so.

Edge cases: a null text is an empty one, which has no pieces (begin and end ids alone); characters
without a piece become the ids of their UTF-8 bytes; texts of any length are taken whole, a long
word costs a round for each of its distinct ranks; repeated rows and null ids each get their row; an
empty table gives an empty result; extra columns are not read. Models with another algorithm, a
normalisation table or pieces of the user are refused with a ValueError, not encoded wrongly.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Characters of texts whose words are encoded together; a longer text is a block of its own.
BLOCK_CHARS = 4_000_000
#: Characters of words kept with their ids between blocks; the store is emptied beyond.
KEPT_CHARS = 4_000_000

#: Fixed values of the model format: kinds of pieces, and the number of byte-pair models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2

_NONE = np.iinfo(np.int32).max
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message's fields."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """Pieces, merge table and segment rule of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        trainer = dict(x for number, part in message if number == 2 for x in _fields(part))
        normal = dict(x for number, part in message if number == 3 for x in _fields(part))
        rows = [dict(_fields(part)) for number, part in message if number == 1]
        self.pieces = [row[1].decode() for row in rows]
        scores = [struct.unpack("<f", row.get(2, b"\0\0\0\0"))[0] for row in rows]
        kinds = np.array([row.get(3, NORMAL) for row in rows])
        if trainer.get(3) != BPE or not trainer.get(35) or trainer.get(24, 0):
            raise ValueError("not a byte-pair model with byte fallback and marks in front")
        if normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1):
            raise ValueError("the model changes its texts before it encodes them")
        if np.isin(kinds, (USER, UNUSED)).any():
            raise ValueError("the model holds pieces of the user or unused ones")
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self._tables(scores, kinds)

    def _tables(self, scores: list[float], kinds: np.ndarray) -> None:
        known = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in known):
            raise ValueError("a piece goes over the end of a word")
        joined = [p for p in known if len(p) > 1]
        blank = {len(p): i for p, i in known.items() if set(p) == {MARK}}
        alone = all(set(p) == {MARK} for p in joined if p.startswith(MARK * 2))
        least = min((scores[i] for p, i in known.items() if len(p) > 1 and set(p) != {MARK}), default=0.0)
        tied = {scores[i] for n, i in blank.items() if n > 1}
        if tied and not (alone and 1 in blank and len(tied) == 1 and max(tied) < least):
            raise ValueError("runs of space marks do not merge behind all other pairs")
        self._runs(blank)
        order = {s: k for k, s in enumerate(sorted({scores[i] for i in known.values()}, reverse=True))}
        chars = sorted({c for p in known for c in p})
        self.chars = np.array([ord(c) for c in chars], np.int64)
        # A character that only longer pieces hold still merges: it gets a number of its own.
        own = {c: known.get(c, (1 << 21) | ord(c)) for c in chars}
        self.char_ids = np.array([own[c] for c in chars], np.int64)
        symbol = own | known
        table, together = {}, set()
        for p in joined:
            if set(p) == {MARK}:
                continue
            together.update((ord(x) << 21) | ord(y) for x, y in zip(p, p[1:]))
            for k in range(1, len(p)):
                left, right = symbol.get(p[:k]), symbol.get(p[k:])
                if left is not None and right is not None:
                    table[(left << 22) | right] = (order[scores[known[p]]], known[p])
        self.keys = np.array(sorted(table), np.int64)
        self.ranks = np.array([table[k][0] for k in self.keys.tolist()], np.int32)
        self.merged = np.array([table[k][1] for k in self.keys.tolist()], np.int64)
        self.together = np.array(sorted(together), np.int64)
        byte = {int(self.pieces[i][3:5], 16): i for i in np.flatnonzero(kinds == BYTE)}
        self.byte_ids = np.array([byte[b] for b in range(256)], np.int64)
        self.is_byte = kinds == BYTE
        self.surface = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in byte.items():
            self.surface[i] = bytes([b])
        for i in np.flatnonzero(kinds == CONTROL):
            self.surface[i] = b""
        for i in np.flatnonzero(kinds == UNKNOWN):
            self.surface[i] = b" \xe2\x81\x87 "
        self.hidden = frozenset(np.flatnonzero(kinds == CONTROL).tolist())

    def _runs(self, blank: dict[int, int]) -> None:
        """``tails[n, k]``: the piece that starts at mark k of a run of n marks, or -1; whole pieces of the
        longest length stand before a tail."""
        longest = max(blank, default=1)

        def single(n: int) -> list[int]:
            sizes = [1] * n
            while True:
                k = next((k for k in range(len(sizes) - 1) if sizes[k] + sizes[k + 1] in blank), -1)
                if k < 0:
                    return sizes
                sizes[k : k + 2] = [sizes[k] + sizes[k + 1]]

        for n in range(longest + 1, 3 * longest):
            if single(n) != [longest] + single(n - longest):
                raise ValueError("long runs of space marks do not begin with their longest piece")
        self.tails = np.full((longest + 1, longest), -1, np.int64)
        for n in range(1, longest + 1):
            at = 0
            for size in single(n):
                self.tails[n, at] = blank.get(size, -1)
                at += size
        self.mark = blank.get(1, -1)

    # --- encoding -------------------------------------------------------------------------

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; rank ``_NONE`` where no piece is made."""
        key = (left << 22) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def _rounds(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Symbols after all merges, -1 where a symbol went into the one before; ``first`` begins segments."""
        out = symbols.copy()
        place, symbols = np.arange(len(symbols)), symbols.copy()
        segment = np.cumsum(first)
        inner = np.append(segment[1:] == segment[:-1], False)
        rank, made = np.full(len(symbols), _NONE, np.int32), np.zeros(len(symbols), np.int64)
        at = np.flatnonzero(inner)
        rank[at], made[at] = self._find(symbols[at], symbols[at + 1])
        while len(symbols):
            starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            live = least < _NONE
            if not live.all():
                stay = np.repeat(live, sizes)
                place, symbols, segment, rank, made = (x[stay] for x in (place, symbols, segment, rank, made))
                least, sizes = least[live], sizes[live]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            # Places that share a symbol: every second one of a run, from its left.
            run = np.append(True, at[1:] != at[:-1] + 1)
            nth = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            at = at[nth % 2 == 0]
            new, level, home = made[at], rank[at], segment[at]
            padded = np.append(symbols, 0)
            beside = np.append(segment, -1)
            before = padded[at - 1]
            touching = np.append(False, at[1:] == at[:-1] + 2)
            before = np.where(touching, np.append(0, new[:-1]), before)
            left, _ = self._find(before, new)
            left[(at == 0) | (beside[at - 1] != home)] = _NONE
            after = np.minimum(at + 2, len(symbols))
            right, _ = self._find(new, padded[after])
            right[beside[after] != home] = _NONE
            stop = np.minimum(left, right) <= level
            if stop.any():
                passed = np.cumsum(stop) - stop
                head = np.append(True, home[1:] != home[:-1])
                keep = passed == passed[np.flatnonzero(head)[np.cumsum(head) - 1]]
                at, new = at[keep], new[keep]
            symbols[at] = new
            out[place[at]] = new
            out[place[at + 1]] = -1
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            rank[at] = _NONE
            place, symbols, segment, rank, made = (x[stay] for x in (place, symbols, segment, rank, made))
            at = at - np.arange(len(at))
            touched = np.zeros(len(symbols) + 1, bool)
            touched[at] = touched[at - 1] = True
            changed = np.flatnonzero(touched[:-1])
            rank[changed] = _NONE
            changed = changed[changed < len(symbols) - 1]
            changed = changed[segment[changed] == segment[changed + 1]]
            rank[changed], made[changed] = self._find(symbols[changed], symbols[changed + 1])
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words as little-endian unsigned 32-bit integers; spaces stand as marks."""
        if not words:
            return []
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        at = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
        symbols = np.where(self.chars[at] == code, self.char_ids[at], (1 << 21) | code)
        first = np.zeros(len(code), bool)
        first[0] = True
        pair = (code[:-1] << 21) | code[1:]
        at = np.minimum(np.searchsorted(self.together, pair), len(self.together) - 1)
        first[1:] = self.together[at] != pair
        ends = np.cumsum(sizes)
        first[(ends - sizes)[sizes > 0]] = True
        out = self._rounds(symbols, first)
        word = np.repeat(np.arange(len(words)), sizes)[out >= 0]
        ids, word = self._blanks(out[out >= 0], word)
        ids, word = self._bytes(ids, word)
        data = ids.astype("<u4").tobytes()
        cut = 4 * np.searchsorted(word, np.arange(len(words) + 1))
        return [data[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def _blanks(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of single marks within a word, as single merges from the left join them."""
        longest = self.tails.shape[1]
        mark = ids == self.mark
        if longest < 2 or not mark.any():
            return ids, word
        begins = mark & ~(np.append(False, mark[:-1]) & np.append(False, word[1:] == word[:-1]))
        run = np.cumsum(begins) - 1
        here = np.flatnonzero(mark)
        sizes = np.bincount(run[here])[run[here]]
        nth = here - np.flatnonzero(begins)[run[here]]
        ids = ids.copy()
        ids[here] = self.tails[np.minimum(longest, sizes - nth + nth % longest), nth % longest]
        return ids[ids >= 0], word[ids >= 0]

    def _bytes(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the ids of their UTF-8 bytes."""
        rare = np.flatnonzero(ids >= 1 << 21)
        if not len(rare):
            return ids, word
        text = (ids[rare] & ((1 << 21) - 1)).astype("<u4").tobytes().decode("utf-32-le")
        coded = [c.encode() for c in text]
        times = np.ones(len(ids), np.int64)
        times[rare] = [len(c) for c in coded]
        data = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        spread = np.repeat(ids, times)
        spread[np.repeat(np.arange(len(ids)), times).searchsorted(rare).repeat(times[rare]) + _steps(times[rare])] = data
        return spread, np.repeat(word, times)

    def words(self, text: str | None) -> list[str]:
        """Words of a text: it gets a mark in front, and a mark for every space."""
        return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    # --- decoding -------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids are silent, the first piece loses its space mark."""
        inner = ids[1:] if ids and ids[0] in self.hidden else ids
        inner = inner[:-1] if inner and inner[-1] in self.hidden else inner
        if self.hidden.isdisjoint(inner):
            parts = list(map(self.surface.__getitem__, inner))
            if inner and self.pieces[inner[0]].startswith(MARK):
                parts[0] = parts[0][1:]
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        return self._piece_by_piece(ids)

    def _piece_by_piece(self, ids: list[int]) -> str:
        """Decoding for ids that no text gives: control ids in between, bytes that are no UTF-8."""
        out, run, at_start, lost_mark = [], b"", True, False
        for i in [*ids, -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                good = next((n for n in range(1, 5) if _valid(run[:n])), 0)
                out.append(run[:good].decode() if good else "\ufffd")
                run = run[good or 1 :]
            at_start = at_start and not lost_mark and not any(out)
            if i >= 0:
                lost_mark = at_start and self.pieces[i].startswith(MARK)
                out.append(self.surface[i].decode()[1 if lost_mark else 0 :])
        return "".join(out)


def _steps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive groups of the given sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)


def _valid(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


class Encoder:
    """Texts to ids; ids of words seen are kept up to ``KEPT_CHARS``."""

    def __init__(self, model: PieceModel, kept_chars: int = KEPT_CHARS):
        self.model, self.kept, self.size, self.limit = model, {}, 0, kept_chars

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids with begin and end of every text, as little-endian unsigned 32-bit integers."""
        split = [self.model.words(t) for t in texts]
        if self.size > self.limit:
            self.kept, self.size = {}, 0
        new = list({w for words in split for w in words if w not in self.kept})
        self.kept.update(zip(new, self.model.encode_words(new)))
        self.size += sum(map(len, new))
        head, tail = struct.pack("<I", self.model.begin), struct.pack("<I", self.model.end)
        return [b"".join([head, *map(self.kept.__getitem__, words), tail]) for words in split]


@lru_cache(maxsize=4)
def model_at(path: str) -> PieceModel:
    """The model of a file, read once in each worker."""
    return PieceModel(path)


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _blocks(texts: list[str | None]) -> Iterator[slice]:
    """Slices of texts of at most ``BLOCK_CHARS`` characters, or of one text."""
    begin = size = 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if k > begin and size + n > BLOCK_CHARS:
            yield slice(begin, k)
            begin, size = k, 0
        size += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def encoded(df: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (array of int, begin and end included) and decoded text of every row's text.

    ``model``: path of the model file on every executor; by default the public 32k model.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        found = model_at(model or _public(MODEL))
        encode = Encoder(found)
        for batch in batches:
            for part in _blocks(texts := batch.column("text").to_pylist()):
                ids = encode(texts[part])
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(part.start, part.stop - part.start),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                        pa.array([found.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string()),
                    ],
                    schema=schema,
                )

    return df.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of rows of ``encoded``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.array([hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(ends[:-1], ends[1:])], pa.string()),
                    pa.array([hashlib.sha256(t.as_py().encode()).hexdigest() for t in batch.column("decoded")], pa.string()),
                ],
                schema=schema,
            )

    return df.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return digests(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet")))
