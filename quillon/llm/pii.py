"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, digits, plus signs before
a digit, dots before a digit, schemes and identifier cues. A deterministic local parser then expands
each anchor to its boundaries and validates it (octet range, Luhn, mod 97, digit counts). Parsers of
one kind never step behind the end of the last span they tried, which makes their result equal to
that of a leftmost, non-overlapping search of the whole text.

Kinds: the base kinds ``email``, ``ip``, ``card``, ``phone``, and the added kinds ``iban`` (mod 97),
``account`` (a cue such as "account no" and 6 to 18 digits), ``ssn`` (a cue and ddd-dd-dddd in the
issued ranges), ``ipv6`` (full form of eight groups) and ``userinfo`` (credentials in a URL).
Added spans never remove base ones. Null and empty texts have no span. Positions are code points.
Very long texts are read whole, one at a time, in time that grows with their length. Ties: spans of one
start are listed by kind, in the order of ``KINDS``. Null ids are kept; repeated rows and ids each get
their result; an empty table gives no rows; extra columns are ignored, whatever their names.
The plan is one narrow map over (doc_id, text): no shuffle, memory bounded by a slice of rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import mapped

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "account", "ssn", "ipv6", "userinfo")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DIGITS = frozenset("0123456789")
CUES = {"iban": "iban", "account": "account", "acct": "account", "konto": "account", "compte": "account", "cuenta": "account", "ssn": "ssn", "social security": "ssn"}

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_quad = re.compile(r"[0-9]+(?:\.[0-9]+){3}").match
_digits = re.compile(r"[0-9](?:[ -]?[0-9])+").match
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
_iban = re.compile(r"(?i:iban)[ :#.]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])").match
_account = re.compile(r"(?i:accounts?|acct|konto|compte|cuenta)[.]?(?: ?(?i:no|nr|number|nummer|num)[.]?)?[ :#=]{1,3}([0-9](?:[ -]?[0-9]){5,17})(?![0-9A-Za-z])").match
_ssn = re.compile(r"(?i:ssn|social security)(?: ?(?i:no|number)[.]?)?[ :#=]{1,3}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9A-Za-z])").match
_ipv6 = re.compile(r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])").match
_userinfo = re.compile(r"://([A-Za-z0-9._~%!$&'()*+,;=-]+:[^\s/@]+)@").match


def luhn(number: str) -> bool:
    """Checksum of payment card numbers over the digits of ``number``."""
    total = 0
    for k, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def iban_valid(number: str) -> bool:
    """ISO 13616: the rearranged number, letters as 10 to 35, is 1 modulo 97."""
    s = number.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def automaton():
    """Anchors of all kinds; a cue is listed in lower, title and upper case."""
    import ahocorasick

    a = ahocorasick.Automaton()
    words = {"@": "at", "://": "scheme", **{d: "digit" for d in "0123456789"}, **{f".{d}": "dot" for d in "0123456789"}, **{f"+{d}": "plus" for d in "0123456789"}}
    words |= {f"{h}:": "colon" for h in "0123456789abcdefABCDEF"}
    for cue in CUES:
        words |= {form: "cue" for form in (cue, cue.title(), cue.capitalize(), cue.upper())}
    for word, kind in words.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def find_spans(text: str, anchors) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of each span, sorted."""
    out = []
    email = ip = card = phone = cue = six = 0
    for last, (kind, size) in anchors.iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= card and (m := _digits(text, at)):
                card = m.end()
                number = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(number) <= 19 and luhn(number):
                    out.append((at, 2, card))
        elif kind == "dot":
            if at >= ip:
                s = at
                while s > ip and text[s - 1] in DIGITS:
                    s -= 1
                if s < at and (m := _quad(text, s)):
                    ip = m.end()
                    if all(int(x) <= 255 if len(x) < 4 else int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split(".")):
                        out.append((s, 1, ip))
        elif kind == "at":
            s = at
            while s > email and text[s - 1] in LOCAL:
                s -= 1
            if s < at and (m := _domain(text, at + 1)):
                email = m.end()
                out.append((s, 0, email))
        elif kind == "plus":
            if at >= phone and (m := _phone(text, at)):
                phone = m.end()
                if 10 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out.append((at, 3, phone))
        elif kind == "cue":
            if at >= cue:
                if (m := _iban(text, at)) and iban_valid(m[1]):
                    out.append((m.start(1), 4, m.end(1)))
                elif m := _account(text, at):
                    out.append((m.start(1), 5, m.end(1)))
                elif m := _ssn(text, at):
                    out.append((m.start(1), 6, m.end(1)))
                cue = m.end() if m else at
        elif kind == "scheme":
            if m := _userinfo(text, at):
                out.append((m.start(1), 8, m.end(1)))
        elif at >= six:
            s = at
            while s > six and at - s < 4 and text[s - 1] in "0123456789abcdefABCDEF":
                s -= 1
            if (s == 0 or not (text[s - 1].isalnum() or text[s - 1] == ":")) and (m := _ipv6(text, s)):
                six = m.end()
                out.append((s, 7, six))
    out.sort()
    return out


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts per base kind, base_sha256 and all spans (``kind:start:end``, comma-joined)."""
    source = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    arrow = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])
    state: list = []

    def rows_of(part: pa.RecordBatch) -> dict:
        if not state:
            state.append(automaton())
        out: dict = {f.name: [] for f in arrow if f.name != "doc_id"}
        for text in part.column(1).to_pylist():
            spans = find_spans(text, state[0]) if text else []
            names = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e in spans]
            for i, kind in enumerate(BASE_KINDS):
                out[f"n_{kind}"].append(sum(k == i for k, _ in names))
            out["base_sha256"].append(hashlib.sha256(",".join(x for k, x in names if k < 4).encode()).hexdigest())
            out["spans"].append(",".join(x for _, x in names))
            out["n_spans"].append(len(names))
        return {"doc_id": part.column(0), **out}

    return mapped(source, rows_of, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long", arrow)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; nested spans are covered once."""
    out, end = [], 0
    for s, k, e in spans:
        if s >= end:
            out += [text[end:s], f"[{KINDS[k].upper()}]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
