import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import pii

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
ANCHORS = pii.automaton()


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


PARTS = st.sampled_from(["1", "2", "25", "0", ".", "@", "a", "+", "-", " ", "4111111111111111", "é", "(", ")", "1.2.3.4", "x@y.z", "999", "_", "٣"])


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, max_size=25))
def test_base_spans_equal_regular_expressions(parts):
    text = "".join(parts)
    assert [s for s in pii.find_spans(text, ANCHORS) if s[1] < 4] == brute(text)


def test_table_and_edges(spark, make, documents):
    rows = {r["doc_id"]: r for r in pii.pii_spans(documents).collect()}
    for doc_id, text in documents.select("doc_id", "text").collect():
        spans = brute(text or "")
        joined = ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in spans)
        assert rows[doc_id]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [rows[doc_id][f"n_{k}"] for k, _ in BASE] == [sum(x[1] == i for x in spans) for i in range(4)]
    got = pii.pii_spans(make([(1, None), (1, None), (None, "a@b.cd"), (2, ""), (3, "x " * 200_000 + "a@b.cd")])).collect()
    assert sorted((r["doc_id"] or -1, r["n_email"]) for r in got) == [(-1, 1), (1, 0), (1, 0), (2, 0), (3, 1)]
    assert pii.pii_spans(make([])).count() == 0


def test_added_kinds_and_redaction():
    text = "IBAN: DE89 3704 0044 0532 0130 00, account no: 1234567, SSN 123-45-6789, at 2001:0db8:0:0:0:ff00:42:8329 https://u:pw@h.org é"
    spans = pii.find_spans(text, ANCHORS)
    kinds = {pii.KINDS[k] for _, k, _ in spans}
    assert {"iban", "account", "ssn", "ipv6", "userinfo"} <= kinds
    assert pii.redact(text, spans).endswith("é") and "1234567" not in pii.redact(text, spans)
    assert not [s for s in pii.find_spans("IBAN: DE00 3704 0044 0532 0130 00", ANCHORS) if s[1] == 4]
    assert pii.find_spans("the account of 1999 and accounts 12", ANCHORS) == []
