import json

import pytest

from quillon.operators import layout
from quillon.sources import readers, writers
from quillon.streaming import ingest


def page(*ids, title="T"):
    return {"meta": {"count": len(ids), "per_page": 10}, "fetched_at": "2026-01-01T00:00:00Z", "results": [{"id": f"https://x/{i}", "title": title, "unknown": 1} for i in ids]}


def test_stream_ingest_is_idempotent(spark, tmp_path):
    landing, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps(page("W1", "W2")))
    ingest.ingest(spark, landing, out, mark).awaitTermination()
    (tmp_path / "in" / "2.json").write_text(json.dumps(page("W2", "W3")))
    (tmp_path / "in" / "3.json").write_text(json.dumps(page("W1", title="new")))
    ingest.ingest(spark, landing, out, mark).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r["work_id"] for r in rows) == ["W1", "W1", "W2", "W3"]
    assert readers.works(spark, landing).count() == 5


def test_stateful_ingest_keeps_versions_in_its_state(spark, tmp_path):
    landing, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    say = lambda name, body: (tmp_path / "in" / name).write_text(json.dumps(body))
    say("1.json", page("W1", "W2"))
    ingest.ingest_with_state(spark, landing, out, mark).awaitTermination()
    say("2.json", page("W2", "W3"))
    say("3.json", page("W1", title="new"))
    ingest.ingest_with_state(spark, landing, out, mark).awaitTermination()
    # back to the first title, and a third one
    say("4.json", page("W1", "W1"))
    say("5.json", page("W1", title="third"))
    ingest.ingest_with_state(spark, landing, out, mark).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r["work_id"], r["version"]) for r in rows) == [("W1", 1), ("W1", 2), ("W1", 3), ("W2", 1), ("W3", 1)]
    assert {r["version"]: json.loads(r["record"])["title"] for r in rows if r["work_id"] == "W1"} == {1: "T", 2: "new", 3: "third"}
    again = ingest.ingest(spark, landing, str(tmp_path / "other"), str(tmp_path / "mark2"))
    again.awaitTermination()
    key = lambda path: sorted((r["work_id"], r["payload_sha256"]) for r in spark.read.parquet(path).collect())
    assert key(out) == key(str(tmp_path / "other"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_windowed_counts(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert ingest.windowed_counts(events).agg({"n": "sum"}).first()[0] == events.count()


def test_atom(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<feed><entry><id>http://arxiv.org/abs/2401.12345v2</id><title>A\n  title</title><summary> s </summary><published>2024-01-01T00:00:00Z</published><updated>2024-01-01T00:00:00</updated>'
        '<author><name>Ann</name></author><author><name>Bo</name></author><category term="cs.IR"/><arxiv:doi xmlns:arxiv="x">10.1000/ABC</arxiv:doi></entry></feed>'
    )
    row = readers.atom_entries(spark, str(tmp_path / "a.xml")).first()
    assert (row["arxiv_id"], row["title"], row["authors"], row["categories"], row["doi"]) == ("2401.12345", "A title", ["Ann", "Bo"], ["cs.IR"], "10.1000/abc")
    assert row["published_at"] is not None and row["updated_at"] is None


def test_texts_and_manifests(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes("é".encode())
    (tmp_path / "t" / "b.txt").write_bytes(b"\xff\xfe")
    got = {r["path"][-5:]: (r["text"], r["error"]) for r in readers.plain_texts(spark, str(tmp_path / "t")).collect()}
    assert got == {"a.txt": ("é", None), "b.txt": (None, "not UTF-8")}
    good = {"source_type": "arxiv", "source_id": "1", "text_source_url": "https://a/b", "license_id": "CC0-1.0", "license_url": readers.LICENSES["CC0-1.0"], "license_evidence_url": "https://a/c", "reviewer": "r", "attribution": "a"}
    (tmp_path / "m").mkdir()
    cases = {"ok": good, "extra": {**good, "x": 1}, "lic": {**good, "license_url": "https://other"}, "url": {**good, "text_source_url": "http://a"}, "miss": {k: v for k, v in good.items() if k != "reviewer"}}
    for name, body in cases.items():
        (tmp_path / "m" / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "m" / "bad.json").write_text("[1]")
    got = {r["path"].rsplit("/", 1)[1][:-5]: r["problem"] for r in readers.license_manifests(spark, str(tmp_path / "m")).collect()}
    assert got == {"ok": None, "extra": "unknown key", "lic": "license", "url": "address", "miss": "missing key", "bad": "not an object"}


def test_writers(spark, tmp_path):
    df = spark.range(3)
    writers.write_new(df, str(tmp_path / "x"))
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_new(df, str(tmp_path / "x"))
    assert writers.latest_pointer(spark, str(tmp_path / "p")) is None
    writers.commit_pointer(df, str(tmp_path / "p"), 1)
    writers.commit_pointer(spark.range(5), str(tmp_path / "p"), 2)
    (tmp_path / "p" / "generation=3").mkdir()
    assert writers.latest_pointer(spark, str(tmp_path / "p")).count() == 5


def column(x, n, page_width=600):
    return [(f"word{k}", x, 100 + 12 * k, x + 200, 110 + 12 * k) for k in range(n)]


def test_reading_order_and_elements(spark):
    words = [(1, 1, "1 Introduction", 40, 40, 560, 52)] + [(1, 1, t, x, y, x1, y1) for t, x, y, x1, y1 in column(40, 4) + column(320, 4)]
    words += [(1, 1, "Figure 1: curves", 40, 420, 240, 430), (1, 2, "2 Methods", 40, 40, 200, 52), (1, 2, "same", 40, 80, 80, 90), (1, 2, "body", 40, 200, 80, 210)]
    w = spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in words], "doc_id int, page_number int, text string, x0 double, top double, x1 double, bottom double")
    i = spark.createDataFrame([(1, 1, 40.0, 300.0, 240.0, 410.0)], "doc_id int, page_number int, x0 double, top double, x1 double, bottom double")
    rows = layout.elements(w, i, 600.0).orderBy("order_index").collect()
    kinds = [(r["element_type"], r["text"]) for r in rows]
    assert kinds[0] == ("heading", "1 Introduction")
    assert kinds[1][1].startswith("word0 word1") and rows[1]["section_path"] == ["1 Introduction"]
    assert rows[-1]["section_path"] == ["2 Methods"]
    caption = next(r for r in rows if r["element_type"] == "figure_caption")
    assert json.loads(caption["relation"])["status"] == "matched"
    assert len({r["element_id"] for r in rows}) == len(rows)
    assert layout.quality_counts(layout.elements(w, i, 600.0)).first()["image_regions"] == 1


def test_layout_rules():
    W = layout.Word
    lines = layout.lines_of([W("x", (10, 100, 16, 110)), W("2", (16.5, 98, 19, 104)), W("far", (300, 100, 320, 110))], 600)
    assert [n.text for n in lines] == ["x^{2}", "far"]
    assert layout.heading_level("2.1 Results") == 2 and layout.heading_level("Abstract") == 1 and layout.heading_level("2 lower") is None
    assert layout.plausible_table([["a", "b"], ["1", "2"]]) and not layout.plausible_table([["a"], ["b"]])
    assert layout.header_rows([["a"], ["u"], ["1.0", "2.0", "3.5%"]]) == 2
    assert layout.match_captions([(0, 100, 50, 110)], [(0, 0, 50, 90), (0, 10, 50, 92)])[0]["status"] == "ambiguous"
    assert layout.match_captions([(0, 100, 50, 110)], [(200, 0, 250, 90)])[0]["status"] == "unmatched"
    assert layout.panels([(0, 0, 10, 10), (15, 0, 25, 10), (200, 0, 210, 10)]) == [(0, 0, 25, 10), (200, 0, 210, 10)]
    assert layout.merge_continuations([["a", "b"], ["", "c"]]) == [["a", "b c"]]
    L = layout.Line
    assert layout.table_from_lines([L("a", (0, 0, 20, 10)), L("b", (60, 0, 80, 10)), L("1", (0, 12, 20, 22)), L("2", (60, 12, 80, 22))]) == [["a", "b"], ["1", "2"]]
    assert layout.inside((1, 1, 2, 2), (0, 0, 5, 5)) and layout.covers((0, 0, 5, 5), (1, 1, 2, 2))
    with pytest.raises(RuntimeError):
        layout.read_pdf_words(b"")


def test_pdf_files_that_are_refused_are_rows(spark, tmp_path):
    for name, body in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"<html>"), ("c.pdf", b"%PDF-" + b"x" * 100)):
        (tmp_path / name).write_bytes(body)
    got = {r["path"][-5]: (r["error"], r["content"] is not None) for r in readers.binary_documents(spark, str(tmp_path), 50).collect()}
    assert got == {"a": (None, True), "b": ("not a PDF", False), "c": ("too long", False)}


def test_table_repairs(spark):
    from pyspark.sql import functions as F

    rows = [[["V", "x"], ["∆ vs. a strict", "V (%) strict"], ["", None], ["1", "2"]], [["V"]], [], [["a", "V"], ["V", "∆ vs. strict b"]]]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, rows array<array<string>>")
    got = [r["t"] for r in df.select("k", layout.repaired_header(F.col("rows"), 1).alias("t")).orderBy("k").collect()]
    assert got == [[["", "x"], ["∆V_strict vs. a", "V_strict (%)"], ["", None], ["1", "2"]], [["V"]], [], [["a", "V"], ["V", "∆ vs. strict b"]]]
    kept = df.select("k", layout.without_empty_rows(F.col("rows")).alias("t")).orderBy("k").first()["t"]
    assert [(r["row"], r["cells"]) for r in kept] == [(1, ["V", "x"]), (2, ["∆ vs. a strict", "V (%) strict"]), (4, ["1", "2"])]


def test_strokes_and_anchored_rows():
    W, L = layout.Word, layout.Line
    words = [W("max", (10, 100, 40, 110)), W("size", (44, 100, 70, 110)), W("of", (74, 100, 90, 110)), W("low", (10, 200, 40, 210))]
    joined = layout.joined_by_strokes(words, [(40, 108.5, 44, 108.7), (70, 104, 74, 104.1), (40, 208, 44, 208.1)])
    assert [w.text for w in joined] == ["max_size", "of", "low"] and joined[0].box == (10, 100, 70, 110)
    chain = layout.joined_by_strokes(words, [(70, 108.5, 74, 108.6), (40, 108.5, 44, 108.7)])
    assert [w.text for w in chain] == ["max_size_of", "low"]
    line = lambda t, x, y, w=40: L(t, (x, y, x + w, y + 10))
    body = [line("a", 10, 0), line("b", 100, 0), line("c", 200, 0), line("1", 30, 14), line("3", 190, 14), line("more", 120, 28), line("x", 12, 42), line("y", 90, 42), line("z", 220, 42)]
    assert layout.anchored_rows(body) == [["a", "b", "c"], ["1", "more", "3"], ["x", "y", "z"]]
    caption = L("Table 1: sizes", (10, -20, 90, -10))
    assert layout.table_under([caption, *body, line("prose that runs on over the page", 10, 56, 230), line("q", 10, 70)], 0) == body
    assert layout.table_under([caption, *body, line("far", 10, 90)], 0) == body
