"""PDF pages as a source, and the gates of landed pages."""

import zlib

import pytest

from quillon.operators import document, layout
from quillon.sources import pdf, readers


def make_pdf(pages, flate=False, font=None, extra=b""):
    """A file with a page per content stream; an int stands for a page whose content is that missing object."""
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 3: font or b"<</Type/Font/Subtype/Type1/FirstChar 32/Widths[" + b"500 " * 95 + b"]>>"}
    kids = []
    for k, body in enumerate(pages):
        number = 100 + 2 * k
        kids.append(b"%d 0 R" % number)
        objects[number] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (body if isinstance(body, int) else number + 1)
        if not isinstance(body, int):
            stream = zlib.compress(body) if flate else body
            objects[number + 1] = b"<</Length %d%s>>\nstream\n%s\nendstream" % (len(stream), b"/Filter/FlateDecode" if flate else b"", stream)
    objects[2] = b"<</Type/Pages/Kids[" + b" ".join(kids) + b"]/MediaBox[0 0 612 792]/Resources<</Font<</F1 3 0 R>>/XObject<</I 4 0 R>>>>>>"
    objects[4] = b"<</Subtype/Image/Length 0>>\nstream\n\nendstream"
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % o for o in sorted(objects.items())) + extra + b"\ntrailer<</Root 1 0 R>>"


def shown(body, **how):
    return [r[1:7] for r in pdf.things_of(make_pdf([body], **how))]


def test_text_operators_and_drawings():
    assert shown(b"BT /F1 10 Tf 50 700 Td (Hello wor\\(ld\\)) Tj 0 -12 Td [(se)-300(cond)] TJ ET", flate=True) == [("word", "Hello", 50, 84.5, 75, 94.5), ("word", "wor(ld)", 80, 84.5, 115, 94.5), ("word", "se", 50, 96.5, 60, 106.5), ("word", "cond", 63, 96.5, 83, 106.5)]
    assert shown(b"BT /F1 10 Tf 12 TL 1 0 0 1 50 700 Tm (a\\101) Tj T* (b) ' ET") == [("word", "aA", 50, 84.5, 60, 94.5), ("word", "b", 50, 108.5, 55, 118.5)]
    assert shown(b"BT /F1 10 Tf 50 700 Td (left) Tj ( right) Tj 60 0 Td <74 6f> Tj ET")[-1][:2] == ("word", "to")
    assert shown(b"% remark\nq 2 0 0 2 10 20 cm 0 0 50 0.5 re f 10 10 m 60 10 l S 0 0 40 30 re S 5 0 0 5 1 1 cm /I Do Q 0 0 9 9 re n") == [("stroke", None, 10, 771, 110, 772), ("stroke", None, 30, 752, 130, 752), ("path", None, 10, 712, 90, 772), ("image", None, 12, 760, 22, 770)]


def test_two_byte_fonts_and_object_streams():
    cmap = b"begincodespacerange <0000><ffff> endcodespacerange 1 beginbfrange <0001><0003><0041> endbfrange 1 beginbfchar <0009><4E2D> endbfchar"
    extra = b"\n5 0 obj <</W[1[600 700] 3 3 800]/DW 1000>> endobj 6 0 obj <</Length %d>>\nstream\n%s\nendstream endobj" % (len(cmap), cmap)
    font = b"<</Type/Font/Subtype/Type0/DescendantFonts[5 0 R]/ToUnicode 6 0 R>>"
    assert shown(b"BT /F1 10 Tf 0 700 Td <0001000200030009> Tj ET", font=font, extra=extra) == [("word", "ABC中", 0, 84.5, 31, 94.5)]
    packed = zlib.compress(b"1 0 2 33 " + b"<</Type/Catalog/Pages 2 0 R>>".ljust(33) + b"<</Type/Pages/Kids[7 0 R]/MediaBox[0 0 10 10]>>")
    file = b"%%PDF-1.5\n9 0 obj<</Type/ObjStm/N 2/First 9/Filter/FlateDecode/Length %d>>stream\n%s\nendstream endobj 7 0 obj<</Type/Page/Parent 2 0 R/Contents 8 0 R>>endobj 8 0 obj<</Length 14>>stream\n0 0 5 5 re S  \nendstream endobj" % (len(packed), packed)
    assert [r[1:] for r in pdf.things_of(file)] == [("path", None, 0, 5, 5, 10, 10, 10)]


def test_one_bad_page_costs_one_row(spark, tmp_path):
    pages = [b"BT /F1 10 Tf 50 700 Td (page%d) Tj ET" % k for k in range(500)]
    pages[250], pages[300] = 9999, b"BT /F1 Tf ET"
    (tmp_path / "long.pdf").write_bytes(make_pdf(pages))
    (tmp_path / "none.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "locked.PDF").write_bytes(make_pdf([b""], extra=b"\n8 0 obj <</Encrypt 9 0 R>> endobj"))
    (tmp_path / "other.txt").write_bytes(b"x")
    spark.dataSource.register(pdf.PdfPages)
    source = spark.read.format("pdf_pages").option("partBytes", 4000).load(str(tmp_path))
    assert source.rdd.getNumPartitions() > 10
    rows = source.collect()
    words = [(r.page_number, r.text) for r in rows if r.kind == "word"]
    assert sorted(words) == [(k + 1, f"page{k}") for k in range(500) if k not in (250, 300)]
    warnings = {(r.path.rsplit("/")[-1], r.page_number): r.text.split(":")[0] for r in rows if r.kind == "warning"}
    assert warnings == {("long.pdf", 251): "KeyError", ("long.pdf", 301): "IndexError", ("none.pdf", None): "ValueError", ("locked.PDF", None): "ValueError"}
    bytes_of = spark.read.format("binaryFile").load(str(tmp_path / "*.pdf"))
    assert pdf.page_things(bytes_of).where("kind = 'word'").count() == 498
    assert pdf.page_things(bytes_of.selectExpr("path", "cast(null as binary) AS content")).where("kind <> 'warning'").count() == 0


def test_too_many_pages_is_one_warning():
    rows = list(pdf.things_of(make_pdf([b""] * 501)))
    assert len(rows) == 1 and "501 pages" in rows[0][2]


def test_pages_to_elements(spark, tmp_path):
    text = b"BT /F1 10 Tf 50 700 Td (1 Introduction) Tj 0 -40 Td (Some words) Tj 0 -200 Td (Figure 1: A plot) Tj ET 50 480 100 150 re S"
    (tmp_path / "a.pdf").write_bytes(make_pdf([text]))
    spark.dataSource.register(pdf.PdfPages)
    things = spark.read.format("pdf_pages").load(str(tmp_path)).selectExpr("1L AS doc_id", "*")
    of = lambda kind: things.where(f"kind = '{kind}'")
    found = layout.elements(of("word"), of("image"), 612.0, of("stroke"), of("path")).orderBy("order_index").collect()
    assert [(r.element_type, r.text) for r in found] == [("heading", "1 Introduction"), ("paragraph", "Some words"), ("figure_caption", "Figure 1: A plot"), ("image_region", "")]


def test_pages_to_chunks_with_ruled_tables(spark):
    def cell(x, y, t):
        return b"1 0 0 1 %d %d Tm (%s) Tj " % (x, y, t)

    grid = b"50 600 200 40 re S 50 620 m 250 620 l S 150 600 m 150 640 l S"
    full = b"BT /F1 10 Tf " + cell(50, 740, b"1 Methods") + cell(50, 700, b"Some words") + cell(55, 626, b"name") + cell(155, 626, b"value") + cell(55, 606, b"x") + cell(155, 606, b"7") + b"ET " + grid
    bare = b"BT /F1 10 Tf " + cell(50, 700, b"Only text") + b"ET " + grid
    rows = [(1, make_pdf([full, 9999, bare])), (2, b"none"), (3, None)]
    things = pdf.page_things(spark.createDataFrame(rows, "doc_id long, content binary"), "doc_id")
    found = document.elements(things)
    got = [(r.doc_id, r.page_number, r.element_type, r.text) for r in found.orderBy("doc_id", "order_index").collect()]
    assert got == [(1, 1, "heading", "1 Methods"), (1, 1, "paragraph", "Some words"), (1, 1, "table", "Table 1"), (1, 2, "warning", "KeyError: 9999"), (1, 3, "paragraph", "Only text"), (2, 0, "warning", "ValueError: not a PDF"), (3, 0, "warning", "ValueError: not a PDF")]
    table = found.where("element_type = 'table'").first()
    assert table.rows == [["name", "value"], ["x", "7"]] and table.section_path == ["1 Methods"] and table.bbox == [50, 152, 250, 192] and '"status":"grid"' in table.relation
    told = document.chunks(found).orderBy("ordinal").collect()
    assert [r.text for r in told] == ["1 Methods", "Some words", "Table 1\nname | value\nx | 7", "Only text"]


FEED = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/" xmlns:arxiv="http://arxiv.org/schemas/atom"><opensearch:totalResults>{total}</opensearch:totalResults><opensearch:itemsPerPage>{n}</opensearch:itemsPerPage>{entries}</feed>'
ENTRY = "<entry><id>http://arxiv.org/abs/2401.00001v1</id><title>{title}</title><summary>s</summary><published>{time}</published><updated>2024-01-01T00:00:00Z</updated>{more}</entry>"


def feed(total=1, n=1, title="t", time="2024-01-01T00:00:00Z", more="", entries=1):
    return FEED.format(total=total, n=n, entries=ENTRY.format(title=title, time=time, more=more) * entries)


def test_feed_pages_are_refused_as_a_whole(spark):
    cases = {
        None: feed(more="<author><name>A</name></author><author><name></name></author><category term='x'/><category/><arxiv:doi> 10.1/x </arxiv:doi>"),
        "too long": feed(title="x" * 2_000_000),
        "declaration": "<!doctype feed>" + feed(),
        "entry count": feed(n=2),
        "time": feed(time="2024-01-01T00:00:00"),
        "field length": feed(title="x" * 2001),
        "not a feed": feed().replace("feed", "rss"),
        "malformed": feed()[:-20],
        "paging": feed(total=-1),
    }
    rows = [(str(k), v.encode()) for k, v in cases.items()] + [("many", feed(n=26, entries=26).encode()), ("entity", feed(title="<!ENTITY x>").encode()), ("bytes", b"\xff\xfe"), ("empty", b""), ("zero", feed(0, 0, entries=0).encode())]
    got = {r.path: r for r in readers.feed_pages(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert {k: got[str(k)].problem for k in cases} == {k: k for k in cases}
    assert [got[k].problem for k in ("many", "entity", "bytes", "empty", "zero")] == ["entry count", "declaration", "not UTF-8", "not a feed", None]
    good = got["None"]
    assert (good.total_results, good.start, good.items_per_page) == (1, 0, 1) and good.works[0].authors == ["A"] and good.works[0].categories == ["x"] and good.works[0].doi == "10.1/x"
    assert all(r.works is None for r in got.values() if r.problem) and got["zero"].works == []


def test_result_pages_are_refused_as_a_whole(spark):
    page = '{{"meta": {{"count": {count}, "page": {page}, "per_page": {per}}}, "results": [{{"id": "{id}"}}]}}'
    of = lambda count=5, page_=1, per=10, id="https://openalex.org/W1": page.format(count=count, page=page_, per=per, id=id)
    cases = {"fine": of(), "count": of(count=-1), "page size": of(per=101), "paging": of(page_=101, per=100), "identifier": of(id="https://openalex.org/A1"), "malformed": of()[:-5], "last": of(page_=100, per=100)}
    got = {r.path: r for r in readers.result_pages(spark.createDataFrame([(k, v.encode()) for k, v in cases.items()], "path string, content binary")).collect()}
    assert {k: r.problem for k, r in got.items()} == {k: None if k in ("fine", "last") else k for k in cases}
    assert got["fine"].results[0].id == "https://openalex.org/W1" and got["count"].results is None


def test_files_are_read_by_spark(spark, tmp_path):
    (tmp_path / "a.xml").write_text(feed())
    assert readers.feed_pages(readers.files(spark, str(tmp_path))).first().problem is None
    with pytest.raises(Exception):
        readers.files(spark, str(tmp_path / "none")).count()
