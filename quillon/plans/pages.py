"""Queries over drawn pages: every conversation, or supplier, is set as a page from its own rows.

A conversation's page is a table with a row per turn. What differs by conversation: the number of rows
and columns, a heading over all columns, a merged cell, rules drawn in two pieces and slightly off,
words that stick out, and labels that a rule cuts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import document, layout, ruled
from quillon.plans.registry import query
from quillon.session import table
from quillon.sources import pdf, readers

#: Where the tables stand: left and upper end, width of a column, height of a row, in points.
LEFT, UPPER, WIDE, HIGH = 50.0, 100.0, 100.0, 18.0


def turns(spark, d) -> DataFrame:
    """conv_id, nth (from 1), values (array of strings), n (turns of the conversation)."""
    nth = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", "role", "coalesce(text, '') AS text")
    values = F.array(F.concat(F.lit("t"), F.col("turn").cast("string")), "role", F.length("text").cast("string"), (F.length("text") % 97).cast("string"))
    rows = rows.withColumns({"nth": F.row_number().over(nth), "n": F.count("*").over(Window.partitionBy("conv_id")), "values": values})
    return rows.select("conv_id", "nth", "n", "values")


def shaped(df: DataFrame) -> DataFrame:
    """With the shape of a conversation's page: heading (rows over the labels), cols, rows."""
    df = df.withColumns({"heading": F.expr("CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END"), "cols": F.expr("CASE WHEN conv_id % 3 = 0 THEN 4 ELSE 3 END")})
    return df.withColumn("rows", F.col("n") + 1 + F.col("heading"))


def word(text, x0, x1, row) -> F.Column:
    top = UPPER + HIGH * row + 4
    return F.struct(text.alias("text"), x0.cast("double").alias("x0"), top.cast("double").alias("top"), x1.cast("double").alias("x1"), (top + 10).cast("double").alias("bottom"))


def ruled_pages(spark, d) -> tuple[DataFrame, DataFrame]:
    """(words, strokes) of the conversations' pages with a full grid."""
    rows = shaped(turns(spark, d))
    places = F.sequence(F.lit(0), F.col("cols") - 1)
    left = lambda c: LEFT + WIDE * c + 5
    body = rows.select("conv_id", F.explode(F.transform(places, lambda c: word(F.get("values", c), left(c), left(c) + 60, F.col("nth") + F.col("heading")))).alias("w"))
    one = rows.where("nth = 1")
    broad = F.expr("conv_id % 4 = 1 OR conv_id % 8 = 2")
    labels = one.select("conv_id", F.explode(F.transform(places, lambda c: word(F.concat(F.lit("label"), c.cast("string")), left(c), left(c) + F.when(broad & (c == 0), 130).otherwise(60), F.col("heading")))).alias("w"))
    over = one.where("heading = 1").select("conv_id", F.explode(F.array(word(F.lit("Conversation"), F.lit(60), F.lit(125), F.lit(0)), word(F.col("conv_id").cast("string"), F.lit(130), F.lit(150), F.lit(0)))).alias("w"))
    right = LEFT + WIDE * F.col("cols")
    beyond = one.where("conv_id % 5 = 0").select("conv_id", word(F.lit("*"), right - 0.2, right + 1.8, F.col("rows") - 1).alias("w"))
    words = body.unionByName(labels).unionByName(over).unionByName(beyond).select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_number"), "w.*")

    line = lambda x0, y0, x1, y1: F.struct(*(v.cast("double").alias(k) for k, v in zip(("x0", "top", "x1", "bottom"), (x0, y0, x1, y1))))
    bottom = UPPER + HIGH * F.col("rows")
    off = lambda r: UPPER + HIGH * r + 0.4 * (r % 2)
    middle = (LEFT + right) / 2
    across = F.flatten(F.transform(F.sequence(F.lit(1), F.col("rows") - 1), lambda r: F.array(line(F.lit(LEFT), off(r), middle, off(r)), line(middle + 1, off(r) + 0.3, right, off(r) + 0.3))))
    ends = lambda c: F.when(F.expr("conv_id % 3 = 1") & (c == 1), bottom - HIGH).otherwise(bottom)
    down = F.transform(F.sequence(F.lit(1), F.col("cols") - 1), lambda c: line(LEFT + WIDE * c, UPPER + HIGH * F.col("heading"), LEFT + WIDE * c + 0.5, ends(c)))
    frame = F.array(line(F.lit(LEFT), F.lit(UPPER), right, bottom))
    strokes = one.select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_number"), F.inline(F.concat(across, down, frame)))
    return words, strokes


_TURNS = """t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nth, count(*) OVER (PARTITION BY conv_id) AS n,
           ['t' || turn, role, '' || length(coalesce(text, '')), '' || length(coalesce(text, '')) % 97] AS v,
           CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS heading, CASE WHEN conv_id % 3 = 0 THEN 4 ELSE 3 END AS cols
    FROM conversations
)"""
_CELLS = f"""{_TURNS}, c AS (
    SELECT conv_id AS doc_id, nth + heading AS row, col, 1 AS col_span, n, heading, cols, v[col + 1] AS text FROM t, generate_series(0, 3) AS s(col) WHERE col < cols
    UNION ALL SELECT conv_id, heading, col, 1, n, heading, cols, 'label' || col FROM t, generate_series(0, 3) AS s(col) WHERE col < cols AND nth = 1
    UNION ALL SELECT conv_id, 0, 0, cols, n, heading, cols, 'Conversation ' || conv_id FROM t WHERE heading = 1 AND nth = 1
), m AS (
    SELECT doc_id, row, CASE WHEN low AND col = 1 THEN 0 ELSE col END AS col, max(CASE WHEN low AND col < 2 THEN 2 ELSE col_span END) AS col_span,
           string_agg(CASE WHEN col_span = 1 AND col = cols - 1 AND row = n + heading AND doc_id % 5 = 0 THEN text || ' *' ELSE text END, ' ' ORDER BY col) AS text
    FROM (SELECT *, doc_id % 3 = 1 AND row = n + heading AS low FROM c) GROUP BY ALL
)"""


@query(f"WITH {_CELLS} SELECT doc_id, row, col, 1 AS row_span, max(col_span) AS col_span, string_agg(text, ' ' ORDER BY text DESC) AS text, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS n_words FROM m GROUP BY doc_id, row, col")
def lattice_cells(spark, d):
    """The cells of the conversations' tables, with spans, texts and numbers of words."""
    words, strokes = ruled_pages(spark, d)
    return ruled.table_cells(words, strokes).where("table_no = 1").select("doc_id", "row", "col", "row_span", "col_span", "text", "n_words")


@query(
    f"""WITH {_TURNS}, g AS (SELECT conv_id, any_value(n) AS n, any_value(heading) AS heading, any_value(cols) AS cols FROM t GROUP BY conv_id)
SELECT conv_id AS doc_id, 1 AS table_no, CAST(n + 1 + heading AS INTEGER) AS n_rows, CAST(cols AS INTEGER) AS n_cols,
       CAST((n + 1) * cols + 2 * heading + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_words,
       CASE WHEN heading = 1 THEN 'Conversation ' || conv_id || repeat('|', cols - 1) ELSE array_to_string(['label0', 'label1', 'label2', 'label3'][1:cols], '|') END AS first_row,
       true AS supported, CASE WHEN conv_id % 4 = 1 THEN 'header_uncertain' WHEN conv_id % 8 = 2 THEN 'visual_lines' ELSE 'grid' END AS status
FROM g"""
)
def lattice_tables(spark, d):
    """Shape, first row and reliability of every conversation's table; all words are in its cells."""
    words, strokes = ruled_pages(spark, d)
    found = ruled.tables(ruled.table_cells(words, strokes))
    return found.select("doc_id", "table_no", "n_rows", "n_cols", "n_words", F.array_join(F.col("rows")[0], "|").alias("first_row"), "supported", "status")


def captioned_pages(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, captions, strokes) of pages with three horizontal rules under a caption, and no vertical ones."""
    rows = turns(spark, d)
    wrapped = F.expr("CASE WHEN conv_id % 3 = 1 THEN 1 ELSE 0 END")
    places = F.sequence(F.lit(0), F.lit(2))
    left = lambda c: LEFT + WIDE * c + 3 * (c % 2)
    body = rows.select("conv_id", F.explode(F.transform(places, lambda c: word(F.get("values", c), left(c), left(c) + 40 + 5 * (F.col("nth") % 3), F.col("nth") + 1))).alias("w"))
    one = rows.where("nth = 1")
    head = one.select("conv_id", F.explode(F.flatten(F.transform(places, lambda c: F.array(word(F.lit("the"), left(c), left(c) + 14, F.lit(1)), word(F.concat(F.lit("label"), c.cast("string")), left(c) + 16, left(c) + 50, F.lit(1)))))).alias("w"))
    more = one.where(wrapped == 1).select("conv_id", word(F.lit("more"), F.lit(155.0), F.lit(190.0), F.col("n") + 2).alias("w"))
    words = body.unionByName(head).unionByName(more).select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_number"), "w.*")
    page = [F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_number")]
    box = lambda x0, y0, x1, y1: F.struct(*(F.lit(v).cast("double").alias(k) if not isinstance(v, F.Column) else v.cast("double").alias(k) for k, v in zip(("x0", "top", "x1", "bottom"), (x0, y0, x1, y1))))
    captions = one.select(*page, box(LEFT, 60.0, 200.0, 72.0).alias("b")).select("doc_id", "page_number", "b.*")
    low = UPPER + HIGH * (F.col("n") + 2 + wrapped)
    lines = F.array(box(LEFT - 5, UPPER + 15, 360.0, UPPER + 15.4), box(LEFT - 4, UPPER + 2 * HIGH, 361.0, UPPER + 2 * HIGH), box(LEFT - 5, low, 360.0, low), box(400.0, UPPER + 50, 560.0, UPPER + 50), box(LEFT, UPPER + 60, 140.0, UPPER + 60))
    strokes = one.select(*page, F.inline(lines))
    return words, captions, strokes


@query(
    f"""WITH {_TURNS}, r AS (
    SELECT conv_id, nth, array_to_string(v[1:3], '|') AS line FROM t
    UNION ALL SELECT conv_id, 0, 'the label0|the label1|the label2' FROM t WHERE nth = 1
    UNION ALL SELECT conv_id, n + 1, '|more|' FROM t WHERE nth = 1 AND conv_id % 3 = 1
) SELECT conv_id AS doc_id, 1 AS region_no, string_agg(line, ' / ' ORDER BY nth) AS rows, CASE WHEN conv_id % 3 = 1 THEN '' || max(nth) ELSE '' END AS continuations FROM r GROUP BY conv_id"""
)
def gutter_tables(spark, d):
    """Rows of every conversation's table without vertical rules, by its white gutters."""
    words, captions, strokes = captioned_pages(spark, d)
    found = ruled.gutter_rows(words, ruled.ruled_regions(captions, strokes))
    return found.select("doc_id", "region_no", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), " / ").alias("rows"), F.array_join(F.col("continuations").cast("array<string>"), ",").alias("continuations"))


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 3 + 1 AS n, CASE WHEN s_nationkey % 2 = 0 THEN 20 ELSE 60 END AS gap FROM supplier)
SELECT k AS doc_id, 'Figure 1: sales of ' || k AS caption, CASE WHEN n = 1 OR gap = 20 THEN 'matched' ELSE 'unmatched' END AS status,
       CASE WHEN n = 1 OR gap = 20 THEN concat_ws(',', 48, 188, 50 + 90 * n + gap * (n - 1) + 2, 300) END AS box FROM s"""
)
def vector_figures(spark, d):
    """Figures drawn as one to three panels, per supplier: near panels are one figure, the caption's; far ones leave it open."""
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_suppkey % 3 + 1 AS n", "CASE WHEN s_nationkey % 2 = 0 THEN 20 ELSE 60 END AS gap")
    page = [F.col("k").alias("doc_id"), F.lit(1).alias("page_number")]
    left = lambda i: 50.0 + i * (90.0 + F.col("gap"))
    box = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), F.lit(y0).alias("top"), x1.alias("x1"), F.lit(y1).alias("bottom"))
    panel = F.transform(F.sequence(F.lit(0), F.col("n") - 1).cast("array<int>"), lambda i: box(left(i), 200.0, left(i) + 90.0, 300.0))
    axes = F.transform(F.sequence(F.lit(0), F.col("n") - 1).cast("array<int>"), lambda i: box(left(i) + 5.0, 210.0, left(i) + 85.0, 295.0))
    specks = F.array(box(F.lit(400.0), 400.0, F.lit(410.0), 410.0))
    paths = s.select(*page, F.inline(F.concat(panel, axes, specks)))
    right = 50.0 + 90.0 * F.col("n") + F.col("gap") * (F.col("n") - 1)
    text = F.array(F.lit("Figure"), F.lit("1:"), F.lit("sales"), F.lit("of"), F.col("k").cast("string"))
    wide = (right - 50.0 - 8.0) / 5
    words = s.select(*page, F.inline(F.transform(text, lambda t, i: F.struct(t.alias("text"), (50.0 + i * (wide + 2)).alias("x0"), F.lit(305.0).alias("top"), (50.0 + i * (wide + 2) + wide).alias("x1"), F.lit(315.0).alias("bottom")))))
    found = layout.elements(words, paths=paths)
    captions = found.where("element_type = 'figure_caption'").select("doc_id", F.col("text").alias("caption"), F.get_json_object("relation", "$.status").alias("status"))
    regions = found.where("element_type = 'image_region'").select("doc_id", F.array_join(F.transform("bbox", lambda v: v.cast("int").cast("string")), ",").alias("box"))
    return captions.join(regions, "doc_id", "left")


def pdf_of(rows: DataFrame, key: str, page: str, shown: F.Column) -> DataFrame:
    """doc_id and content: a PDF file per key with a page per row, in the order of ``page`` (from 1), which shows ``shown``; null: a page whose content is not there."""
    number, inner = (2 * F.col(page) + 10).cast("string"), (2 * F.col(page) + 11).cast("string")
    stream = F.concat(inner, F.lit(" 0 obj <</Length "), F.octet_length(shown).cast("string"), F.lit(">>\nstream\n"), shown, F.lit("\nendstream endobj "))
    content = F.when(shown.isNotNull(), inner).otherwise("9999")
    body = F.concat(number, F.lit(" 0 obj <</Type/Page/Parent 2 0 R/Contents "), content, F.lit(" 0 R>> endobj "), F.coalesce(stream, F.lit("")))
    one = rows.select(key, F.struct(page, F.concat(number, F.lit(" 0 R ")).alias("kid"), body.alias("body")).alias("p")).groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    joined = lambda c: F.array_join(F.transform("ps", lambda p: p[c]), "")
    font = "3 0 obj <</Type/Font/Subtype/Type1/FirstChar 0/Widths[" + "500 " * 256 + "]>> endobj "
    file = F.concat(F.lit("%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj " + font + "2 0 obj <</Type/Pages/MediaBox[0 0 612 792]/Resources<</Font<</F1 3 0 R>>>>/Kids["), joined("kid"), F.lit("]>> endobj "), joined("body"))
    return one.select(F.col(key).alias("doc_id"), file.cast("binary").alias("content"))


@query(
    """WITH t AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INTEGER) AS page, role, '' || length(coalesce(text, '')) AS size FROM conversations),
w AS (SELECT conv_id, page, 'word' AS kind, role AS text, 50.0 AS x0 FROM t WHERE NOT (conv_id % 7 = 0 AND page = 2)
  UNION ALL SELECT conv_id, page, 'word', size, 150.0 FROM t WHERE NOT (conv_id % 7 = 0 AND page = 2)
  UNION ALL SELECT conv_id, page, 'stroke', NULL, 50.0 FROM t WHERE NOT (conv_id % 7 = 0 AND page = 2)
  UNION ALL SELECT conv_id, page, 'warning', 'KeyError: 9999', NULL FROM t WHERE conv_id % 7 = 0 AND page = 2)
SELECT conv_id AS doc_id, page AS page_number, kind, text, CAST(x0 AS DOUBLE) AS x0, CAST(CASE kind WHEN 'word' THEN x0 + 5 * length(text) WHEN 'stroke' THEN 250 END AS DOUBLE) AS x1,
  CAST(CASE kind WHEN 'word' THEN 84.5 WHEN 'stroke' THEN 102 END AS DOUBLE) AS top FROM w"""
)
def pdf_page_things(spark, d):
    """Words and rules of a PDF file per conversation, a page per turn; a page whose content is missing is one row."""
    nth = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", "role", "coalesce(text, '') AS text").withColumn("page", F.row_number().over(nth))
    shown = F.concat(F.lit("BT /F1 10 Tf 50 700 Td ("), "role", F.lit(") Tj 100 0 Td ("), F.length("text").cast("string"), F.lit(") Tj ET 50 690 m 250 690 l S"))
    things = pdf.page_things(pdf_of(rows, "conv_id", "page", F.when(~F.expr("conv_id % 7 = 0 AND page = 2"), shown)), "doc_id")
    return things.select("doc_id", "page_number", "kind", "text", "x0", "x1", "top")


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 3 + 1 AS n, s_suppkey % 7 AS fault FROM supplier)
SELECT k AS page_id, CASE fault WHEN 1 THEN 'declaration' WHEN 2 THEN 'entry count' WHEN 3 THEN 'time' WHEN 4 THEN 'identifier' WHEN 5 THEN 'malformed' WHEN 6 THEN 'not a feed' END AS problem,
  CASE WHEN fault = 0 THEN n END AS n_works, CASE WHEN fault = 0 THEN '2401.' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0') || ': Work 1 of ' || k || ', A One, A Two' END AS first FROM s"""
)
def feed_page_checks(spark, d):
    """A feed page per supplier through the gate: what each refused page breaks, and the works of the others."""
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS k", "cast(s_suppkey % 3 + 1 AS int) AS n", "cast(s_suppkey % 7 AS int) AS fault")
    number = F.lpad((F.col("k") % 100000).cast("string"), 5, "0")
    identifier = F.when(F.col("fault") == 4, F.lit("not an id")).otherwise(F.concat(F.lit("http://arxiv.org/abs/2401."), number, F.lit("v2")))
    time = F.when(F.col("fault") == 3, F.lit("2024-01-02T03:04:05")).otherwise(F.lit("2024-01-02T03:04:05Z"))
    entry = lambda i: F.concat(F.lit("<entry><id>"), identifier, F.lit("</id><title>Work\n  "), i.cast("string"), F.lit(" of "), F.col("k").cast("string"), F.lit("</title><summary>Text &amp; more</summary><published>"), time, F.lit("</published><updated>2024-01-03T00:00:00+01:00</updated><author><name>A One</name></author><author><name>A Two</name></author><category term='cs.IR'/><a:primary_category term='cs.IR'/></entry>"))
    head = F.when(F.col("fault") == 1, F.lit("<!DOCTYPE feed>")).otherwise(F.lit(""))
    root = F.when(F.col("fault") == 6, F.lit("<list")).otherwise(F.lit("<feed"))
    close = F.when(F.col("fault") == 5, F.lit("</fee")).when(F.col("fault") == 6, F.lit("</list>")).otherwise(F.lit("</feed>"))
    size = F.col("n") + F.when(F.col("fault") == 2, 1).otherwise(0)
    entries = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), entry), "")
    content = F.concat(F.lit("<?xml version='1.0'?>"), head, root, F.lit(" xmlns='http://www.w3.org/2005/Atom' xmlns:o='http://a9.com/-/spec/opensearch/1.1/' xmlns:a='http://arxiv.org/schemas/atom'><o:totalResults>99</o:totalResults><o:startIndex>0</o:startIndex><o:itemsPerPage>"), size.cast("string"), F.lit("</o:itemsPerPage>"), entries, close)
    found = readers.feed_pages(s.select(F.col("k").alias("page_id"), content.cast("binary").alias("content")), "page_id")
    first = F.col("works")[0]
    return found.select("page_id", "problem", F.size("works").alias("n_works"), F.concat(first["arxiv_id"], F.lit(": "), first["title"], F.lit(", "), F.array_join(first["authors"], ", ")).alias("first"))


@query(
    """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS page, role, length(coalesce(text, '')) AS size FROM conversations),
c AS (SELECT conv_id, page, 0 AS part, '1 Turn' AS text, 'heading' AS kind FROM t UNION ALL SELECT conv_id, page, 1, 'said by ' || role, 'paragraph' FROM t
  UNION ALL SELECT conv_id, page, 2, 'Table 1' || chr(10) || 'turn | ' || page || chr(10) || 'size | ' || size, 'table' FROM t)
SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY page, part) - 1 AS INTEGER) AS ordinal, CAST(page AS INTEGER) AS page_number, kind AS element_type, '1 Turn' AS section, text FROM c"""
)
def pdf_chunks(spark, d):
    """PDF files to chunks: a page per turn with a heading, a line of text and a ruled table of two rows."""
    nth = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", "role", "coalesce(text, '') AS text").withColumn("page", F.row_number().over(nth))
    at = lambda x, y, text: F.concat(F.lit(f"1 0 0 1 {x} {y} Tm ("), text if isinstance(text, F.Column) else F.lit(text), F.lit(") Tj "))
    rules = "50 600 200 40 re S 50 620 m 250 620 l S 150 600 m 150 640 l S"
    shown = F.concat(F.lit("BT /F1 10 Tf "), at(50, 740, "1 Turn"), at(50, 700, F.concat(F.lit("said by "), "role")), at(55, 626, "turn"), at(155, 626, F.col("page").cast("string")), at(55, 606, "size"), at(155, 606, F.length("text").cast("string")), F.lit(f"ET {rules}"))
    found = document.elements(pdf.page_things(pdf_of(rows, "conv_id", "page", shown), "doc_id"))
    return document.chunks(found).select("doc_id", "ordinal", "page_number", "element_type", F.array_join("section_path", "/").alias("section"), "text")


@query(
    """SELECT s_suppkey AS doc_id, k AS order_index, CASE k WHEN 0 THEN 'left ' || s_suppkey || ' size x^{2} third line' ELSE 'right ' || s_name || ' more text ends in ' || s_nationkey END AS text
FROM supplier, generate_series(0, 1) AS g(k)"""
)
def two_column_pages(spark, d):
    """A page per supplier in two columns, with a small raised character: the left column is read before the right one."""
    s = table(spark, d, "supplier")
    at = lambda text, x, y, wide, high=10.0: F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("top"), F.lit(float(x + wide)).alias("x1"), F.lit(y + high).alias("bottom"))
    left = [at("left", 50, 100, 80), at(F.col("s_suppkey").cast("string"), 135, 100, 100), at("size", 50, 112, 80), at("x", 135, 112, 100), at("2", 236, 110, 4, 6.0), at("third", 50, 124, 80), at("line", 135, 124, 100)]
    right = [at("right", 330, 100, 80), at(F.col("s_name"), 415, 100, 100), at("more", 330, 112, 80), at("text", 415, 112, 100), at("ends", 330, 124, 80), at("in", 415, 124, 20), at(F.col("s_nationkey").cast("string"), 440, 124, 60)]
    words = s.select(F.col("s_suppkey").alias("doc_id"), F.lit(1).alias("page_number"), F.inline(F.array(*left, *right)))
    return layout.elements(words).select("doc_id", F.col("order_index").cast("long").alias("order_index"), "text")
