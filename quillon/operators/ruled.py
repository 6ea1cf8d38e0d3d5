"""Tables drawn with rules: from strokes and positioned words to cells, as joins and windows.

Strokes, words, captions and rectangles are tables with doc_id, page_number, x0, top, x1, bottom (and
text); coordinates grow right and down. All windows lie within a page, so pages spread over the
cluster by hash; nothing is collected but one page's cells, whose connected groups are its tables.

* ``lattice``: collinear strokes are snapped and joined, crossings of horizontal and vertical ones are
  the corners, and a cell runs from a corner to the next rule that goes on down and the next that goes
  on right. Merged cells have spans.
* ``table_cells``: every word of a table's region goes to one cell: the slot that holds its middle, found
  by row and column, or the nearest cell where there is none. No word of a region is lost.
* ``tables``: rows of a table, whether its grid has enough text, and what its column rules cut.
* ``ruled_regions``, ``gutter_rows``: tables with horizontal rules only; columns are the white gutters that
  enough lines share.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_number"]
TABLE = [*PAGE, "table_no"]
REGION = [*PAGE, "region_no"]

#: Fixed values, in points: a rule is at most this thick, and collinear rules this far apart are one; gaps of a rule.
THIN, SNAP, JOIN = 1.5, 3.0, 3.0
#: A line's words differ this much in their tops; margins of a table's region, right and left, above and below.
SAME_LINE, MARGIN_X, MARGIN_Y = 3.0, 1.0, 0.5
#: Share of a grid's slots with text, and the bounds of a plausible table.
TEXT_SHARE, LEAST_CELLS, MOST_COLUMNS = 0.35, 4, 16
#: Rules of a captioned table: distance of the first and between rules, least length, slack of their ends and of the caption.
RULE_GAP, RULE_LENGTH, RULE_SLACK, CAPTION_SLACK, WIDEST = 260.0, 80.0, 5.0, 16.0, 0.98
#: Gutters: least width, share of the median height, lines that must support one, share of lines that may cross it.
GUTTER, GUTTER_SHARE, SUPPORT_SHARE, CROSSING_SHARE = 3.0, 0.5, 0.4, 0.15
#: How far inside a word, in points and as a share of its width, a rule must lie to cut it.
INSET, INSET_SHARE = 0.75, 0.1
#: Width of the bands by which crossings are found.
BAND = 64.0


def _page(df: DataFrame) -> DataFrame:
    numbers = [F.col(c).cast("double").alias(c) for c in ("x0", "top", "x1", "bottom")]
    return df.select(F.col("doc_id").cast("long"), F.col("page_number").cast("int"), *(["text"] if "text" in df.columns else []), *numbers)


def _runs(df: DataFrame, keys: list[str], order: list[str], apart: Column, name: str) -> DataFrame:
    """Numbers runs of rows from 0: ``apart`` says of a row, after the first, that a new run begins."""
    window = Window.partitionBy(*keys).orderBy(*order)
    begins = F.when(F.row_number().over(window) > 1, F.coalesce(apart, F.lit(False))).otherwise(False)
    return df.withColumn(name, begins.cast("int")).withColumn(name, F.sum(name).over(window.rowsBetween(Window.unboundedPreceding, 0)))


def rules(strokes: DataFrame) -> DataFrame:
    """Snapped and joined edges: along ('h' or 'v'), pos, lo, hi. A box that is not thin gives its four sides.

    Pages are dealt to ``spark.sql.shuffle.partitions`` tasks, none of them put together for having few bytes: strokes
    take next to none on their way, but each of a task's many sorts holds all of its rows.
    """
    side = lambda along, pos, lo, hi: F.struct(F.lit(along).alias("along"), pos.alias("pos"), lo.alias("lo"), hi.alias("hi"))
    x0, y0, x1, y1 = F.least("x0", "x1"), F.least("top", "bottom"), F.greatest("x0", "x1"), F.greatest("top", "bottom")
    flat, narrow = y1 - y0 <= THIN, x1 - x0 <= THIN
    across, down = side("h", (y0 + y1) / 2, x0, x1), side("v", (x0 + x1) / 2, y0, y1)
    box = F.array(side("h", y0, x0, x1), side("h", y1, x0, x1), side("v", x0, y0, y1), side("v", x1, y0, y1))
    none = F.slice(F.array(across), 1, 0)
    sides = F.when(flat & narrow, none).when(flat, F.array(across)).when(narrow, F.array(down)).otherwise(box)
    edges = _page(strokes).dropna(subset=["x0", "top", "x1", "bottom"]).repartition(int(strokes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PAGE).select(*PAGE, F.explode(sides).alias("e")).select(*PAGE, "e.*")
    keys = [*PAGE, "along"]
    by_pos = Window.partitionBy(*keys).orderBy("pos", "lo", "hi")
    edges = _runs(edges, keys, ["pos", "lo", "hi"], F.col("pos") - F.lag("pos").over(by_pos) > SNAP, "line")
    before = Window.partitionBy(*keys, "line").orderBy("lo", "hi", "pos").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumns({"pos": F.avg("pos").over(Window.partitionBy(*keys, "line")), "reach": F.max("hi").over(before)})
    edges = _runs(edges, [*keys, "line"], ["lo", "hi"], F.col("lo") - F.col("reach") > JOIN, "piece")
    return edges.groupBy(*keys, "line", "piece").agg(F.first("pos").alias("pos"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("line", "piece")


def corners(edges: DataFrame) -> DataFrame:
    """Where rules meet, and whether they go on from there: x, y, right, down, and the ends of both rules.

    Rules are dealt to bands of the page's width, so a vertical one meets the horizontal ones of its band only.
    """
    band = lambda c: F.floor(c / BAND)
    rule = F.struct("pos", "lo", "hi")
    bands = F.when(F.col("along") == "h", F.sequence(band(F.col("lo") - SNAP), band(F.col("hi") + SNAP))).otherwise(F.array(band(F.col("pos"))))
    dealt = edges.withColumn("band", F.explode(bands)).groupBy(*PAGE, "band").agg(F.collect_list(F.when(F.col("along") == "h", rule)).alias("hs"), F.collect_list(F.when(F.col("along") == "v", rule)).alias("vs"))
    meets = lambda h: F.col("v.pos").between(h["lo"] - SNAP, h["hi"] + SNAP) & h["pos"].between(F.col("v.lo") - SNAP, F.col("v.hi") + SNAP)
    met = dealt.select(*PAGE, "hs", F.explode("vs").alias("v")).select(*PAGE, "v", F.explode(F.filter("hs", meets)).alias("h"))
    return met.select(*PAGE, F.col("v.pos").alias("x"), F.col("h.pos").alias("y"), F.col("h.lo").alias("h_lo"), F.col("h.hi").alias("h_hi"), F.col("v.lo").alias("v_lo"), F.col("v.hi").alias("v_hi"), (F.col("h.hi") > F.col("v.pos") + SNAP).alias("right"), (F.col("v.hi") > F.col("h.pos") + SNAP).alias("down"))


def grids(strokes: DataFrame) -> DataFrame:
    """One row per grid: table_no (from 1, from the top), edges xs and ys, cells, and for each slot its cell's place.

    All steps but the grouping keep the rows of a page where the first shuffle has put them.
    """
    # Read from the far end, so that what was seen last is the nearest corner ahead.
    ahead = lambda by, fix: Window.partitionBy(*PAGE, *fix).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
    corner = corners(rules(strokes)).withColumns(
        {
            "r": F.last(F.when(F.col("down"), F.struct("x", "v_hi")), ignorenulls=True).over(ahead("x", ["y", "h_lo"])),
            "b": F.last(F.when(F.col("right"), F.struct("y", "h_hi")), ignorenulls=True).over(ahead("y", ["x", "v_lo"])),
        }
    )
    closed = (F.col("r.v_hi") >= F.col("b.y") - SNAP) & (F.col("b.h_hi") >= F.col("r.x") - SNAP)
    box = F.struct(F.col("y").alias("top"), F.col("x").alias("x0"), F.col("r.x").alias("x1"), F.col("b.y").alias("bottom"))
    pages = corner.where(F.col("right") & F.col("down") & closed).groupBy(*PAGE).agg(F.array_sort(F.collect_set(box)).alias("cells"))

    def run(batches):
        for batch in batches:
            found = [grids_of([(c["x0"], c["top"], c["x1"], c["bottom"]) for c in page]) for page in batch.column("cells").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page_number"), pa.array(found, _GRIDS)], names=[*PAGE, "grids"])

    return pages.mapInArrow(run, f"doc_id long, page_number int, grids array<struct<{GRID}>>").select(*PAGE, F.inline("grids"))


GRID = "table_no:int,xs:array<double>,ys:array<double>,cells:array<struct<row:int,col:int,row_span:int,col_span:int,x0:double,top:double,x1:double,bottom:double>>,slots:array<int>"
_CELL = pa.struct([*((k, pa.int32()) for k in ("row", "col", "row_span", "col_span")), *((k, pa.float64()) for k in ("x0", "top", "x1", "bottom"))])
_GRIDS = pa.list_(pa.struct([("table_no", pa.int32()), ("xs", pa.list_(pa.float64())), ("ys", pa.list_(pa.float64())), ("cells", pa.list_(_CELL)), ("slots", pa.list_(pa.int32()))]))


def groups_by_corner(cells: list[tuple[float, float, float, float]]) -> list[list[int]]:
    """Places of boxes that share corners, from the top; a box that shares none is left out."""
    parent = list(range(len(cells)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    first: dict[tuple[float, float], int] = {}
    for k, (x0, top, x1, bottom) in enumerate(cells):
        for corner in ((x0, top), (x1, top), (x0, bottom), (x1, bottom)):
            parent[root(k)] = root(first.setdefault(corner, k))
    members: dict[int, list[int]] = {}
    for k in range(len(cells)):
        members.setdefault(root(k), []).append(k)
    return sorted((m for m in members.values() if len(m) > 1), key=lambda m: min((cells[k][1], cells[k][0]) for k in m))


def grids_of(boxes: list[tuple[float, float, float, float]]) -> list[dict]:
    """The grids of a page's cells: rows and columns by the cells' edges."""
    out = []
    for number, group in enumerate(groups_by_corner(boxes), 1):
        xs, ys = (sorted({boxes[k][j] for k in group for j in (i, i + 2)}) for i in (0, 1))
        col, row = ({v: k for k, v in enumerate(edges)} for edges in (xs, ys))
        cells, slots = [], [None] * ((len(xs) - 1) * (len(ys) - 1))
        for x0, top, x1, bottom in sorted((boxes[k] for k in group), key=lambda b: (b[1], b[0])):
            cells.append({"row": row[top], "col": col[x0], "row_span": row[bottom] - row[top], "col_span": col[x1] - col[x0], "x0": x0, "top": top, "x1": x1, "bottom": bottom})
            for r in range(row[top], row[bottom]):
                for c in range(col[x0], col[x1]):
                    slots[r * (len(xs) - 1) + c] = len(cells) - 1
        out.append({"table_no": number, "xs": xs, "ys": ys, "cells": cells, "slots": slots})
    return out


def lattice(strokes: DataFrame) -> DataFrame:
    """Cells of all grids: table_no, row, col, row_span, col_span and the box."""
    return grids(strokes).select(*TABLE, F.inline("cells"))


def table_cells(words: DataFrame, strokes: DataFrame) -> DataFrame:
    """``lattice`` with every cell's text and n_words ('' and 0 if empty), header_cut and body_cut.

    Every word of a grid's region goes to one cell: the one that holds the slot of its middle, or the nearest row's
    nearest cell where the grid has none there or the word stands just outside. A word in the regions of two grids
    counts in both. A word is cut where a rule between cells of its rows goes through it.
    """
    words = _page(words).where("trim(text) <> ''").withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("top") + F.col("bottom")) / 2})
    pages = words.groupBy(*PAGE).agg(F.collect_list(F.struct("text", "x0", "top", "x1", "cx", "cy")).alias("words"))
    found = grids(strokes).join(pages, PAGE, "left")
    xs, ys, cells, end = F.col("xs"), F.col("ys"), F.col("cells"), lambda edges: F.element_at(edges, -1)
    slot = lambda edges, v: F.least(F.size(edges) - 2, F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: e <= v)) - 1))
    held = lambda w: w["cx"].between(xs[0] - MARGIN_X, end(xs) + MARGIN_X) & w["cy"].between(ys[0] - MARGIN_Y, end(ys) + MARGIN_Y)
    apart = lambda w, c: F.struct(F.abs(w["cy"] - (c["top"] + c["bottom"]) / 2), F.abs(w["cx"] - (c["x0"] + c["x1"]) / 2))
    nearest = lambda w: F.array_min(F.transform(cells, lambda c, k: F.struct(apart(w, c), k.alias("at"))))["at"]
    owner = lambda w: F.coalesce(F.get("slots", slot(ys, w["cy"]) * (F.size(xs) - 1) + slot(xs, w["cx"])), nearest(w))
    inset = lambda w: F.greatest(F.lit(INSET), INSET_SHARE * (w["x1"] - w["x0"]))
    through = lambda w, x: (x < end(xs) - 1) & x.between(w["x0"] + inset(w), w["x1"] - inset(w))
    cut = lambda w: F.exists(xs, lambda x: through(w, x)) & F.exists(cells, lambda c: through(w, c["x1"]) & w["cy"].between(c["top"], c["bottom"]))
    placed = F.transform(F.filter("words", held), lambda w: F.struct(owner(w).alias("at"), F.trim(w["text"]).alias("text"), w["x0"].alias("x0"), w["top"].alias("top"), (cut(w) & (w["cy"] < ys[1]) & (F.length(F.trim(w["text"])) > 1)).alias("header_cut"), (cut(w) & (w["cy"] >= ys[1])).alias("body_cut")))
    void = F.transform(cells, lambda c, k: F.struct(k.alias("at"), F.lit(None).cast("string").alias("text"), c["x0"].alias("x0"), c["top"].alias("top"), F.lit(False).alias("header_cut"), F.lit(False).alias("body_cut")))
    rows = found.select(*TABLE, "cells", F.inline(F.concat(void, F.coalesce(placed, F.slice(void, 1, 0))))).select(*TABLE, F.get("cells", F.col("at")).alias("cell"), "text", "x0", "top", "header_cut", "body_cut")
    keys = [*TABLE, "cell"]
    above = Window.partitionBy(*keys, F.col("text").isNull()).orderBy("top", "x0", "text")
    rows = rows.withColumn("gap", F.coalesce(F.col("top") - F.lag("top").over(above) > SAME_LINE, F.lit(False)).cast("int"))
    rows = rows.withColumn("line", F.sum("gap").over(above.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("line", "x0", "text"))))
    texts = rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.count("text").alias("n_words"), F.max("header_cut").alias("header_cut"), F.max("body_cut").alias("body_cut"))
    return texts.select(*TABLE, "cell.*", "text", "n_words", "header_cut", "body_cut")


def tables(cells: DataFrame) -> DataFrame:
    """One row per table of ``table_cells``: bbox, n_rows, n_cols, n_words, rows (array of arrays of texts, a spanning cell's in
    its first slot), supported, and status.

    ``supported``: text in enough of all slots, empty rows included. ``status``: 'grid'; 'header_uncertain' if a rule
    between columns cuts a word of the first row; 'visual_lines' if it cuts one below, so columns cannot be trusted.
    """
    found = cells.groupBy(*TABLE).agg(F.max(F.col("row") + F.col("row_span")).alias("n_rows"), F.max(F.col("col") + F.col("col_span")).alias("n_cols"), F.sum("n_words").alias("n_words"), F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col"), "text"))).alias("texts"), F.max("header_cut").alias("header_cut"), F.max("body_cut").alias("body_cut"), F.array(F.min("x0"), F.min("top"), F.max("x1"), F.max("bottom")).alias("bbox"))
    places = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    text = lambda r, c: F.coalesce(F.try_element_at("texts", F.struct(r.alias("row"), c.alias("col"))), F.lit(""))
    found = found.withColumn("rows", F.transform(places("n_rows"), lambda r: F.transform(places("n_cols"), lambda c: text(r, c))))
    filled = F.transform("rows", lambda r: F.size(F.filter(r, lambda c: c != "")))
    total = F.aggregate(filled, F.lit(0), lambda a, n: a + n)
    several = F.size(F.filter(filled, lambda n: n >= 2)) >= 2
    fits = F.col("n_cols").between(2, MOST_COLUMNS) & (F.col("n_rows") >= 2) & (total >= LEAST_CELLS) & several
    supported = fits & (total >= TEXT_SHARE * F.col("n_rows") * F.col("n_cols"))
    status = F.when(F.col("body_cut"), "visual_lines").when(F.col("header_cut"), "header_uncertain").otherwise("grid")
    return found.select(*TABLE, "bbox", "n_rows", "n_cols", "n_words", "rows", supported.alias("supported"), status.alias("status"))


def ruled_regions(captions: DataFrame, strokes: DataFrame, page_width: float = 612.0) -> DataFrame:
    """Regions between the horizontal rules under a table's caption: region_no, box and header_bottom.

    ``captions``: boxes of table captions. The first rule lies within 260 points below the caption, the others begin
    and end where it does; a wider gap, or the next caption, ends the table. Two rules at least.
    """
    below = Window.partitionBy(*PAGE).orderBy("top", "x0")
    caption = _page(captions).select(*PAGE, "x0", "top", "x1", "bottom").dropna()
    caption = caption.withColumns({"region_no": F.row_number().over(below), "until": F.array_min(F.filter(F.collect_set("top").over(Window.partitionBy(*PAGE)), lambda t: t > F.col("top")))})
    caption = caption.select(*PAGE, "region_no", F.col("x0").alias("c_x0"), F.col("x1").alias("c_x1"), F.col("bottom").alias("c_bottom"), F.coalesce("until", F.lit(float("inf"))).alias("until"))
    rule = _page(strokes).where(f"abs(bottom - top) <= {THIN} AND x1 - x0 >= {RULE_LENGTH} AND x1 <= {WIDEST * page_width}")
    near = f"top >= c_bottom AND top < until AND x0 <= c_x1 + {CAPTION_SLACK} AND x1 >= c_x0 - {CAPTION_SLACK}"
    rule = rule.join(caption, PAGE).where(near)
    down = Window.partitionBy(*REGION).orderBy("top", "x0", "x1")
    rule = rule.withColumns({"first_x0": F.first("x0").over(down), "first_x1": F.first("x1").over(down), "first_top": F.first("top").over(down)})
    rule = rule.where(f"first_top - c_bottom <= {RULE_GAP} AND abs(x0 - first_x0) <= {RULE_SLACK} AND abs(x1 - first_x1) <= {RULE_SLACK}")
    rule = _runs(rule, REGION, ["top", "x0", "x1"], F.col("top") - F.lag("top").over(down) > RULE_GAP, "run").where("run = 0")
    tops = F.array_sort(F.collect_list("top"))
    return rule.groupBy(*REGION).agg(F.min("x0").alias("left"), F.max("x1").alias("right"), tops.alias("tops")).where("size(tops) >= 2").select(*REGION, "left", F.col("tops")[0].alias("upper"), "right", F.element_at("tops", -1).alias("lower"), F.col("tops")[1].alias("header_bottom"))


def gutters(words: DataFrame) -> DataFrame:
    """Per region the centres of its white gutters, from words with their region's columns.

    A gutter is a gap between neighbours of a line, wide enough, with words on both sides of it in enough lines and
    through a word in few. Of gutters closer than the least width, or without a word between them, the left one counts.
    """
    above = Window.partitionBy(*REGION).orderBy("top", "x0", "x1")
    words = _runs(words, REGION, ["top", "x0", "x1"], F.col("top") - F.lag("top").over(above) > SAME_LINE, "line")
    beside = Window.partitionBy(*REGION, "line").orderBy("x0", "x1")
    words = words.withColumns({"from": F.lag("x1").over(beside), "height": F.col("bottom") - F.col("top")})
    lines = words.groupBy(*REGION, "line").agg(F.min("x1").alias("first"), F.max("x0").alias("last"), F.collect_list(F.struct("x0", "x1")).alias("spans"), F.collect_list(F.when(F.col("from").isNotNull(), F.struct(F.col("from").alias("x0"), F.col("x0").alias("x1")))).alias("gaps"), F.collect_list("height").alias("heights"))
    region = lines.groupBy(*REGION).agg(F.collect_list(F.struct("first", "last", "spans")).alias("lines"), F.flatten(F.collect_list("gaps")).alias("gaps"), F.array_sort(F.flatten(F.collect_list("heights"))).alias("heights"))
    n = F.size("heights")
    median = (F.get("heights", F.floor((n - 1) / 2).cast("int")) + F.get("heights", F.floor(n / 2).cast("int"))) / 2
    region = region.withColumn("least", F.greatest(F.lit(GUTTER), GUTTER_SHARE * median))
    middles = F.array_sort(F.transform(F.filter("gaps", lambda g: g["x1"] - g["x0"] >= F.col("least")), lambda g: (g["x0"] + g["x1"]) / 2))
    support = lambda c: F.size(F.filter("lines", lambda r: (r["first"] <= c) & (r["last"] >= c)))
    crossing = lambda c: F.size(F.filter("lines", lambda r: F.exists(r["spans"], lambda s: (s["x0"] < c) & (c < s["x1"]))))
    need = F.greatest(F.lit(2), F.least(F.lit(3), F.bround(F.size("lines") * SUPPORT_SHARE).cast("int")))
    kept = F.filter(middles, lambda c: (support(c) >= need) & (crossing(c) <= CROSSING_SHARE * F.size("lines")))
    between = lambda a, c: F.exists("lines", lambda r: F.exists(r["spans"], lambda s: (s["x0"] + s["x1"] >= 2 * a) & (s["x0"] + s["x1"] < 2 * c)))
    new = lambda a, c: (c - a >= F.col("least")) & between(a, c)
    apart = F.aggregate(kept, F.slice(kept, 1, 0), lambda out, c: F.when((F.size(out) > 0) & ~new(F.element_at(out, -1), c), out).otherwise(F.concat(out, F.array(c))))
    return region.select(*REGION, apart.alias("gutters")).where("size(gutters) BETWEEN 2 AND 15")


def gutter_rows(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows of tables that have horizontal rules only: rows (the header first), edges and continuations.

    Rows are visual lines: a wrapped cell is a row of its own, listed in ``continuations`` if its first cell is empty.
    A region is left out if it has under two gutters, a column without header or body text, or words of one cell and
    line that lie on each other; nothing is guessed for it.
    """
    inside = F.expr("(x0 + x1) / 2 BETWEEN left AND right AND (top + bottom) / 2 BETWEEN upper AND lower AND header_bottom > upper AND header_bottom < lower")
    held = _page(words).where("trim(text) <> ''").join(regions, PAGE).where(inside)
    columns = held.join(gutters(held), REGION).withColumns({"col": F.size(F.filter("gutters", lambda g: g <= (F.col("x0") + F.col("x1")) / 2)), "body": F.expr("(top + bottom) / 2 >= header_bottom")})
    above = Window.partitionBy(*REGION, "body").orderBy("top", "x0", "text")
    columns = _runs(columns, [*REGION, "body"], ["top", "x0", "text"], F.col("top") - F.lag("top").over(above) > SAME_LINE, "line")
    columns = columns.withColumn("row", F.when(F.col("body"), F.col("line") + 1).otherwise(0))
    beside = Window.partitionBy(*REGION, "body", "line", "col").orderBy("x0", "x1")
    columns = columns.withColumn("clash", F.coalesce(F.col("x0") < F.lag("x1").over(beside) - 0.1, F.lit(False)))
    parts = F.array_sort(F.collect_list(F.struct("line", "x0", F.trim("text").alias("text"))))
    cells = columns.groupBy(*REGION, "row", "col").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.max("clash").alias("clash"), F.first("gutters").alias("gutters"), F.first("left").alias("left"), F.first("right").alias("right"))
    lines = cells.groupBy(*REGION, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("texts"), F.max("clash").alias("clash"), F.first("gutters").alias("gutters"), F.first("left").alias("left"), F.first("right").alias("right"))
    lines = lines.withColumn("cells", F.transform(F.sequence(F.lit(0), F.size("gutters")), lambda c: F.coalesce(F.element_at("texts", c), F.lit(""))))
    out = lines.groupBy(*REGION).agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("numbered"), F.max("clash").alias("clash"), F.concat(F.array(F.first("left")), F.first("gutters"), F.array(F.first("right"))).alias("edges"))
    out = out.withColumn("rows", F.transform("numbered", lambda r: r["cells"]))
    whole = F.forall(F.sequence(F.lit(0), F.size("edges") - 2), lambda c: (F.get(F.col("rows")[0], c) != "") & F.exists(F.slice("rows", 2, F.greatest(F.lit(0), F.size("rows") - 1)), lambda r: F.get(r, c) != ""))
    late = F.filter(F.sequence(F.lit(0), F.size("rows") - 1), lambda k: (k > 0) & (F.get("rows", k)[0] == ""))
    return out.where((F.col("numbered")[0]["row"] == 0) & ~F.col("clash") & whole).select(*REGION, "rows", "edges", late.alias("continuations"))


def visual_lines(words: DataFrame, regions: DataFrame) -> DataFrame:
    """The lines of each region, as text in order: what is left of a table whose columns cannot be told."""
    inside = F.expr("(x0 + x1) / 2 BETWEEN left AND right AND (top + bottom) / 2 BETWEEN upper AND lower")
    held = _page(words).where("trim(text) <> ''").join(regions, PAGE).where(inside)
    above = Window.partitionBy(*REGION).orderBy("top", "x0", "text")
    held = _runs(held, REGION, ["top", "x0", "text"], F.col("top") - F.lag("top").over(above) > SAME_LINE, "line")
    lines = held.groupBy(*REGION, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", F.trim("text").alias("text")))), lambda p: p["text"]), " ").alias("text"))
    return lines.groupBy(*REGION).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: r["text"]).alias("lines"))
