"""Ruled tables against grids drawn at random, and their single rules."""

import json
import random

import pytest

from quillon.operators import layout, ruled

BOX = "x0 double, top double, x1 double, bottom double"
PAGE = "doc_id long, page_number int"


def boxes(spark, rows):
    return spark.createDataFrame([(*r[:2], *map(float, r[2:])) for r in rows], f"{PAGE}, {BOX}")


def words(spark, rows):
    return spark.createDataFrame([(d, p, t, *map(float, b)) for d, p, t, *b in rows], f"{PAGE}, text string, {BOX}")


def drawn(rng, page):
    """(cells, strokes, words) of a random grid with merged cells: every inner side of a slot is drawn unless merged."""
    n, m = rng.randrange(2, 6), rng.randrange(2, 6)
    xs, ys = ([start + sum(steps[:k]) for k in range(len(steps) + 1)] for start, steps in ((50, [rng.randrange(30, 90) for _ in range(m)]), (100, [rng.randrange(15, 40) for _ in range(n)])))
    owner = {(r, c): (r, c, 1, 1) for r in range(n) for c in range(m)}
    for _ in range(rng.randrange(3)):
        r, c = rng.randrange(n), rng.randrange(m)
        h, w = rng.randrange(1, n - r + 1), rng.randrange(1, m - c + 1)
        slots = [(i, j) for i in range(r, r + h) for j in range(c, c + w)]
        if h * w < n * m and all(owner[s][2:] == (1, 1) for s in slots):
            for s in slots:
                owner[s] = (r, c, h, w)
    off = lambda: rng.uniform(-0.8, 0.8)
    strokes = []
    for r in range(n):
        for c in range(m):
            for other, line in (((r - 1, c), (xs[c], ys[r], xs[c + 1], ys[r])), ((r + 1, c), (xs[c], ys[r + 1], xs[c + 1], ys[r + 1])), ((r, c - 1), (xs[c], ys[r], xs[c], ys[r + 1])), ((r, c + 1), (xs[c + 1], ys[r], xs[c + 1], ys[r + 1]))):
                if owner.get(other) != owner[r, c]:
                    d = off()
                    flat = line[1] == line[3]
                    strokes.append((page, 1, line[0] + (0 if flat else d), line[1] + (d if flat else 0), line[2] + (0 if flat else d), line[3] + (d if flat else 0)))
    cells, text = {}, []
    for r, c, h, w in set(owner.values()):
        said = []
        for k in range(rng.randrange(3)):
            x, y = xs[c] + 4 + 8 * k, ys[r] + 3
            said.append(f"w{r}{c}{k}")
            text.append((page, 1, said[-1], x, y, x + 6, y + 8))
        cells[r, c, h, w] = " ".join(said)
    return cells, strokes, text


def test_random_grids(spark):
    rng = random.Random(4)
    pages = {k: drawn(rng, k) for k in range(60)}
    strokes = boxes(spark, [s for _, lines, _ in pages.values() for s in lines])
    text = words(spark, [w for *_, t in pages.values() for w in t])
    got = {}
    for r in ruled.table_cells(text, strokes).collect():
        got.setdefault(r.doc_id, {})[r.row, r.col, r.row_span, r.col_span] = r.text
        assert r.table_no == 1
    for k, (cells, *_) in pages.items():
        rows, cols = sorted({c[0] for c in cells} | {c[0] + c[2] for c in cells}), sorted({c[1] for c in cells} | {c[1] + c[3] for c in cells})
        # A row or column line inside merged cells only is not drawn, so it is not an edge.
        want = {(rows.index(r), cols.index(c), rows.index(r + h) - rows.index(r), cols.index(c + w) - cols.index(c)): t for (r, c, h, w), t in cells.items()}
        if len(want) > 1:
            assert got[k] == want, k


def grid(x, y, cols, rows, page=1):
    across = [(1, page, x, y + 20 * r, x + 50 * cols, y + 20 * r) for r in range(rows + 1)]
    return across + [(1, page, x + 50 * c, y, x + 50 * c, y + 20 * rows) for c in range(cols + 1)]


def test_two_grids_loose_strokes_and_no_text(spark):
    strokes = [*grid(50, 100, 2, 2), *grid(300, 100, 3, 1), (1, 1, 50, 500, 400, 500), (1, 1, 60, 300, 60, 350), (1, 1, 10, 10, 11, 11), (1, 2, 0, 0, 50, 50), *grid(50, 100, 2, 2, 3)[:-1]]
    got = ruled.table_cells(words(spark, [(1, 1, "a", 60, 105, 70, 115), (1, 1, " ", 310, 105, 320, 115), (1, 4, "b", 60, 105, 70, 115)]), boxes(spark, strokes)).collect()
    shape = {}
    for r in got:
        shape.setdefault((r.page_number, r.table_no), []).append((r.row, r.col, r.text, r.n_words))
    assert sorted(shape) == [(1, 1), (1, 2), (3, 1)]
    assert sorted(shape[1, 1]) == [(0, 0, "a", 1), (0, 1, "", 0), (1, 0, "", 0), (1, 1, "", 0)]
    # Without its right side the last column is open: only the closed one is left.
    assert sorted(shape[3, 1]) == [(0, 0, "", 0), (1, 0, "", 0)] and len(shape[1, 2]) == 3
    assert ruled.lattice(boxes(spark, [])).count() == 0
    found = {(r.page_number, r.table_no): r for r in ruled.tables(ruled.table_cells(words(spark, []), boxes(spark, strokes))).collect()}
    assert not any(r.supported for r in found.values()) and found[1, 2].rows == [["", "", ""]]


def test_words_outside_and_in_holes_are_not_lost(spark):
    strokes = grid(50, 100, 3, 3)
    text = [(1, 1, "edge", 199.5, 145, 202, 155), (1, 1, "above", 110, 98, 120, 102), (1, 1, "in", 110, 125, 120, 135), (1, 1, "far", 400, 125, 410, 135)]
    got = {(r.row, r.col): r.text for r in ruled.table_cells(words(spark, text), boxes(spark, strokes)).collect() if r.n_words}
    assert got == {(2, 2): "edge", (0, 1): "above", (1, 1): "in"}
    # Five boxes around a place that no rule closes from above.
    hole = [(1, 1, *b) for b in ((50, 100, 100, 120), (150, 100, 200, 120), (50, 120, 100, 140), (150, 120, 200, 140), (100, 120, 150, 140))]
    cells = ruled.table_cells(words(spark, [(1, 1, "lost", 120, 105, 130, 115)]), boxes(spark, hole)).collect()
    assert sum(r.n_words for r in cells) == 1


def test_lines_in_a_cell_and_cut_words(spark):
    text = [(1, 1, "second", 55, 112, 80, 118), (1, 1, "b", 70, 101, 75, 107), (1, 1, "a", 55, 102, 60, 108), (1, 1, "through", 60, 125, 120, 135)]
    cells = ruled.table_cells(words(spark, text), boxes(spark, grid(50, 100, 2, 2)))
    assert {(r.row, r.col): r.text for r in cells.collect() if r.text} == {(0, 0): "a b second", (1, 0): "through"}
    assert ruled.tables(cells).first().status == "visual_lines"
    head = ruled.tables(ruled.table_cells(words(spark, [(1, 1, "through", 60, 105, 120, 115)]), boxes(spark, grid(50, 100, 2, 2))))
    assert head.first().status == "header_uncertain"


def test_text_support_counts_empty_rows(spark):
    text = [(1, 1, f"w{r}{c}", 55 + 50 * c, 105 + 20 * r, 70 + 50 * c, 112 + 20 * r) for r in range(2) for c in range(2)]
    dense = ruled.tables(ruled.table_cells(words(spark, text), boxes(spark, grid(50, 100, 2, 5)))).first()
    sparse = ruled.tables(ruled.table_cells(words(spark, text), boxes(spark, grid(50, 100, 2, 6)))).first()
    assert (dense.supported, sparse.supported) == (True, False)


def caption_page(spark, lines, rules):
    caption = boxes(spark, [(1, 1, 50, 80, 200, 90)])
    text = [(1, 1, t, x, y, x + 8 * len(t), y + 8) for y, line in lines for x, t in line]
    return words(spark, text), ruled.ruled_regions(caption, boxes(spark, rules))


def test_regions_between_rules(spark):
    rules = [(1, 1, 50, 100, 300, 100), (1, 1, 52, 120, 298, 120), (1, 1, 50, 110, 140, 110), (1, 1, 50, 200, 300, 200), (1, 1, 50, 480, 300, 480), (1, 1, 400, 100, 560, 100)]
    got = ruled.ruled_regions(boxes(spark, [(1, 1, 50, 80, 200, 90)]), boxes(spark, rules)).collect()
    assert [(r.left, r.upper, r.right, r.lower, r.header_bottom) for r in got] == [(50, 100, 300, 200, 120)]
    two = ruled.ruled_regions(boxes(spark, [(1, 1, 50, 80, 200, 90), (1, 1, 50, 150, 200, 160)]), boxes(spark, rules)).collect()
    assert [(r.region_no, r.upper, r.lower) for r in two] == [(1, 100, 120)]
    assert ruled.ruled_regions(boxes(spark, [(1, 1, 50, 700, 200, 710)]), boxes(spark, rules)).count() == 0


def test_gutter_rows_and_refusals(spark):
    rules = [(1, 1, 45, 95, 300, 95), (1, 1, 45, 115, 300, 115), (1, 1, 45, 220, 300, 220)]
    lines = [(100, [(50, "name"), (120, "low"), (200, "high")]), (120, [(50, "x"), (124, "1"), (200, "2")]), (140, [(50, "yy"), (121, "3"), (206, "4")]), (155, [(206, "more")])]
    text, regions = caption_page(spark, lines, rules)
    got = ruled.gutter_rows(text, regions).collect()
    assert [r.rows for r in got] == [[["name", "low", "high"], ["x", "1", "2"], ["yy", "3", "4"], ["", "", "more"]]]
    assert got[0].continuations == [3] and len(got[0].edges) == 4
    # A column without a heading, and a table of one gutter, are not guessed.
    assert ruled.gutter_rows(*caption_page(spark, [(100, [(50, "name"), (120, "low")]), *lines[1:]], rules)).count() == 0
    assert ruled.gutter_rows(*caption_page(spark, [(y, line[:2]) for y, line in lines], rules)).count() == 0
    assert ruled.visual_lines(text, regions).first().lines == ["name low high", "x 1 2", "yy 3 4", "more"]


def test_figures_of_drawn_panels():
    panel = lambda x, y=100.0, w=90.0, h=100.0: (x, y, x + w, y + h)
    find = lambda *b: layout.vector_figures(list(b), 612.0, 792.0)
    assert find(panel(50.0), panel(160.0)) == [(48.0, 88.0, 252.0, 200.0)]
    assert find(panel(50.0), panel(50.0), panel(55.0, 105.0, 80.0, 90.0)) == [(48.0, 88.0, 142.0, 200.0)]
    assert len(find(panel(50.0), panel(200.0))) == 2 and len(find(panel(50.0), panel(160.0, 180.0))) == 2
    assert find(panel(50.0), panel(52.0, 220.0)) == [(48.0, 88.0, 144.0, 320.0)]
    assert find((0.0, 0.0, 70.0, 300.0), (0.0, 0.0, 300.0, 60.0)) == []
    # Joined through a third panel, found later than both.
    assert len(find(panel(50.0), panel(270.0), panel(160.0))) == 1


def test_caption_statuses():
    match = layout.match_captions
    far = match([(0, 240, 50, 250)], [(45, 0, 95, 90)])[0]
    assert (far["status"], far["candidates"]) == ("ambiguous", [0])
    assert match([(0, 100, 50, 110)], [(0, 85, 50, 90)])[0]["status"] == "unmatched"
    vector = match([(0, 100, 50, 110)], [], [(0, 0, 50, 95)])[0]
    assert (vector["status"], vector["source"], vector["image"]) == ("matched", "vector", 0) and 0.9 < vector["confidence"] < 1
    both = match([(0, 100, 50, 110)], [(0, 0, 50, 95)], [(0, 0, 50, 95)])[0]
    assert both["source"] == "image"
    assert match([(0, 100, 50, 110)], [], [(0, 0, 50, 95), (0, 0, 50, 90)])[0]["status"] == "unmatched"


def test_a_drawn_figure_becomes_a_region(spark):
    text = words(spark, [(1, 1, "Figure", 50, 205, 90, 215), (1, 1, "1:", 95, 205, 105, 215), (1, 1, "x", 110, 205, 140, 215)])
    paths = boxes(spark, [(1, 1, 50, 100, 150, 200), (1, 1, 400, 100, 500, 200)])
    rows = layout.elements(text, paths=paths).orderBy("order_index").collect()
    assert [r.element_type for r in rows] == ["figure_caption", "image_region"]
    relation = json.loads(rows[0].relation)
    assert relation["status"] == "matched" and relation["source"] == "vector" and rows[1].bbox == pytest.approx([48, 88, 152, 200])
