import json
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import decontam, html_extract, packing


def brute_tiling(item, doc, least=5):
    """Greedy tiles by trying every pair of places."""
    used_i, used_j, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in used_i and j + n not in used_j:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return total
        n, i, j = best
        used_i |= set(range(i, i + n))
        used_j |= set(range(j, j + n))
        total += n


def test_tiling_equals_brute_force(monkeypatch):
    monkeypatch.setattr(decontam, "MIN_COVERAGE", 0.01)
    rng = np.random.default_rng(3)
    for _ in range(60):
        item = [str(x) for x in rng.integers(0, 3, rng.integers(5, 20))]
        doc = [str(x) for x in rng.integers(0, 4, rng.integers(0, 40))] + item[:7]
        got = decontam.Index([(1, " ".join(item))]).leaks(" ".join(doc))
        want = brute_tiling(item, doc)
        assert (got[0][2] if got else 0) == want


def test_leaks_and_stage(spark, make):
    item = "The quick brown fox, jumps over the lazy dog while many birds sing in old trees near here"
    words = item.split()
    moved = " ".join(words[9:] + ["and", "so"] + words[:9])
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (7, item)], "item_id long, text string")
    rows = [(1, "x " * 50 + item.upper() + " y"), (2, moved), (3, " ".join(words[:6]) + " z" * 40), (4, None), (None, item), (5, ""), (1, "clean")]
    got = decontam.leaked_items(make(rows), bench).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in got) == [(-1, 7), (-1, 7), (1, 7), (1, 7), (2, 7), (2, 7)]
    assert {r["n_tiles"] for r in got if r["doc_id"] == 2} == {2}
    blocks = decontam.leaked_items(make(rows), bench, block_chars=10).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, got))
    kept = decontam.clean_documents(make(rows), bench)
    assert kept.columns == make([]).columns and sorted(r["text"] or "" for r in kept.collect()) == sorted(["clean", "", rows[2][1], ""])
    assert decontam.leaked_items(make([]), bench).count() == 0
    assert decontam.leaked_items(make(rows), bench.limit(0)).count() == 0


def test_items_of_few_words_are_found_whole(spark, make):
    bench = spark.createDataFrame([(1, "Paris, of course!"), (2, "Four words stand here"), (3, "?!"), (4, "x")], "item_id long, text string")
    rows = [(1, "they said paris of course and left"), (2, "paris of nothing course"), (3, "(four) words STAND here."), (4, "four words stand"), (5, "an x there"), (6, "")]
    got = {(r["doc_id"], r["item_id"], r["n_item_words"], r["n_tiled"]) for r in decontam.leaked_items(make(rows), bench).collect()}
    assert got == {(1, 1, 3, 3), (3, 2, 4, 4), (5, 4, 1, 1)}
    assert sorted(r["doc_id"] for r in decontam.clean_documents(make(rows), bench).collect()) == [2, 4, 6]


def test_repetitive_texts_make_no_product_of_places():
    import time

    item = " ".join(["so", "it", "goes"] * 134)
    index = decontam.Index([(1, item), (2, " ".join(f"w{k}" for k in range(300)))])
    started = time.time()
    assert index.leaks(" ".join(["so", "it", "goes"] * 70_000)) == [(1, 402, 402, 1)]
    mixed = " ".join(f"w{k}" for s in range(299, -1, -7) for k in range(s - 6, s + 1) if k >= 0)
    (found,) = index.leaks(mixed + " so it goes" * 60_000)[1:]
    assert found[0] == 2 and found[2] >= 0.9 * 300 and found[3] > 30
    assert time.time() - started < 20


def test_query_equals_brute_force(spark, make):
    rng = np.random.default_rng(11)
    words = np.array("alpha beta gamma delta eps zeta eta theta iota kappa".split())
    items = [" ".join(rng.choice(words, n)) for n in (3, 5, 8, 12, 15, 20)]
    docs = []
    for k in range(40):
        parts = [" ".join(rng.choice(words, 12))]
        for _ in range(rng.integers(0, 4)):
            x = items[rng.integers(0, len(items))].split()
            a = rng.integers(0, max(1, len(x) - 4))
            parts.append(" ".join(x[a : a + rng.integers(3, 14)]))
        docs.append((k, " ".join(parts)))
    want = set()
    for d, text in docs:
        for i, item in enumerate(items):
            total = brute_tiling(item.split(), text.split(), min(5, len(item.split())))
            if total >= 0.6 * len(item.split()):
                want.add((d, i, total))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["n_tiled"]) for r in decontam.leaked_items(make(docs), bench).collect()} == want and want


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizers_library(documents, tokenizer):
    enc = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r["text"] or "" for r in documents.select("text").collect()] + ["", " ", "<|endoftext|>", "a<|endoftext|>b", "é字🙂\u0000", "x" * 5000, " \n\t  end ", "don't I'LL"]
    for text in texts:
        assert packing.token_ids(enc, text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def check_packing(df, rows, tokenizer, capacity=1024):
    want = []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (s, n) in enumerate(packing.cuts(len(ids), capacity)):
            want.append((doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
    got = packing.packed(df, capacity=capacity, island=64).collect()
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got)
    bins: dict = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r["length"] for r in got)


def test_packing_holds_every_piece_once(documents, tokenizer):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    n, tokens = check_packing(documents, rows, tokenizer)
    assert n <= -(-tokens // 1024) + 6


def test_packing_edges(make, tokenizer):
    rows = [(1, None), (1, None), (None, ""), (2, "word " * 5000), (3, "a"), (3, "a")]
    check_packing(make(rows), rows, tokenizer, 64)
    assert packing.packed(make([])).count() == 0
    assert packing.cuts(2048) == [(0, 1024), (1024, 1024)] and packing.cuts(1030) == [(0, 6), (6, 1024)]


def test_genetic_steps_keep_all_pieces():
    import random
    from collections import Counter

    rng = random.Random(0)
    lengths = [rng.randint(1, 1023) for _ in range(400)]
    stock = Counter(lengths)
    a = [tuple(b) for b in packing.best_fit([], sorted(lengths, reverse=True), 1024)]
    b = packing.mutate(a, rng, 1024)
    for bins in (a, b, packing.crossover(a, b, stock, rng, 1024), packing.immigrate(b, a[:50] + [(1024,)], stock, 1024), packing.evolve(lengths, b, a[:9], 1)):
        assert Counter(n for x in bins for n in x) == stock and all(sum(x) <= 1024 for x in bins)
    assert len(packing.evolve(lengths, a, [], 1)) <= len(a)


def test_the_search_saves_sequences_over_best_fit():
    import random
    from collections import Counter

    rng = random.Random(1)
    lengths = []
    for _ in range(300):
        a = rng.randint(260, 420)
        b = rng.randint(260, min(420, 1024 - a - 260))
        lengths += [a, b, 1024 - a - b]
    plain = packing.best_fit([], sorted(lengths, reverse=True), 1024)
    found = packing.evolve(lengths, None, [], 7)
    assert Counter(n for x in found for n in x) == Counter(lengths) and all(sum(x) <= 1024 for x in found)
    assert len(plain) - len(found) >= 20 and len(found) <= 310
    better = packing.evolve(lengths, found, found[:50], 8)
    assert len(better) <= len(found)


def test_replacement_keeps_all_pieces_and_fills_bins():
    import random

    rng = random.Random(5)
    for _ in range(200):
        loose = [[rng.randint(1, 40) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(0, 6))]
        loose = [b for b in loose if sum(b) <= 100]
        displaced = [rng.randint(1, 60) for _ in range(rng.randint(0, 8))]
        before, fill = sorted([n for b in loose for n in b] + displaced), [sum(b) for b in loose]
        pool = packing.replaced(loose, displaced, 100)
        assert sorted([n for b in loose for n in b] + pool) == before and pool == sorted(pool)
        assert all(f <= sum(b) <= 100 for f, b in zip(fill, loose))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/a">{0}</a></li></ul></nav><div class="ad">buy {0}</div><div id="cookie-notice">we use</div><form><p>mail</p></form>
{open}<h1>Head {0} &amp; more</h1><p><b>Text {0} &eacute;<br><p>sec&shy;ond&nbsp; {0}
 line</p>{close}<section class="comments"><p>reader {0}</p></section><footer>&copy; all</footer></body></html>"""


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def want(k):
    return f"Head {k} & more Text {k} é sec­ond {k} line"


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<div class='post'>", "</div>")])
def test_main_text(spark, tags):
    page = lambda k: PAGE.format(k, open=tags[0], close=tags[1])
    rows = [(k, "http://h.org/x", page(f"w{k} and some more of the text of page {k}")) for k in range(6)]
    got = {r["page_id"]: r["text"] for r in html_extract.extracted(pages_of(spark, rows)).collect()}
    assert got == {k: want(f"w{k} and some more of the text of page {k}") for k in range(6)}


def test_page_edges(spark):
    whole = PAGE.format("x", open="<article>", close="</article>")
    cut = whole[: whole.index("sec&shy;ond") + 2]
    rows = [(1, None, whole), (2, "http://a.b/", None), (2, "http://a.b/", ""), (3, "http://a.b/", cut), (None, "http://a.b/", whole), (4, "http://c.d/", "plain &lt;b&gt; text"), (5, "http://e.f/", "<p>a<p>b</div><li>c"), (6, "http://g.h/", "<article>" + "<div>" * 3000 + "deep")]
    got = html_extract.extracted(pages_of(spark, rows)).collect()
    by = {(r["page_id"], r["url"]): r["text"] for r in got}
    assert by[(1, None)] == want("x") and by[(None, "http://a.b/")] == want("x") and by[(2, "http://a.b/")] == ""
    assert by[(3, "http://a.b/")] == "Head x & more Text x é se"
    assert by[(4, "http://c.d/")] == "plain <b> text" and by[(5, "http://e.f/")] == "a b c" and by[(6, "http://g.h/")] == "deep"
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extracted(pages_of(spark, [])).count() == 0


def test_tree_matching():
    t = lambda tag, *kids: [tag, list(kids)]
    a, b = t("r", t("a", t("x")), t("b"), t("c")), t("r", t("b"), t("a", t("x"), t("y")), t("c"))
    assert html_extract.match(a, b) == 4
    assert html_extract.aligned(a, b)[(2,)] == (2,)
    assert html_extract.match(a, t("q")) == 0


def test_template_is_what_stays_and_copies_keep_their_text():
    page = lambda k: f"<body><div class='x'><p>Welcome to our lovely shop</p></div><div class='y'><p>{k} long story number {k} goes on and on with {k}</p></div></body>"
    wrapper = html_extract.induce([page("one"), page("two"), page("three")])
    assert html_extract.main_text(page("four"), wrapper) == "four long story number four goes on and on with four"


def test_other_layout_on_a_host_with_articles_keeps_its_text():
    page = lambda x: f"<html><body><div class=top>All about us</div><article><p>long story number {x} goes on</p></article></body></html>"
    wrapper = html_extract.induce([page("one"), page("two"), page("three")])
    other = "<html><body><div class=top>All about us</div><div class=text><p>told without an article</p><p>to its end</p></div></body></html>"
    assert html_extract.main_text(other, wrapper) == "told without an article to its end"
    assert html_extract.main_text("<html><body><div class=top>All about us</div>", wrapper) == ""


def test_regions_and_constants_at_any_depth():
    deep = lambda x, n: "<html><body>" + "<div>" * n + f"<div>Our partners and friends</div><div class=t><p>words of {x}</p><p>more {x} words told at some length</p></div>" + "</div>" * n + "</body></html>"
    for n in (14, 3000):
        wrapper = html_extract.induce([deep(x, n) for x in ("one", "two")])
        kept = html_extract.read_wrapper(json.dumps(wrapper | {"skeleton": html_extract.flat(wrapper["skeleton"])}))
        assert kept["skeleton"][1][0][0] == "html" and html_extract.main_text(deep("three", n), kept) == "words of three more three words told at some length"


def test_constants_come_from_all_pages_and_layouts(spark):
    layouts = ["<html><body><div class=a><div>Our partners</div><p>{0} first</p><p>then {0}</p></div></body></html>", "<html><body><div class=b><div>Read our terms</div><section><p>{0} second</p><p>and {0}</p></section></div></body></html>"]
    rows = [(k, f"http://two.com/{k}", layouts[k % 2].format(f"tale{k}")) for k in range(40)] + [(100 + k, f"http://two.com/c{k}", layouts[0].format("copied")) for k in range(5)]
    got = {r["page_id"]: r["text"] for r in html_extract.extracted(pages_of(spark, rows)).collect()}
    assert all(got[k] == (f"tale{k} second and tale{k}" if k % 2 else f"tale{k} first then tale{k}") for k in range(40))
    assert all(got[100 + k] == "copied first then copied" for k in range(5))


SLOTS = "<html><body><div class=c1><ul><li>menu {0} one</li><li>menu {0} two</li></ul></div><div class=c2>offer of {0} today, only here and now</div><div class=c3><div class=c5><p>{1}</p><p>told by {0}</p></div></div><div class=c4>foot of {0}</div></body></html>"


def test_the_wrapper_decides_where_no_element_or_class_word_does(spark):
    story = lambda k: " ".join(f"word{k}x{j}" for j in range(2 if k % 4 == 0 else 60))
    rows = [(k, "http://plain.com/x", SLOTS.format(f"number {k}", story(k))) for k in range(24)]
    got = {r["page_id"]: r["text"] for r in html_extract.extracted(pages_of(spark, rows)).collect()}
    assert got == {k: f"{story(k)} told by number {k}" for k in range(24)}
    alone = {k: html_extract.main_text(page, None) for k, _, page in rows}
    assert alone[0] != got[0] and "menu" in alone[0] and alone != got


def brute_match(a, b):
    """Largest common ordered subtree by trying all ways to pair children."""
    if a[0] != b[0]:
        return 0

    def ways(x, y):
        if not x or not y:
            return 0
        out = max(ways(x[1:], y), ways(x, y[1:]))
        if x[0][0] == y[0][0]:
            out = max(out, brute_match(x[0], y[0]) + ways(x[1:], y[1:]))
        return out

    return 1 + ways(a[1], b[1])


def test_tree_matching_equals_brute_force():
    rng = np.random.default_rng(9)

    def tree(depth):
        return ["abc"[rng.integers(0, 3)], [tree(depth - 1) for _ in range(rng.integers(0, 4))] if depth else []]

    for _ in range(150):
        a, b = ["r", tree(3)[1]], ["r", tree(3)[1]]
        want = brute_match(a, b)
        assert html_extract.match(a, b) == want
        path = html_extract.aligned(a, b)
        assert len(path) == want and all(len(p) == len(q) for p, q in path.items())


def test_template_counts_equal_brute_force(spark, sf_dir):
    from collections import Counter, defaultdict

    from quillon.llm.common import Scratch
    from quillon.llm.urlfilter import host_of

    df = spark.read.parquet(f"{sf_dir}/pages.parquet").limit(60)
    rows = df.select(host_of(df["url"]).alias("host"), "html").collect() + [("two.com", SLOTS.format(f"n{k}", "the same story")) for k in range(5)]
    want, seen = Counter(), defaultdict(set)
    for host, html in rows:
        found = html_extract.placed(html_extract.parse(html))
        if "</body>" not in html and "</html>" not in html:  # cut off: its last block may be, too
            found = found[:-1]
        for key in {(host, html_extract.signed(p), html_extract.digest(t)) for p, t in found} | {(host, html_extract.signed(p), None) for p, _ in found} | {(host, None, None)}:
            want[key] += 1
            seen[key].add(html)
    source = spark.createDataFrame([(h, hash(x), x) for h, x in rows], "host string, h long, html string")
    got = {(r["host"], r["place"], r["text"]): r["n"] for r in html_extract.counted(source, Scratch(spark)).collect()}
    assert got == {k: n for k, n in want.items() if k[2] is None or len(seen[k]) > 1}


def test_class_words_and_broken_attributes():
    text = lambda x: html_extract.main_text(f"<body><article><p>start</p>{x}<p>end</p></article></body>", None)
    assert text("<div class='related-work'>kept</div><section id='comments-on-method'>this too</section>") == "start kept this too end"
    assert text("<div class='ad-box x'>gone</div><div id=cookieNotice>gone</div><div class='site-header2'>stays</div><div class='comment-list'>gone</div><div class=sidebar-left>gone</div>") in ("start stays end", "start end")
    assert text("<p title=it's>Hello</p><a href=x?a=\"b\" title='>'>link</a><p title=\"a>b\">more</p>") == "start Hello link more end"
    region = html_extract.region_of("<body><article><p>a</p><div class=ad>b</div><nav>c</nav><div class=ad></div></article></body>", None)[0]
    assert html_extract.hinted_elements(region) == 1


def test_many_siblings_and_long_pages(spark):
    import time

    items = "".join(f"<li class=i{k}>item {k}</li><p>text {k}</p>" for k in range(4000))
    page = lambda x: f"<body><div class=a><ul>{x} {items}</ul></div><div class=b><p>{x} and {x}</p></div></body>"
    started = time.time()
    wrapper = html_extract.induce([page("one"), page("two")])
    assert html_extract.main_text(page("three"), wrapper)
    assert time.time() - started < 10
    long = "<article>" + "<p>some words of it</p>" * 50_000 + "</article>"
    df = pages_of(spark, [(1, "http://l.com/", long), (1, "http://l.com/", long)]).selectExpr("*", "1 AS text", "2 AS wrapper", "'x' AS host", "3 AS n_chars", "4 AS constant")
    got = html_extract.extracted(df).collect()
    assert len(got) == 2 and {r["n_chars"] for r in got} == {50_000 * 17 - 1}


def test_deep_and_unclosed_pages_take_linear_time():
    began = time.time()
    for page in ("<html><body>" + "<div>" * 20_000 + "text of the page", "<html><body>" + "<div><b>" * 10_000 + "</i>" * 20_000 + "text of the page", "<p>" * 20_000 + "text of the page"):
        wrapper = html_extract.induce([page], frozenset(), None)
        assert html_extract.main_text(page, None) == html_extract.main_text(page, wrapper) == "text of the page"
    assert time.time() - began < 20


def test_comments_adverts_and_forms_around_articles():
    parts = "".join(f'<div class="{name}"><p>not the text</p></div>' for name in ("reader-comments", "comment-thread", "discussion", "ad-slot", "ad_zone sponsored"))
    page = f'<body><form action="/x"><article><h1>Title</h1><p>The text.</p>{parts}</article></form></body>'
    assert html_extract.main_text(page, None) == "Title The text."
    assert html_extract.main_text("<body><p>The text.</p><form><p>Your name</p></form></body>", None) == "The text."
    kept = '<body><article><div class="reader-guide"><p>The text.</p></div><div class="thread-safety"><p>More.</p></div></article></body>'
    assert html_extract.main_text(kept, None) == "The text. More."


def test_common_short_items_are_listed_and_not_looked_for(make, spark):
    items = [(1, "the"), (2, "der die"), (3, "la vie est"), (4, None), (5, "four words exactly there"), (6, "...")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = make([*((k, "the der die la vie est the") for k in range(30)), (50, "here are four words, exactly there, in a text"), (51, "four words exactly"), (52, None)])
    assert [(r["doc_id"], r["item_id"]) for r in decontam.leaked_items(docs, benchmark).collect()] == [(50, 5)]
    assert sorted(r["doc_id"] for r in decontam.clean_documents(docs, benchmark).collect()) == [*range(30), 51, 52]
    assert sorted(map(tuple, decontam.common_items(docs, benchmark).collect())) == [(1, 1, 30), (2, 2, 30), (3, 3, 30)]
    few = docs.where("doc_id < 20 OR doc_id >= 50")
    assert decontam.common_items(few, benchmark).count() == 0 and decontam.clean_documents(few, benchmark).count() == 2
