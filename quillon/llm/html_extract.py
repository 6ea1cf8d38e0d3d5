"""Main text of web pages by wrapper induction.

Text blocks are counted over all pages of their host by place, which is the labels of the blocks
they lie in: a text that ``CONSTANT`` of the pages with its place have there is template, other texts
fill slots, and a place's slot mass is the characters of its slots on all pages. The region is the
lowest node of the host's page of least hash that holds most of the slot mass; an ``article`` or
``main`` that holds a good part of it, or of all text, states its own extent and is the region
as a whole. That page's skeleton, the place of the region in it and the digests of template texts are
the wrapper. Every page is aligned with its host's wrapper by simple tree matching, the largest common
ordered subtree, found by dynamic programming over children; the node that meets the region is its
content. Pages without a wrapper, or that do not meet it, use their own article, main or densest
node, without template texts unless it is an article.

Skeletons hold block elements at full depth, of each node's children the first ``ALIKE`` of one shape:
alignment needs no more of a long list, and its work stays bounded. Labels leave out digits.

Within the region, menus, footers, sidebars, forms, scripts and styles go by element and role, what is
hidden goes, and outside an article template texts go. Class and id words are the last resort, for
what varies and has no element of its own, as adverts and reader comments: a name counts only if all
its words are such hints or layout words (``ad-box``, not ``related-work``); n_hinted tells how many
elements of the region went by it alone.
A form goes with its text, unless an ``article`` or ``main`` lies in it: then it frames the page and stays.
Text: character references decoded, white space of a block as one space, blocks joined by one space.
Truncated and ill-nested markup is accepted. Null html: empty. Null url: no wrapper. Null ids and
repeated rows: each row gets its own result. Ties: the first page of least hash, the deepest of equal
regions. Pages are processed whole, however long; an empty table gives no rows; extra columns are
ignored. Wrappers are written, so that Spark knows their size: small, they are broadcast, else joined by host. Only places that ``LAYOUT``
of a host's pages have count, for templates and for mass, so a host has a bounded number of them.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, mapped, slices
from quillon.llm.urlfilter import host_of

#: Share of the pages with a place that have the same text there, from which the text is template.
CONSTANT = 0.9
#: Pages that must show a text for it to be template, and share of a host's pages that a place must be on.
LEAST_PAGES, LAYOUT = 3, 0.01
#: Share of the slot mass that the region holds, and that an article or main must hold to be it.
MOST, SEMANTIC = 0.8, 0.3
#: Children of one shape that a skeleton keeps of a node.
ALIKE = 16
#: Fixed values of the HTML standard: elements without content, and elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
CHROME = frozenset("nav footer aside form script style noscript template iframe button select textarea svg head title dialog menu object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
HINTS = frozenset("ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies discussion discussions disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
LAYOUT_WORDS = frozenset("area article bar block body bottom box btn button buttons card col column container content entry feed holder fixed footer group header icon inline inner item items left link links list main outer page panel post posts reader readers region right row section site slot space text thread threads unit title top user users wrap wrapper zone".split())
CLOSES_P = BLOCK - {"br", "body", "html", "caption", "td", "th", "tr", "li", "dd", "dt", "option", "optgroup", "title", "legend", "summary", "tbody", "thead", "tfoot"}
SCOPES = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(>|\Z)", re.S)
_attr = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I)
_end = re.compile(r"</(?:body|html)\s*>", re.I)
_split = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_digits = re.compile(r"[0-9]+")


def hints(value: str) -> bool:
    """Whether a class or id has a name that stands for what is not the main text."""
    for name in value.split():
        words = [w.lower() for w in _split.split(name) if w and not w.isdigit()]
        if any(w in HINTS for w in words) and all(w in HINTS or w in LAYOUT_WORDS for w in words):
            return True
    return False


class Node:
    """An element; children are nodes and strings in page order."""

    __slots__ = ("tag", "chrome", "hinted", "children", "label")

    def __init__(self, tag: str, attrs: str = "", inside_article: bool = False):
        self.tag, self.children = tag, []
        self.chrome = tag in CHROME or (tag == "header" and not inside_article)
        self.hinted = False
        self.label = tag
        if attrs and tag not in ("html", "body", "article", "main"):
            for m in _attr.finditer(attrs):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id"):
                    self.hinted |= hints(value)
                    if name == "class":
                        self.label = f"{tag}.{_digits.sub('', value.lower())}"
                elif name == "role":
                    self.chrome |= value.lower() in ROLES
                elif name == "style":
                    self.chrome |= "display:none" in value.lower().replace(" ", "")
                else:
                    self.chrome |= name == "hidden" or value.lower() == "true"
        self.hinted &= not self.chrome
        self.chrome |= self.hinted

    def elements(self) -> list[Node]:
        return [c for c in self.children if not isinstance(c, str)]


def parse(page: str) -> Node:
    """The page's tree; unclosed and misplaced tags are repaired as far as text extents need."""
    root = Node("#root")
    stack = [root]
    at, articles = 0, 0
    size = len(page)
    # how many elements of a tag are open: a closing tag without one is passed by at once
    opened: Counter = Counter()

    def close(k: int) -> None:
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:]

    while at < size:
        m = _token.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag] <= 0:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    articles -= sum(n.tag == "article" for n in stack[k:])
                    close(k)
                    break
                if stack[k].tag in ("article", "main", "body") and tag not in ("body", "html", "article", "main"):
                    break
            continue
        if not m[4]:
            break  # the page ends within a tag
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        elif tag in SCOPES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag or (tag in ("dd", "dt") and stack[k].tag in ("dd", "dt")) or (tag in ("td", "th") and stack[k].tag in ("td", "th")):
                    close(k)
                    break
                if stack[k].tag in SCOPES[tag]:
                    break
        node = Node(tag, m[3], articles > 0)
        stack[-1].children.append(node)
        if tag in ("article", "main"):
            # a form around it is the page's frame, not one of its forms
            for n in stack:
                n.chrome &= n.tag != "form"
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] += 1
            articles += tag == "article"
    return root


def digest(text: str) -> int:
    """A signed long that stands for a block's text."""
    return int.from_bytes(xxhash.xxh64_digest(text), "big", signed=True)


def placed(node: Node, above: int = 0) -> list[tuple[int, str]]:
    """(place, text) of the blocks under a node, without chrome; a place is the hash of the labels of the
    block elements from the root, whose place is ``above``, down to the text."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    at = here = above

    def close():
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((at, text))

    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, int):
            close()
            here = x
        elif isinstance(x, str):
            if not held:
                at = here
            held.append(x)
        elif not x.chrome:
            if x.tag in BLOCK:
                close()
                todo.append(here)
                here = xxhash.xxh64_intdigest(x.label, here)
            todo.extend(reversed(x.children))
    close()
    return out


def blocks(node: Node, template: frozenset[int] = frozenset()) -> list[str]:
    """Texts of the blocks under a node, without chrome and without blocks equal to template text."""
    texts = [text for _, text in placed(node)]
    return [text for text in texts if digest(text) not in template] if template else texts


def walk(root: Node) -> Iterator[Node]:
    """Nodes in page order."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(reversed(node.elements()))


def sizes(root: Node) -> dict[int, int]:
    """Characters of the words under each node (by id), without chrome, in one pass from the leaves up."""
    total: dict[int, int] = {}
    order: list[tuple[Node, Node | None]] = [(root, None)]
    for node, _ in order:
        if not node.chrome:
            order.extend((c, node) for c in node.elements())
    for node, above in reversed(order):
        own = 0 if node.chrome else sum(len(w) for c in node.children if isinstance(c, str) for w in html_lib.unescape(c).split())
        total[id(node)] = total.get(id(node), 0) + own
        if above is not None:
            total[id(above)] = total.get(id(above), 0) + total[id(node)]
    return total


def skeleton(node: Node) -> list:
    """[label, children, place among its siblings]: block structure for matching; inline elements and
    chrome contents are left out, and of children of one shape all but the first ``ALIKE``."""
    out: list = [node.label, [], 0]
    order, todo = [], [(node, out)]
    while todo:
        x, mine = todo.pop()
        order.append(mine)
        for k, c in enumerate(block_children(x)):
            mine[1].append([c.label, [], k])
            todo.append((c, mine[1][-1]))
    shapes: dict[tuple, int] = {}
    shape_of: dict[int, int] = {}
    for tree in reversed(order):  # children come before their parents
        kept, met = [], {}
        for c in tree[1]:
            shape = shape_of[id(c)]
            met[shape] = met.get(shape, 0) + 1
            if met[shape] <= ALIKE:
                kept.append(c)
        tree[1] = kept
        shape_of[id(tree)] = shapes.setdefault((tree[0], tuple(shape_of[id(c)] for c in kept)), len(shapes))
    return out


def real_path(tree: list, path: tuple[int, ...]) -> tuple[int, ...]:
    """Places among block children for a path of places in a skeleton."""
    out = []
    for k in path:
        tree = tree[1][k]
        out.append(tree[2])
    return tuple(out)


def flat(tree: list) -> list:
    """[depth, label] of a skeleton's nodes in page order; JSON of nested lists has a bounded depth."""
    out, todo = [], [(0, tree)]
    while todo:
        depth, (label, inner, *_) = todo.pop()
        out.append([depth, label])
        todo.extend((depth + 1, c) for c in reversed(inner))
    return out


def nested(rows: list) -> list:
    """The skeleton that ``flat`` wrote."""
    above: list = []
    for depth, label in rows:
        node = [label, []]
        del above[depth:]
        if above:
            above[-1][1].append(node)
        above.append(node)
    return above[0]


def block_children(node: Node) -> list[Node]:
    return [] if node.chrome else [c for c in node.elements() if c.tag in BLOCK and c.tag != "br" or c.chrome]


def match(a: list, b: list, memo: dict | None = None) -> int:
    """Simple tree matching: nodes of the largest common ordered subtree of two skeletons."""
    if a[0] != b[0]:
        return 0
    x, y = a[1], b[1]
    if not x or not y:
        return 1
    memo = {} if memo is None else memo
    key = (id(a), id(b))
    if key not in memo:
        # all pairs below, then their tables from the lowest up: trees may be deeper than calls can nest
        found = [(a, b)]
        for x, y in found:
            found.extend((p, q) for p in x[1] if p[1] for q in y[1] if q[1] and p[0] == q[0] and (id(p), id(q)) not in memo)
        for x, y in reversed(found):
            memo[id(x), id(y)] = 1 + _table(x[1], y[1], memo)[-1][-1]
    return memo[key]


def _table(x: list, y: list, memo: dict) -> list[list[int]]:
    rows = [[0] * (len(y) + 1)]
    for p in x:
        above, row = rows[-1], [0]
        for j, q in enumerate(y):
            best = above[j + 1] if above[j + 1] > row[j] else row[j]
            if p[0] == q[0] and (w := above[j] + match(p, q, memo)) > best:
                best = w
            row.append(best)
        rows.append(row)
    return rows


def pairs(x: list, y: list, memo: dict) -> list[tuple[int, int]]:
    """Places of the children that the matching of two child lists aligns."""
    rows, out = _table(x, y, memo), []
    i, j = len(x), len(y)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def aligned(a: list, b: list) -> dict[tuple[int, ...], tuple[int, ...]]:
    """Path in a to path in b for all aligned nodes."""
    memo: dict = {}
    out, todo = {(): ()}, [((), (), a, b)]
    while todo:
        p, q, x, y = todo.pop()
        for i, j in pairs(x[1], y[1], memo):
            out[(*p, i)] = (*q, j)
            todo.append(((*p, i), (*q, j), x[1][i], y[1][j]))
    return out


def at_path(node: Node, path: tuple[int, ...]) -> Node:
    for k in path:
        node = block_children(node)[k]
    return node


def own_text(node: Node) -> str:
    """Text of a node outside its block children."""
    return " ".join(html_lib.unescape("".join(c if isinstance(c, str) else " ".join(blocks(c)) for c in node.children if isinstance(c, str) or (c.tag not in BLOCK and not c.chrome))).split())


def block_places(root: Node) -> tuple[list[int], list[list[int]], list[tuple[int, int, str]]]:
    """Skeleton nodes by number, parents before children: parent of each, numbers of its block children, and
    (number of the nearest skeleton node, place, text) of the blocks, without chrome."""
    parents, inner_of, out = [-1], [], []
    nodes = [(root, 0)]
    for number, (node, above) in enumerate(nodes):
        inner = block_children(node)
        deeper = {id(c) for c in inner}
        # the node with its deeper blocks cut out: what is left is its own text, inline parts included
        bare = Node(node.tag)
        bare.label = node.label
        bare.children = [c if isinstance(c, str) or id(c) not in deeper else Node("br") for c in node.children]
        out += [(number, place, text) for place, text in placed(bare, above) if text]
        here = xxhash.xxh64_intdigest(node.label, above) if node.tag in BLOCK else above
        inner_of.append(list(range(len(nodes), len(nodes) + len(inner))))
        for c in inner:
            parents.append(number)
            # chrome keeps its number and has nothing below it
            nodes.append((c if not c.chrome else Node("br"), here))
    return parents, inner_of, out


def induce(pages: list[str], constant: frozenset[int] | None = None, mass: dict[int, tuple[int, int]] | None = None) -> dict | None:
    """The wrapper of a host's reference pages: skeleton, region path and digests of template texts.

    ``constant`` has the digests of the host's template texts and ``mass`` the slot and all characters
    of its places; without them, aligned nodes of equal text in all of ``pages`` are template, and the
    first page's own texts are the mass.
    """
    trees = [parse(p) for p in pages]
    skeletons = [skeleton(t) for t in trees]
    first, shape = trees[0], skeletons[0]
    parents, inner_of, found = block_places(first)
    if constant is None:
        same: dict[tuple[int, ...], int] = {}
        for tree, sk in zip(trees[1:], skeletons[1:]):
            for p, q in aligned(shape, sk).items():
                mine, theirs = at_path(first, real_path(shape, p)), at_path(tree, real_path(sk, q))
                same[p] = same.get(p, 0) + (not mine.chrome and own_text(mine) == own_text(theirs))
        everywhere = [own_text(at_path(first, real_path(shape, p))) for p, n in same.items() if n == len(pages) - 1]
        constant = frozenset(digest(t) for t in everywhere if t)
    if mass is None:
        mass = {}
        for _, place, text in found:
            slot, every = mass.get(place, (0, 0))
            mass[place] = (slot + len(text) * (digest(text) not in constant), every + len(text))
    shared = Counter(place for _, place, _ in found)
    slots, texts = [0.0] * len(parents), [0.0] * len(parents)
    for number, place, _ in found:
        slot, every = mass.get(place, (0, 0))
        slots[number] += slot / shared[place]
        texts[number] += every / shared[place]
    for number in range(len(parents) - 1, 0, -1):
        for held in (slots, texts):
            held[parents[number]] += held[number]
    if not slots[0] and not texts[0]:
        return None
    total, every = slots[0], texts[0]
    # skeleton nodes with their number, parent in the walk and place among its children
    walked: list[tuple[list, int, int, int, int]] = [(shape, 0, -1, 0, 0)]
    for at, (tree, number, _, _, depth) in enumerate(walked):
        walked.extend((c, inner_of[number][c[2]], at, k, depth + 1) for k, c in enumerate(tree[1]))

    def path_of(at: int) -> tuple[int, ...]:
        out = []
        while at:
            out.append(walked[at][3])
            at = walked[at][2]
        return tuple(reversed(out))

    semantic = [at for at, (tree, number, *_) in enumerate(walked) if tree[0] in ("article", "main") and (slots[number] > SEMANTIC * total or texts[number] > 0.5 * every)]
    if semantic:
        region = path_of(max(semantic, key=lambda at: (round(slots[walked[at][1]], 6), round(texts[walked[at][1]], 6), walked[at][4], -at)))
    elif not total:
        return None
    else:
        path, tree, number = [], shape, 0
        while True:
            deeper = [k for k, c in enumerate(tree[1]) if c[1] and slots[inner_of[number][c[2]]] > MOST * total]
            if not deeper:
                break
            path.append(deeper[0])
            tree = tree[1][deeper[0]]
            number = inner_of[number][tree[2]]
        region = tuple(path)
    template = sorted(constant)
    return {"skeleton": shape, "region": list(region), "template": [] if semantic else template, "outside": template}


def fallback(root: Node) -> Node:
    """A page's own article or main with most text, or the densest node."""
    size = sizes(root)
    every = [n for n in walk(root) if not n.chrome]
    for tag in ("article", "main"):
        if found := [n for n in every if n.tag == tag]:
            return max(found, key=lambda n: size.get(id(n), 0))
    best, total = root, size[id(root)]
    while True:
        deeper = [c for c in block_children(best) if not c.chrome and size[id(c)] > 0.8 * total and block_children(c)]
        if not deeper:
            return best
        best = deeper[0]


def region_of(page: str, wrapper: dict | None) -> tuple[Node, frozenset[int]]:
    """The content node of a page, given its host's wrapper, and the template texts to leave out of it."""
    root = parse(page)
    region = None
    if wrapper:
        shape = skeleton(root)
        found = _meet(wrapper["skeleton"], shape, tuple(wrapper["region"]))
        region = at_path(root, real_path(shape, found)) if found is not None else None
    if region is None or (region.tag not in ("article", "main") and any(n.tag in ("article", "main") for n in walk(root))):
        region = fallback(root)
        if wrapper and region.tag not in ("article", "main"):
            # another layout than the wrapper's, or a page that ends before it: what is not template on the host
            return region, frozenset(wrapper["outside"])
    return region, frozenset(wrapper["template"]) if wrapper else frozenset()


def main_text(page: str | None, wrapper: dict | None) -> str:
    """Main text of a page, given its host's wrapper."""
    return " ".join(blocks(*region_of(page, wrapper))) if page else ""


def hinted_elements(region: Node) -> int:
    """Elements with text under a node that class and id words alone leave out."""
    n, todo = 0, list(region.elements())
    while todo:
        x = todo.pop()
        if x.hinted:
            bare = Node(x.tag)
            bare.chrome, bare.children = False, x.children
            n += bool(blocks(bare))
        elif not x.chrome:
            todo.extend(x.elements())
    return n


def _meet(a: list, b: list, target: tuple[int, ...]) -> tuple[int, ...] | None:
    """The path in b that the matching aligns with ``target`` in a."""
    memo: dict = {}
    out = []
    if a[0] != b[0]:
        return None
    for k in target:
        found = [j for i, j in pairs(a[1], b[1], memo) if i == k]
        if not found:
            return None
        a, b = a[1][k], b[1][found[0]]
        out.append(found[0])
    return tuple(out)


def counted(source: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, place, text, n, lo, hi, chars) over all pages of ``source`` (host, h, html).

    Per text (its digest) of a place, per place (text null) and per host (place null): pages, least and
    greatest page hash, characters. The last block of a page that ends without </body> or </html> may
    be cut, and does not count.
    """
    schema = pa.schema([("host", pa.string()), *((c, pa.int64()) for c in ("place", "text", "n", "lo", "hi", "chars"))])

    def seen(batches):
        for batch in batches:
            held: dict[tuple, list[int]] = {}
            for part in slices(batch):
                for host, h, page in zip(*(part.column(k).to_pylist() for k in range(3))):
                    found = placed(parse(page))
                    if found and not _end.search(page):
                        found.pop()
                    sizes: Counter = Counter()
                    for place, text in found:
                        place = signed(place)
                        sizes[host, place, digest(text)] += len(text)
                        sizes[host, place, None] += len(text)
                    sizes[host, None, None] = sum(len(t) for _, t in found)
                    for key, n in sizes.items():
                        if x := held.get(key):
                            x[0], x[1], x[2], x[3] = x[0] + 1, min(x[1], h), max(x[2], h), x[3] + n
                        else:
                            held[key] = [1, h, h, n]
            rows = [(*key, *x) for key, x in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, schema)], schema=schema)

    counts = source.select("host", "h", "html").mapInArrow(seen, "host string, place long, text long, n long, lo long, hi long, chars long")
    counts = counts.groupBy("host", "place", "text").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("chars").alias("chars"))
    return scratch.table(counts.filter("text IS NULL OR lo < hi"))


def signed(x: int) -> int:
    """An unsigned 64-bit value as a long."""
    return x - (1 << 64) if x >> 63 else x


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, wrapper as JSON) of every host."""
    html = pages["html"].cast("string")
    source = pages.select(host_of(pages["url"].cast("string")).alias("host"), F.xxhash64(html).alias("h"), html.alias("html")).filter("host <> '' AND html <> ''")

    def least(batches):
        for batch in batches:
            hosts, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held: dict[str, int] = {}
            for k, (host, h) in enumerate(zip(hosts, hashes)):
                if host not in held or h < hashes[held[host]]:
                    held[host] = k
            yield batch.take(pa.array(sorted(held.values()), pa.int64()))

    some = source.mapInArrow(least, "host string, h long, html string").groupBy("host").agg(F.min_by("html", "h").alias("html"))
    counts = counted(source, scratch)
    of_host = counts.filter("place IS NULL").select("host", F.col("n").alias("of_host"))
    places = counts.filter("place IS NOT NULL AND text IS NULL").select("host", "place", F.col("n").alias("pages"), F.col("chars").alias("every"))
    places = places.join(of_host, "host").filter(F.col("pages") >= LAYOUT * F.col("of_host"))
    same = counts.filter(F.col("text").isNotNull() & (F.col("n") >= LEAST_PAGES)).join(places, ["host", "place"]).filter(F.col("n") >= CONSTANT * F.col("pages"))
    constant = same.groupBy("host").agg(F.collect_set("text").alias("constant"))
    fixed = same.groupBy("host", "place").agg(F.sum("chars").alias("fixed"))
    slot = F.struct("place", (F.col("every") - F.coalesce("fixed", F.lit(0))).alias("slot"), "every")
    mass = places.join(fixed, ["host", "place"], "left").groupBy("host").agg(F.collect_list(slot).alias("mass"))
    arrow = pa.schema([("host", pa.string()), ("wrapper", pa.string())])

    def rows_of(part: pa.RecordBatch) -> dict:
        out = []
        for page, constant, mass in zip(*(part.column(k).to_pylist() for k in (1, 2, 3))):
            places = {m["place"] % (1 << 64): (m["slot"], m["every"]) for m in mass or ()}
            wrapper = induce([page], frozenset(constant or ()), places)
            out.append(json.dumps(wrapper and wrapper | {"skeleton": flat(wrapper["skeleton"])}))
        return {"host": part.column(0), "wrapper": out}

    return mapped(some.join(constant, "host", "left").join(mass, "host", "left").select("host", "html", "constant", "mass"), rows_of, "host string, wrapper string", arrow)


def read_wrapper(text: str | None) -> dict | None:
    """A wrapper from its JSON."""
    wrapper = json.loads(text) if text else None
    return wrapper and {k: frozenset(v) if k in ("template", "outside") else nested(v) if k == "skeleton" else v for k, v in wrapper.items()}


def extracted(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Per row: page_id, url, text, n_chars and n_hinted."""
    scratch = scratch or Scratch(pages.sparkSession)
    known = scratch.table(wrappers(pages, scratch))
    source = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    joined = source.withColumn("host", host_of(F.col("url"))).join(known, "host", "left").select("page_id", "url", "html", "wrapper")
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_hinted", pa.int64())])
    cache: dict[str | None, dict | None] = {}

    def rows_of(part: pa.RecordBatch) -> dict:
        texts, hinted = [], []
        for page, wrapper in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
            if wrapper not in cache:
                if len(cache) > 1000:
                    cache.clear()
                cache[wrapper] = read_wrapper(wrapper)
            region = region_of(page, cache[wrapper]) if page else None
            texts.append(" ".join(blocks(*region)) if region else "")
            hinted.append(hinted_elements(region[0]) if region else 0)
        return {"page_id": part.column(0), "url": part.column(1), "text": texts, "n_chars": [len(t) for t in texts], "n_hinted": hinted}

    return mapped(joined, rows_of, "page_id long, url string, text string, n_chars long, n_hinted long", arrow)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
