"""Positioned words, strokes, boxes and images of PDF files, page by page.

``pdf_pages`` is a data source: a task reads one part of a file's pages, so a long file spreads over
tasks, and the driver plans from names and sizes alone. ``page_things`` does the same for a column of
bytes, as ``binaryFile`` gives. A page that cannot be read is one ``warning`` row, and so is a file:
nothing else is lost with it. The reader knows plain and Flate streams, object streams, simple and
two-byte fonts with widths and ToUnicode maps; encrypted files and other filters give warnings. It
reads geometry and characters, no more: what they mean is ``layout``'s and ``ruled``'s work.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Pages and bytes of a file at most.
MOST_PAGES, MOST_BYTES = 500, 40_000_000
#: Bytes of a file for each part that its pages are read in.
PART_BYTES = 2_000_000
#: Parts of the size above and below the base line; a gap that ends a word, in sizes; what a character without a width takes.
ASCENT, DESCENT, WORD_GAP, USUAL_WIDTH = 0.75, 0.25, 0.2, 0.5
#: A drawn box thinner than this is a stroke.
THIN = 1.5
THING = "page_number int, kind string, text string, x0 double, top double, x1 double, bottom double, page_width double, page_height double"
_ARROW = [("page_number", pa.int32()), ("kind", pa.string()), ("text", pa.string()), *((c, pa.float64()) for c in ("x0", "top", "x1", "bottom", "page_width", "page_height"))]

_space = rb"\x00\t\n\x0c\r "
_token = re.compile(rb"[" + _space + rb"]*(?:%[^\r\n]*[" + _space + rb"]*)*(<<|>>|[\[\]{}]|/[^" + _space + rb"()<>\[\]{}/%]*|\(|<[0-9A-Fa-f" + _space + rb"]*>|[^" + _space + rb"()<>\[\]{}/%]+)")
_object = re.compile(rb"(?<![0-9])(\d{1,10})[" + _space + rb"]+(\d{1,5})[" + _space + rb"]+obj\b")
_stream = re.compile(rb"[" + _space + rb"]*stream\r?\n")
_escape = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
FAULTS = (ValueError, KeyError, IndexError, TypeError, AttributeError, ArithmeticError, RecursionError, zlib.error)


class Name(str):
    """A name, as /Font."""


class Ref(int):
    """The number of another object."""


class Tokens:
    """Values and operators of a piece of PDF syntax, in order; operators are bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def __iter__(self) -> Iterator:
        while (value := self.value()) is not None:
            yield value

    def value(self):
        m = _token.match(self.data, self.at)
        if not m:
            return None
        t, self.at = m[1], m.end()
        if t == b"(":
            return self._string()
        if t in (b"<<", b"["):
            items = []
            while (v := self.value()) is not None and v not in (b">>", b"]"):
                if v == b"R" and len(items) > 1:
                    items[-2:] = [Ref(items[-2])]
                else:
                    items.append(v)
            return items if t == b"[" else {str(k): v for k, v in zip(items[::2], items[1::2])}
        if t[:1] == b"/":
            return Name(t[1:].decode("latin-1"))
        if t[:1] == b"<":
            digits = re.sub(rb"[" + _space + rb"]", b"", t[1:-1])
            return bytearray.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        try:
            return int(t) if t.lstrip(b"+-").isdigit() else float(t)
        except ValueError:
            return t

    def _string(self) -> bytearray:
        """A string is a bytearray, so that it cannot be taken for an operator."""
        out, depth, data = bytearray(), 1, self.data
        while self.at < len(data):
            c = data[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                c = data[self.at : self.at + 1]
                self.at += 1
                if c.isdigit():
                    octal = re.compile(rb"[0-7]{1,3}").match(data, self.at - 1)
                    out.append(int(octal[0], 8) & 255)
                    self.at = octal.end()
                elif c not in (b"\n", b"\r"):
                    out += _escape.get(c, c)
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
        return out


class File:
    """Objects of a file, read when they are asked for."""

    def __init__(self, data: bytes):
        if len(data) > MOST_BYTES:
            raise ValueError("too long")
        if not data.startswith(b"%PDF-"):
            raise ValueError("not a PDF")
        self.data, self.held = data, {}
        self.places = {int(m[1]): m.end() for m in _object.finditer(data)}
        if b"/Encrypt" in data:
            raise ValueError("encrypted")
        if b"/ObjStm" in data:
            for number in list(self.places):
                d, stream = self.whole(number)
                if isinstance(d, dict) and d.get("Type") == "ObjStm" and stream is not None:
                    body = self.decoded(d, stream)
                    head = [v for v, _ in zip(Tokens(body), range(2 * self.get(d["N"])))]
                    for n, at in zip(head[::2], head[1::2]):
                        self.held.setdefault(n, (Tokens(body, self.get(d["First"]) + at).value(), None))
        catalogs = [d for n in [*self.places, *self.held] if isinstance(d := self.get(Ref(n)), dict) and d.get("Type") == "Catalog"]
        if not catalogs:
            raise ValueError("no catalog")
        self.pages = list(self._pages(catalogs[-1]["Pages"]))
        if not 1 <= len(self.pages) <= MOST_PAGES:
            raise ValueError(f"{len(self.pages)} pages")

    def whole(self, number: int) -> tuple:
        """An object and the bytes of its stream, or None."""
        if number not in self.held:
            tokens = Tokens(self.data, self.places[number])
            value, stream = tokens.value(), None
            if isinstance(value, dict) and (m := _stream.match(self.data, tokens.at)):
                size = value.get("Length")
                size = size if not isinstance(size, Ref) else self.get(size)
                end = m.end() + size if isinstance(size, int) else -1
                if end < 0 or not re.compile(rb"[" + _space + rb"]*endstream").match(self.data, end):
                    end = self.data.index(b"endstream", m.end())
                stream = self.data[m.end() : end]
            self.held[number] = value, stream
        return self.held[number]

    def get(self, value):
        return self.whole(value)[0] if isinstance(value, Ref) else value

    def decoded(self, d: dict, stream: bytes) -> bytes:
        filters = self.get(d.get("Filter")) or []
        for name in filters if isinstance(filters, list) else [filters]:
            if name != "FlateDecode" or self.get(d.get("DecodeParms")):
                raise ValueError(f"filter {name}")
            stream = zlib.decompressobj().decompress(stream)
        return stream

    def _pages(self, root) -> Iterator[dict]:
        todo, seen = [(root, {})], set()
        while todo and len(seen) <= 4 * MOST_PAGES:
            ref, above = todo.pop()
            if int(ref) in seen:
                continue
            seen.add(int(ref))
            node = self.get(ref)
            if not isinstance(node, dict):
                yield {"fault": "page is no dictionary"}
                continue
            node = above | node
            if "Kids" in node:
                passed = {k: node[k] for k in ("Resources", "MediaBox") if k in node}
                todo += [(k, passed) for k in reversed(self.get(node["Kids"]))]
            else:
                yield node

    def font(self, ref) -> tuple[int, dict, float, dict]:
        """Bytes of a code, widths, the usual width and characters of a font."""
        d = self.get(ref)
        inner = self.get(self.get(d["DescendantFonts"])[0]) if "DescendantFonts" in d else None
        first = self.get(d.get("FirstChar", 0))
        widths = {first + k: w / 1000 for k, w in enumerate(self.get(d.get("Widths")) or []) if isinstance(w, int | float)}
        usual = USUAL_WIDTH
        if inner is not None:
            usual, items = self.get(inner.get("DW", 1000)) / 1000, list(self.get(inner.get("W")) or [])
            while len(items) > 1:
                a, b = items[0], self.get(items[1])
                widths |= {a + k: w / 1000 for k, w in enumerate(b)} if isinstance(b, list) else {k: items[2] / 1000 for k in range(a, b + 1)}
                del items[: 2 if isinstance(b, list) else 3]
        chars: dict[int, str] = {}
        if "ToUnicode" in d:
            held: list = []
            number, text = (lambda v: int.from_bytes(v, "big")), (lambda v: bytes(v).decode("utf-16-be", "replace"))
            for v in Tokens(self.decoded(*self.whole(d["ToUnicode"]))):
                if v in (b"beginbfchar", b"beginbfrange"):
                    held = []
                elif v == b"endbfchar":
                    chars |= {number(a): text(b) for a, b in zip(held[::2], held[1::2])}
                elif v == b"endbfrange":
                    for a, b, c in zip(held[::3], held[1::3], held[2::3]):
                        for k in range(number(a), min(number(b), number(a) + 65535) + 1):
                            chars[k] = text(c[k - number(a)]) if isinstance(c, list) else text(c[:-2] + (number(c[-2:]) + k - number(a)).to_bytes(2, "big"))
                else:
                    held.append(v)
        return 2 if inner is not None else 1, widths, usual, chars


def times(a: tuple, b: tuple) -> tuple:
    """The transformation a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def placed_on(file: File, page: dict) -> tuple[float, float, list[tuple]]:
    """Width, height and (kind, text, x0, top, x1, bottom) of what a page shows."""
    if "fault" in page:
        raise ValueError(page["fault"])
    left, low, right, high = (float(file.get(v)) for v in file.get(page.get("MediaBox", [0, 0, 612, 792])))
    contents = file.get(page.get("Contents")) if not isinstance(page.get("Contents"), Ref) or isinstance(file.get(page["Contents"]), list) else [page["Contents"]]
    body = b"\n".join(file.decoded(*file.whole(c)) for c in contents or [])
    resources = file.get(page.get("Resources")) or {}
    fonts, images = file.get(resources.get("Font")) or {}, file.get(resources.get("XObject")) or {}
    known: dict[str, tuple] = {}
    out, glyphs, path, operands, saved = [], [], [], [], []
    at, line, matrix = (1.0, 0, 0, 1.0, 0, 0), (1.0, 0, 0, 1.0, 0, 0), (1.0, 0, 0, 1.0, 0, 0)
    font, size, leading, spacing, blank, start = (1, {}, USUAL_WIDTH, {}), 1.0, 0.0, 0.0, 0.0, None

    def corner(m, x, y):
        return x * m[0] + y * m[2] + m[4] - left, high - (x * m[1] + y * m[3] + m[5])

    def box(kind, text, points):
        xs, ys = zip(*points)
        out.append((kind, text, min(xs), min(ys), max(xs), max(ys)))

    def show(codes):
        nonlocal matrix
        wide, widths, usual, chars = font
        for k in range(0, len(codes) - wide + 1, wide):
            code = int.from_bytes(codes[k : k + wide], "big")
            text = chars.get(code) or (bytes([code]).decode("cp1252", "replace") if wide == 1 else "�")
            width = widths.get(code, usual) * size
            whole = times(matrix, at)
            glyphs.append((text, corner(whole, 0, -DESCENT * size), corner(whole, width, ASCENT * size), abs(size * whole[3]) or abs(size * whole[0])))
            matrix = times((1, 0, 0, 1, width + spacing + (blank if code == 32 and wide == 1 else 0), 0), matrix)

    def next_line(x, y):
        nonlocal line, matrix
        line = matrix = times((1, 0, 0, 1, x, y), line)

    for v in Tokens(body):
        if not isinstance(v, bytes) or v in (b"true", b"false", b"null"):
            operands.append(v)
            continue
        n = operands
        operands = []
        if v == b"q":
            saved.append((at, font, size))
        elif v == b"Q" and saved:
            at, font, size = saved.pop()
        elif v == b"cm":
            at = times(tuple(n[-6:]), at)
        elif v == b"BT":
            line = matrix = (1.0, 0, 0, 1.0, 0, 0)
        elif v == b"Tf":
            if n[-2] not in known:
                known[n[-2]] = file.font(fonts[n[-2]]) if n[-2] in fonts else (1, {}, USUAL_WIDTH, {})
            font, size = known[n[-2]], float(n[-1])
        elif v in (b"Td", b"TD"):
            leading = -n[-1] if v == b"TD" else leading
            next_line(n[-2], n[-1])
        elif v == b"Tm":
            line = matrix = tuple(n[-6:])
        elif v == b"TL":
            leading = n[-1]
        elif v == b"Tc":
            spacing = n[-1]
        elif v == b"Tw":
            blank = n[-1]
        elif v == b"T*":
            next_line(0, -leading)
        elif v in (b"Tj", b"'", b'"'):
            if v != b"Tj":
                next_line(0, -leading)
            show(n[-1])
        elif v == b"TJ":
            for x in n[-1]:
                if isinstance(x, bytearray):
                    show(x)
                else:
                    matrix = times((1, 0, 0, 1, -x / 1000 * size, 0), matrix)
        elif v == b"re":
            x, y, w, h = n[-4:]
            path.append([corner(at, x, y), corner(at, x + w, y + h)])
        elif v == b"m":
            start = corner(at, *n[-2:])
        elif v in (b"l", b"c", b"v", b"y") and start:
            end = corner(at, *n[-2:])
            path.append([start, end])
            start = end
        elif v in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"):
            for p in path:
                wide, tall = abs(p[0][0] - p[1][0]), abs(p[0][1] - p[1][1])
                box("path" if wide > THIN and tall > THIN else "stroke", None, p)
            path = []
        elif v == b"n":
            path = []
        elif v == b"Do" and n and (file.get(images.get(n[-1])) or {}).get("Subtype") == "Image":
            box("image", None, [corner(at, 0, 0), corner(at, 1, 1)])
    word: list[tuple] = []
    for g in [*glyphs, (" ", (0, 0), (0, 0), 0)]:
        near = word and abs(g[1][1] - word[-1][1][1]) <= 0.1 * g[3] and -0.5 * g[3] <= g[1][0] - word[-1][2][0] <= WORD_GAP * g[3]
        if word and (g[0].isspace() or not near):
            box("word", "".join(w[0] for w in word), [p for w in word for p in w[1:3]])
            word = []
        if not g[0].isspace():
            word.append(g)
    return right - left, high - low, out


def things_of(data: bytes, part: int = 0, parts: int = 1) -> Iterator[tuple]:
    """Rows of ``THING`` for every ``parts``-th share of a file's pages; faults are rows too."""
    try:
        file = File(data)
    except FAULTS as e:
        if part == 0:
            yield (None, "warning", f"{type(e).__name__}: {e}", None, None, None, None, None, None)
        return
    n = len(file.pages)
    for k in range(n * part // parts, n * (part + 1) // parts):
        try:
            width, height, found = placed_on(file, file.pages[k])
        except FAULTS as e:
            yield (k + 1, "warning", f"{type(e).__name__}: {e}", None, None, None, None, None, None)
            continue
        for kind, text, *sides in found:
            yield (k + 1, kind, text, *map(float, sides), width, height)


def page_things(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Rows of ``THING`` after the key of each file; a file without content is a warning."""
    kind = dict(files.dtypes)[key]

    def run(batches):
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1)):
                rows = list(things_of(data.as_py() or b""))
                columns = [pa.array([k.as_py()] * len(rows), batch.schema.field(0).type), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(_ARROW), _ARROW))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, *(n for n, _ in _ARROW)])

    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, {THING}")


class Part(InputPartition):
    def __init__(self, path: str, part: int, parts: int):
        super().__init__((path, part, parts))
        self.path, self.part, self.parts = path, part, parts


class PdfPages(DataSource):
    """``spark.read.format("pdf_pages").load(folder)``: things of all PDF files below a folder, or of one file.

    Options: partBytes, the bytes of a file for each part of its pages. The path is any that pyarrow opens.
    """

    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return f"path string, {THING}"

    def reader(self, schema) -> DataSourceReader:
        return PdfReader(self.options)


class PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.part_bytes = options["path"], int(options.get("partBytes", PART_BYTES))

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        here = files.get_file_info(at)
        found = [here] if here.type == fs.FileType.File else files.get_file_info(fs.FileSelector(at, recursive=True))
        named = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".pdf"))
        out = []
        for path, size in named:
            parts = max(1, min(MOST_PAGES, -(-size // self.part_bytes)))
            out += [Part(path, k, parts) for k in range(parts)]
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        from pyarrow import fs

        files = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with files.open_input_stream(partition.path) as f:
            data = f.read(MOST_BYTES + 1)
        for row in things_of(data, partition.part, partition.parts):
            yield (partition.path, *row)
