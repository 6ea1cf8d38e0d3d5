"""Text functions as Spark columns.

SQL fragments that both Spark and DuckDB read are built as strings by the ``*_sql`` functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

# Unicode full case folding of the characters that fold to ASCII letters.
CASEFOLD = {
    "ß": "ss", "ŉ": "ʼn", "ſ": "s", "ǰ": "ǰ", "ẖ": "ẖ", "ẗ": "ẗ", "ẘ": "ẘ", "ẙ": "ẙ", "ẚ": "aʾ",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
}

# The code points that are split into overlapping pairs.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3134F}"
TOKEN = rf"[{CJK}]+|[a-z0-9]+(?:[-'][a-z0-9]+)*"

# Plurals with a singular of their own, words that stay, and -ie words.
IRREGULAR_PLURALS = {
    "analyses": "analysis",
    "aliases": "alias",
    "atlases": "atlas",
    "axes": "axis",
    "biases": "bias",
    "bases": "basis",
    "canvases": "canvas",
    "crises": "crisis",
    "diagnoses": "diagnosis",
    "hypotheses": "hypothesis",
    "indices": "index",
    "lenses": "lens",
    "matrices": "matrix",
    "parentheses": "parenthesis",
    "theses": "thesis",
    "gases": "gas",
    "statuses": "status",
    "vertices": "vertex",
}
UNCHANGED_WORDS = ("atlas", "alias", "bias", "canvas", "gas", "lens", "mathematics", "news", "physics", "series", "species", "statistics", "status")
IE_WORDS = ("brownies", "cookies", "groupies", "movies", "rookies", "selfies", "zombies")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(s: str) -> str:
    """A SQL string literal that Spark and DuckDB read alike (no backslash)."""
    return "'" + s.replace("'", "''") + "'"


def casefold_sql(x: str) -> str:
    out = f"lower({x})"
    for a, b in CASEFOLD.items():
        out = f"replace({out}, {quoted(a)}, {quoted(b)})"
    return out


def plural_fold_sql(t: str) -> str:
    """Singular of an English token; the first rule that fits decides."""
    listed = lambda words: ", ".join(map(quoted, words))
    irregular = " ".join(f"WHEN {t} = {quoted(k)} THEN {quoted(v)}" for k, v in IRREGULAR_PLURALS.items())
    cut = lambda n: f"left({t}, length({t}) - {n})"
    return f"""CASE WHEN right({t}, 1) <> 's' THEN {t} {irregular}
 WHEN {t} IN ({listed(UNCHANGED_WORDS)}) THEN {t}
 WHEN {t} IN ({listed((*IE_WORDS, "ties"))}) THEN {cut(1)}
 WHEN length({t}) > 4 AND right({t}, 3) = 'ies' THEN {cut(3)} || 'y'
 WHEN length({t}) > 4 AND (right({t}, 4) IN ('ches', 'shes', 'sses') OR right({t}, 3) IN ('xes', 'zes')) THEN {cut(2)}
 WHEN length({t}) > 3 AND right({t}, 2) NOT IN ('ss', 'us', 'is') AND right({t}, 3) <> 'ics' THEN {cut(1)}
 ELSE {t} END"""


def casefold(c: Column) -> Column:
    """Case folding as far as tokens need it; plain ASCII takes the short way."""
    out = F.lower(c)
    for a, b in CASEFOLD.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(is_ascii(c), F.lower(c)).otherwise(out)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def plural_fold(c: Column) -> Column:
    """Singular of an English token, as a column."""
    return F.transform(F.array(c), lambda t: _fold(t))[0]


def _fold(t: Column) -> Column:
    short = lambda n: F.substring(t, F.lit(1), F.length(t) - n)
    ends = lambda *s: t.rlike("(?:" + "|".join(s) + ")$")
    irregular = F.create_map(*[F.lit(x) for kv in IRREGULAR_PLURALS.items() for x in kv])
    return (
        F.when(~t.endswith("s"), t)
        .when(t.isin(*IRREGULAR_PLURALS), irregular[t])
        .when(t.isin(*UNCHANGED_WORDS), t)
        .when(t.isin(*IE_WORDS, "ties"), short(1))
        .when((F.length(t) > 4) & t.endswith("ies"), F.concat(short(3), F.lit("y")))
        .when((F.length(t) > 4) & ends("ches", "shes", "sses", "xes", "zes"), short(2))
        .when((F.length(t) > 3) & ~ends("ss", "us", "is", "ics"), short(1))
        .otherwise(t)
    )


def tokens(c: Column) -> Column:
    """Array of search tokens: folded Latin words and numbers, and overlapping pairs of CJK characters."""
    raw = F.regexp_extract_all(casefold(c), F.lit(TOKEN), F.lit(0))

    def expand(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
        return F.when(~t.rlike(f"^[{CJK}]"), F.array(_fold(t))).when(F.length(t) == 1, F.array(t)).otherwise(pairs)

    has_pairs = ~is_ascii(c) & c.rlike(f"[{CJK}]")
    return F.when(has_pairs, F.flatten(F.transform(raw, expand))).otherwise(F.transform(raw, _fold))


def tokens_sql(x: str) -> str:
    """DuckDB form of ``tokens``."""
    pattern = TOKEN.replace("'", "''")
    return f"""flatten(list_transform(regexp_extract_all({casefold_sql(x)}, '{pattern}'), lambda t:
 CASE WHEN NOT regexp_matches(t, '^[{CJK}]') THEN [{plural_fold_sql("t")}] WHEN length(t) = 1 THEN [t]
 ELSE list_transform(range(1, length(t)), lambda i: substring(t, i, 2)) END))"""


def squeeze(c: Column) -> Column:
    """White space runs to one space, ends trimmed; Unicode white space counts."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def ascii_lower(c: Column) -> Column:
    """Only A-Z are folded, as catalogue search does."""
    return F.translate(c, UPPER, LOWER)


def contains_fact(text: Column, fact: Column) -> Column:
    """Containment after case folding and white space collapse."""
    return F.contains(squeeze(casefold(text)), squeeze(casefold(fact)))


def doi(c: Column) -> Column:
    """Normal form of a DOI, or null."""
    x = F.lower(F.trim(c))
    x = F.regexp_replace(x, r"^https?://(?:dx\.)?doi\.org/", "")
    x = F.trim(F.regexp_replace(x, r"^doi:\s*", ""))
    return F.when((F.length(c) <= 500) & x.rlike(r"^10\.\d{4,9}/\S+$"), x)


def arxiv_id(c: Column) -> Column:
    """Normal form of an arXiv id or address without its version, or null; old ids in lower case."""
    x = F.trim(c)
    x = F.regexp_replace(x, r"^https?://(?:www\.|export\.)?arxiv\.org/(?:abs|pdf)/", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\.pdf$", ""), r"v\d+$", "")
    return F.when(x.rlike(r"^\d{4}\.\d{4,5}$"), x).when(x.rlike(r"(?i)^[a-z-]+(?:\.[a-z]{2})?/\d{7}$"), F.lower(x))


def work_id(c: Column) -> Column:
    """Last part of a work's address if it is W and digits, or null."""
    tail = F.substring_index(F.trim(c), "/", -1)
    return F.when(tail.rlike(r"^W\d+$"), tail)


def author_id(c: Column) -> Column:
    """Last part of an author's address if it is A and digits, or null."""
    tail = F.substring_index(F.trim(c), "/", -1)
    return F.when(tail.rlike(r"^A\d+$"), tail)


def arxiv_query(c: Column) -> Column:
    """A query term whose backslashes and quotes are spaces."""
    return F.translate(c, '\\"', "  ")


def compact(c: Column) -> Column:
    """Case-folded text without anything but word characters."""
    return F.regexp_replace(casefold(c), r"(?U)\W+", "")


WORK_CITATION = r"\bW\d+\b"
ARXIV_CITATION = r"(?i)\b(?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?\b"


def inline_citations(c: Column) -> Column:
    """Work and arXiv ids that a text cites, in order of each kind."""
    return F.concat(F.regexp_extract_all(c, F.lit(WORK_CITATION), F.lit(0)), F.regexp_extract_all(c, F.lit(ARXIV_CITATION), F.lit(0)))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON of flat fields with sorted keys and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def sorted_fields(c: Column, kind: DataType) -> Column:
    """A value whose structs, at any depth, have their fields by name, as canonical JSON wants them."""
    if isinstance(kind, StructType):
        inner = F.struct(*[sorted_fields(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(c.isNotNull(), inner)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: sorted_fields(x, kind.elementType))
    return c


def nested_json(df: DataFrame, column: str) -> Column:
    """Canonical JSON of a struct or array column of a DataFrame: sorted keys at all depths, nulls kept."""
    return F.to_json(sorted_fields(F.col(column), df.schema[column].dataType), {"ignoreNullFields": "false"})


def content_sha256(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(fields), 256)


def row_ranges(rows: Column) -> Column:
    """Sorted row numbers as ranges: 1-3,5."""
    marked = F.transform(rows, lambda x, i: F.struct(x.alias("x"), (x - i).alias("g")))
    groups = F.array_distinct(F.transform(marked, lambda m: m["g"]))

    def show(g: Column) -> Column:
        own = F.transform(F.filter(marked, lambda m: m["g"] == g), lambda m: m["x"])
        low, high = F.array_min(own), F.array_max(own)
        return F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string")))

    return F.array_join(F.transform(groups, show), ",")


# Section names that count as headings without a number.
NAMED_HEADINGS = (
    "abstract", "introduction", "background", "related work", "methods", "methodology", "materials and methods",
    "results", "discussion", "conclusion", "references", "acknowledgments", "ethics approval", "data availability statement",
    "摘要", "引言", "相关工作", "方法", "实验结果", "讨论", "结论", "参考文献",
)
NUMBERED_HEADING = r"^(\d+(?:\.\d+)*)(?:[.)])?\s+([A-Za-z][^.!?]{1,120})$"
FIGURE_CAPTION = r"(?i)^(?:fig(?:ure)?\.?|图)\s*\d+[A-Za-z]?(?:\s*[:.)-]\s*|$)"
TABLE_CAPTION = r"(?i)^table\s*(\d+[A-Za-z]?|[IVXLCDM]+)\s*[:.)-]"


def line_kind(c: Column) -> Column:
    """heading, figure_caption, table_caption or paragraph."""
    x = squeeze(c)
    heading = x.rlike(NUMBERED_HEADING) | casefold(F.regexp_replace(x, r"[:：.]$", "")).isin(*NAMED_HEADINGS)
    return F.when(x.rlike(FIGURE_CAPTION), "figure_caption").when(x.rlike(TABLE_CAPTION), "table_caption").when(heading, "heading").otherwise("paragraph")


# Fragments of scientific table headers and captions as text extraction leaves them, and what they stand for.
SPLIT_STRICT = (r"\bV\s*\(\s*%\s*\)\s+strict\b", "V_strict (%)")
SPLIT_TRIPLE = (r"\(\s*([fD])\s*,\s*([fD])\s*,\s*([fD])\s*\)\s*([pt])\s+([pt])\s+([pt])", "($1_$4, $2_$5, $3_$6)")
SPLIT_IVIM = (r"\bIVIM\s*\(\s*f\s*_?\s*p\s*,\s*D\s*_?\s*t\s*,\s*D\s*_?\s*p\s*\)", "IVIM (f_p, D_t, D_p)")
SPLIT_DELTA = (r"^([∆Δ])\s+vs\.(.*)\s+strict\s*$", "$1V_strict vs.$2")


def header_label(above: Column, label: Column) -> Column:
    """A table header's label with its split subscript put back; ``above`` is the header over it, which
    holds the lone V of a difference."""
    moved = (F.trim(F.coalesce(above, F.lit(""))) == "V") & label.rlike(SPLIT_DELTA[0])
    return F.regexp_replace(F.when(moved, F.regexp_replace(label, *SPLIT_DELTA)).otherwise(label), *SPLIT_STRICT)


def subscripts(c: Column) -> Column:
    """A text on one line with the subscripts that stood on a line of their own."""
    return F.regexp_replace(F.regexp_replace(squeeze(c), *SPLIT_TRIPLE), *SPLIT_IVIM)


# Cues by which a task's skill is chosen, the first that fits decides.
SKILL_CUES = (
    ("research-brief", r"(?i)文献综述|研究综述|研究简报|综述|literature\s+review|research\s+brief"),
    ("compare-papers", r"(?i)比较|对比|异同|区别|compare\s+papers|paper\s+comparison"),
)


def skill_of(task: Column) -> Column:
    """Skill for a task text."""
    out = None
    for name, cue in SKILL_CUES:
        out = F.when(task.rlike(cue), name) if out is None else out.when(task.rlike(cue), name)
    return out.otherwise("paper-qa")


def json_in_one_form(c: Column) -> Column:
    """JSON text of any shape in one form: keys sorted at every depth, no spaces; null for what is no JSON or has a key twice.

    A VARIANT holds its objects' fields in the order of their names, so it is parsed and written once. Numbers lose
    zeros at the end of their fraction (1.50 is 1.5, 1.0 is 1); all else stays as it is.
    """
    return F.to_json(F.try_parse_json(c))
