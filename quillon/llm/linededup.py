"""Line dedup by a log-template tree of fixed depth, in DataFrame operations only.

A line's signature is its words joined by a space, with words that hold a digit as ``<*>``. The tree
has a level for the number of words and one for each of the first ``DEPTH`` words of the signature;
a leaf's template takes at each further place the word that most of its documents have. A signature
that agrees with its leaf's template in at least ``SIMILARITY`` of these places belongs to the
template (the other places are variable fields). What does not fit is looked at again: a pattern is a
signature's words that ``MIN_DOCS`` documents have at their places, if these are enough places, and
each pattern of ``MIN_DOCS`` documents or more is a further template of the leaf; all of a leaf are found
at once, and what then is left is looked at again, until no pattern recurs. What fits no template is a
template of its own.
A template that recurs in ``MIN_DOCS`` documents or more is boilerplate, and all its lines are
dropped. Documents are counted as different texts: exact copies count once. Texts that share their
longest signature count once too if their other lines are near copies, and each counts if these
differ: of every text's other lines, ``SKETCH`` least digests of 3-word windows are compared, and the
texts differ if the mean number of distinct digests is ``MIN_DOCS`` at least and over a third of the texts
(of near copies of similarity 0.8 about a ninth have a digest of their own). Then texts are told apart by
their first digest.

Lines are what \\n splits; lines without a word are kept and count in no template. Null text: stays
null, no lines. Null ids, repeated rows and ids: each row gets its own result. Ties between words of
a leaf: the greater in byte order. Very long texts are one row with an array of lines until
these are rows of their own. An empty table gives no rows. Extra columns are carried along, whatever
their names. Signatures are aggregated before they are grouped, so a line that a third of all rows
share is one row per task. Only leaves with several signatures and at least ``MIN_DOCS`` documents are
taken apart by place. Texts and signatures are keyed by 128 bits of hash; leaves, and documents where
they are counted, by 64.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Scratch

DEPTH, SIMILARITY, MIN_DOCS = 3, 0.7, 5
#: Digests by which the other lines of texts with one longest signature are compared, and the words of a window.
SKETCH, WINDOW = 4, 3
#: Texts whose keys are broadcast at most; beyond, all texts are gone through by their longest signature.
FEW = 200_000
SPACE = r"\x20\x09-\x0D"


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit(17), text)]


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [k.alias(name) for k, name in zip(_keys(text), ("k1", "k2"))]


def key128(*cols) -> Column:
    """128 bits that stand for some values."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(17), *cols).alias("b"))


def signatures(text: Column) -> Column:
    """Array of the signatures of a text's lines; "" for a line without a word.

    Patterns run only where they are needed: most texts have single spaces, most lines no digit.
    """
    variable = rf"(?<![^{SPACE}])[^{SPACE}0-9]*+[0-9][^{SPACE}]*+"
    masked = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, variable, "<*>")).otherwise(x))
    odd = [F.contains(text, F.lit(c)) for c in ("  ", " \n", "\n ", "\t", "\x0b", "\x0c", "\r")]
    odd = reduce(Column.__or__, odd, F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" ")))
    return F.when(odd, F.transform(masked, lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09\x0B-\x0D]+", " ")))).otherwise(masked)


def _documents(df: DataFrame) -> DataFrame:
    """k1, k2, raw lines, their signatures, and the longest signature as ``top``, of every text that is not null."""
    text = df["text"].cast("string")
    docs = df.filter(text.isNotNull()).select(*text_keys(text), text.alias("text"))
    docs = docs.select("k1", "k2", F.split("text", "\n", -1).alias("raw"), signatures(F.col("text")).alias("sigs"))
    top = F.array_max(F.transform("sigs", lambda x: F.struct(F.char_length(x).alias("n"), x.alias("s"))))["s"]
    return docs.select("k1", "k2", "raw", "sigs", top.alias("top"))


def _lines(df: DataFrame) -> DataFrame:
    """A row per line with a word: text key, place, signature, and the document as ``doc`` (its longest signature)."""
    return _exploded(_documents(df).select("k1", "k2", "sigs", F.xxhash64("top").alias("doc")), "k1", "k2", "doc")


def digest_with(salt: str):
    """A function of one argument: those of more are called with places by ``transform``."""
    return lambda window: F.md5(F.concat(F.lit(salt), window))


def _sketches(df: DataFrame, hot: DataFrame) -> DataFrame:
    """doc, k1, k2 and the digests m0, m1, ... of the texts whose ``doc`` is in ``hot``, each text once."""
    docs = _documents(df).withColumn("doc", F.xxhash64("top")).join(hot, "doc", "left_semi")
    others = F.filter(F.zip_with("raw", "sigs", lambda x, s: F.when((s != "") & (s != F.col("top")), x)), lambda x: x.isNotNull())
    docs = docs.select("doc", "k1", "k2", F.when(F.size(others) > 0, others).otherwise(F.col("raw")).alias("lines"))
    words = F.filter(F.split(F.array_join("lines", "\n"), rf"[{SPACE}]+"), lambda w: w != "")
    docs = docs.select("doc", "k1", "k2", words.alias("words"))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (WINDOW - 1)))
    docs = docs.select("doc", "k1", "k2", F.transform(places, lambda i: F.array_join(F.slice("words", i, WINDOW), " ")).alias("windows"))
    digests = [F.transform("windows", digest_with(str(k))) for k in range(SKETCH)]
    least = [F.array_min(d).alias(f"m{k}") for k, d in enumerate(digests)]
    return docs.select("doc", "k1", "k2", *least).distinct()


def _exploded(docs: DataFrame, *keep: str) -> DataFrame:
    """The lines with a word of an array ``sigs``, as place and text."""
    # outer: the plain form makes Spark filter on the array's size, for which it computes the array twice
    return docs.select(*keep, F.posexplode_outer("sigs").alias("place", "text")).filter("text <> ''")


def _leaf(sig: Column) -> Column:
    words = F.length(sig) - F.length(F.replace(sig, F.lit(" "), F.lit("")))
    return F.xxhash64(words, F.substring_index(sig, " ", DEPTH))


def boilerplate(df: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(lines, gone): all lines (k1, k2, place, sig as its key), written once; and the keys of the
    signatures whose template recurs in MIN_DOCS documents.

    Texts of signatures are not written: few leaves are wide, and for these they are computed again.
    """
    lines = scratch.table(_lines(df).select("k1", "k2", "place", "doc", _leaf(F.col("text")).alias("leaf"), key128("text").alias("sig")))
    hot = scratch.table(lines.groupBy("doc").agg(F.count_distinct("k1", "k2").alias("n")).filter(F.col("n") >= MIN_DOCS).select("doc"))
    seen = lines.select("leaf", "sig", "doc")
    if not hot.isEmpty():
        # few such texts are picked by their keys, before anything else is computed of a text
        texts = scratch.table(lines.join(hot, "doc", "left_semi").select("k1", "k2").distinct())
        picked = df.join(F.broadcast(texts), [a == b for a, b in zip(_keys(df["text"].cast("string")), (texts["k1"], texts["k2"]))], "left_semi") if texts.count() <= FEW else df
        sketches = scratch.table(_sketches(picked, hot))
        kinds = sum((F.count_distinct(f"m{k}") for k in range(1, SKETCH)), F.count_distinct("m0"))
        mixed = sketches.groupBy("doc").agg(kinds.alias("kinds"), F.count("*").alias("n"))
        mixed = scratch.table(mixed.filter((F.col("kinds") >= SKETCH * MIN_DOCS) & (3 * F.col("kinds") > SKETCH * F.col("n"))).select("doc"))
        apart = sketches.join(mixed, "doc", "left_semi").select("k1", "k2", "m0")
        apart = lines.join(mixed, "doc", "left_semi").join(apart, ["k1", "k2"]).select("leaf", "sig", F.xxhash64("doc", "m0").alias("doc"))
        seen = lines.join(mixed, "doc", "left_anti").select("leaf", "sig", "doc").unionByName(apart)
    seen = scratch.table(seen.distinct())
    per_sig = scratch.table(seen.groupBy("leaf", "sig").agg(F.count("*").alias("docs")))
    wide = per_sig.groupBy("leaf").agg(F.sum("docs").alias("docs"), F.count("*").alias("sigs")).filter((F.col("docs") >= MIN_DOCS) & (F.col("sigs") > 1)).select("leaf")
    wide = scratch.table(wide)
    # from here on only wide leaves matter
    open_seen = scratch.table(seen.join(wide, "leaf", "left_semi"))
    wide_sigs = scratch.table(per_sig.join(wide, "leaf", "left_semi"))
    text = df["text"].cast("string")
    again = _exploded(df.filter(text.isNotNull()).select(signatures(text).alias("sigs")))
    texts = again.select(_leaf(F.col("text")).alias("leaf"), "text").join(wide, "leaf", "left_semi").distinct().select("leaf", key128("text").alias("sig"), "text")
    words = texts.select("leaf", "sig", F.posexplode(F.split("text", " ")).alias("at", "word")).filter(F.col("at") >= DEPTH)
    words = scratch.table(words.join(wide_sigs, ["leaf", "sig"]).select("leaf", "sig", "at", "word", "docs"))
    votes = words.groupBy("leaf", "at", "word").agg(F.sum("docs").alias("docs"))
    template = votes.groupBy("leaf", "at").agg(F.max_by("word", F.struct("docs", "word")).alias("constant"))
    member = _fitting(scratch, words, template)
    gone = per_sig.filter(F.col("docs") >= MIN_DOCS).select("sig")
    found = _recurring(scratch, open_seen, member)
    gone = gone.unionByName(found.select("sig"))
    # further templates: the patterns of what did not fit
    active = wide
    while True:
        # a leaf in which no pattern recurred is done
        rest = scratch.table(words.join(active, "leaf", "left_semi").join(found, ["leaf", "sig"], "left_anti"))
        scratch.drop(words)
        words = rest
        often = words.groupBy("leaf", "at", "word").agg(F.sum("docs").alias("votes")).filter(F.col("votes") >= MIN_DOCS)
        fixed = words.join(often, ["leaf", "at", "word"], "left").select("leaf", "sig", F.struct("at", F.when(F.col("votes").isNotNull(), F.col("word")).alias("word")).alias("x"))
        patterns = fixed.groupBy("leaf", "sig").agg(F.array_sort(F.collect_list("x")).alias("parts"), F.count("*").alias("n"), F.count("x.word").alias("kept"))
        pattern = F.array_join("parts.word", " ", "")
        patterns = scratch.table(patterns.filter(F.col("kept") >= SIMILARITY * F.col("n") - 1e-9).select("leaf", "sig", F.xxhash64(pattern).alias("pattern")))
        recurring = open_seen.join(patterns, ["leaf", "sig"]).groupBy("leaf", "pattern").agg(F.count_distinct("doc").alias("docs")).filter(F.col("docs") >= MIN_DOCS)
        found = scratch.table(patterns.join(recurring, ["leaf", "pattern"], "left_semi").select("leaf", "sig"))
        if found.isEmpty():
            return lines, scratch.table(gone.distinct())
        gone = gone.unionByName(found.select("sig"))
        active = found.select("leaf").distinct()


def _fitting(scratch: Scratch, words: DataFrame, template: DataFrame) -> DataFrame:
    """(leaf, sig) of the signatures that agree with their leaf's template (leaf, at, constant)."""
    agree = words.join(template, ["leaf", "at"]).groupBy("leaf", "sig").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("word") == F.col("constant"), F.lit(False)).cast("int")).alias("same"))
    return scratch.table(agree.filter(F.col("same") >= SIMILARITY * F.col("n") - 1e-9).select("leaf", "sig"))


def _recurring(scratch: Scratch, seen: DataFrame, member: DataFrame) -> DataFrame:
    """The rows of ``member`` whose leaf they put into MIN_DOCS documents."""
    spread = seen.join(member, ["leaf", "sig"]).select("leaf", "doc").distinct().groupBy("leaf").agg(F.count("*").alias("docs")).filter(F.col("docs") >= MIN_DOCS)
    return scratch.table(member.join(spread, "leaf").select("leaf", "sig"))


def line_dedup(df: DataFrame, recount: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """The input's rows and columns with ``text`` cut, plus n_lines and n_dropped (long).

    With ``recount`` just the input's columns, where n_chars, if there, is that of the cut text.
    """
    scratch = scratch or Scratch(df.sparkSession)
    lines, gone = boilerplate(df, scratch)
    hits = lines.select("k1", "k2", "place", "sig").join(gone, "sig", "left_semi")
    hits = scratch.table(hits.groupBy("k1", "k2").agg(F.collect_set("place").alias("gone")))
    text = df["text"].cast("string")
    # the text travels once, inside its row
    joined = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), *text_keys(text)).join(hits, ["k1", "k2"], "left")
    whole = F.col("row.text").cast("string")
    parts = F.split(whole, "\n", -1)
    kept = F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    columns = [kept.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in df.columns]
    if recount:
        if "n_chars" in df.columns:
            size = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.char_length(kept))
            columns[df.columns.index("n_chars")] = size.cast(df.schema["n_chars"].dataType).alias("n_chars")
        return joined.select(*columns)
    return joined.select(*columns, F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _oracle(rounds: int = 4) -> str:
    """The rule in SQL, on the texts themselves; what is left of a leaf is looked at ``rounds`` times."""
    steps, gone = "", "SELECT sig FROM per_sig WHERE docs >= 5 UNION SELECT sig FROM found0"
    for r in range(1, rounds + 1):
        steps += f"""
words{r} AS (SELECT w.* FROM words{r - 1} w ANTI JOIN found{r - 1} USING (n, head, sig)),
often{r} AS (SELECT n, head, place, word FROM words{r} GROUP BY ALL HAVING sum(docs) >= 5),
pattern{r} AS (SELECT n, head, sig, string_agg(coalesce(o.word, ''), ' ' ORDER BY w.place) AS pattern FROM words{r} w LEFT JOIN often{r} o USING (n, head, place, word) GROUP BY ALL HAVING count(o.word) >= 0.7 * count(*)),
found{r} AS (SELECT n, head, sig FROM pattern{r} JOIN (SELECT n, head, pattern FROM seen JOIN pattern{r} USING (n, head, sig) GROUP BY ALL HAVING count(DISTINCT doc) >= 5) USING (n, head, pattern)),"""
        gone += f" UNION SELECT sig FROM found{r}"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
raw AS (SELECT r, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM docs),
lines AS (SELECT r, text, place, line, array_to_string(list_transform(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> ''),
  lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END), ' ') AS sig FROM raw),
longest AS (SELECT r, sig AS top FROM (SELECT r, sig, row_number() OVER (PARTITION BY r ORDER BY length(sig) DESC, sig DESC) AS k FROM lines) WHERE k = 1),
hot AS (SELECT top FROM longest JOIN docs USING (r) WHERE top <> '' GROUP BY top HAVING count(DISTINCT text) >= 5),
others AS (SELECT r, top, text, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE sig <> '' AND sig <> top), any_value(text)) AS body FROM lines JOIN longest USING (r) SEMI JOIN hot USING (top) GROUP BY r, top, text),
tokens AS (SELECT r, top, text, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM others),
windows AS (SELECT r, top, text, list_transform(generate_series(1, greatest(1, len(w) - 2)), lambda i: array_to_string(w[i:i + 2], ' ')) AS v FROM tokens),
sketch AS (SELECT r, top, text, list_min(list_transform(v, lambda x: md5('0' || x))) AS m0, list_min(list_transform(v, lambda x: md5('1' || x))) AS m1,
  list_min(list_transform(v, lambda x: md5('2' || x))) AS m2, list_min(list_transform(v, lambda x: md5('3' || x))) AS m3 FROM windows),
mixed AS (SELECT top FROM sketch GROUP BY top HAVING count(DISTINCT m0) + count(DISTINCT m1) + count(DISTINCT m2) + count(DISTINCT m3) >= 20
  AND 3 * (count(DISTINCT m0) + count(DISTINCT m1) + count(DISTINCT m2) + count(DISTINCT m3)) > 4 * count(DISTINCT text)),
named AS (SELECT r, CASE WHEN mixed.top IS NULL THEN longest.top ELSE longest.top || chr(10) || m0 END AS doc FROM longest LEFT JOIN mixed USING (top) LEFT JOIN sketch USING (r)),
worded AS (SELECT lines.*, doc, len(string_split(sig, ' ')) AS n, array_to_string(string_split(sig, ' ')[1:3], ' ') AS head FROM lines JOIN named USING (r) WHERE sig <> ''),
seen AS (SELECT DISTINCT n, head, sig, doc FROM worded),
per_sig AS (SELECT n, head, sig, count(*) AS docs FROM seen GROUP BY ALL),
wide AS (SELECT n, head FROM per_sig GROUP BY ALL HAVING sum(docs) >= 5 AND count(*) > 1),
words0 AS (SELECT n, head, sig, docs, unnest(string_split(sig, ' ')[4:]) AS word, generate_subscripts(string_split(sig, ' ')[4:], 1) AS place FROM per_sig JOIN wide USING (n, head)),
votes AS (SELECT n, head, place, word, sum(docs) AS docs FROM words0 GROUP BY ALL),
template AS (SELECT n, head, place, word AS constant FROM (SELECT *, row_number() OVER (PARTITION BY n, head, place ORDER BY docs DESC, word DESC) AS k FROM votes) WHERE k = 1),
member AS (SELECT n, head, sig FROM words0 JOIN template USING (n, head, place) GROUP BY ALL HAVING sum(CASE WHEN word = constant THEN 1 ELSE 0 END) >= 0.7 * count(*)),
spread AS (SELECT n, head FROM (SELECT DISTINCT n, head, doc FROM seen JOIN member USING (n, head, sig)) GROUP BY ALL HAVING count(*) >= 5),
found0 AS (SELECT n, head, sig FROM member JOIN spread USING (n, head)),{steps}
gone AS ({gone})
SELECT doc_id, CASE WHEN count(line) > 0 THEN coalesce(array_to_string(list(line ORDER BY place) FILTER (WHERE NOT cut), chr(10)), '') END AS text, count(line) AS n_lines, count(*) FILTER (WHERE cut) AS n_dropped
FROM (SELECT docs.r, doc_id, place, line, coalesce(sig IN (SELECT sig FROM gone), false) AS cut FROM docs LEFT JOIN lines USING (r)) GROUP BY r, doc_id
"""


ORACLE = _oracle()
