import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("RAG检索系统", ["rag", "检索", "索系", "系统"]),
        ("字", ["字"]),
        ("analyses cookies ties studies boxes classes news bus", ["analysis", "cookie", "tie", "study", "box", "class", "news", "bus"]),
        ("Straße e-mails don't", ["strasse", "e-mail", "don't"]),
        ("café", ["caf"]),
        ("", []),
        ("𠀀𠀁", ["𠀀𠀁"]),
    ],
)
def test_tokens(spark, text, expected):
    assert one(spark, text, T.tokens) == expected


def test_tokens_of_null(spark):
    assert one(spark, None, T.tokens) is None


@pytest.mark.parametrize(
    "raw, expected",
    [(" https://doi.org/10.1000/AbC ", "10.1000/abc"), ("doi:10.12345/x", "10.12345/x"), ("10.12/x", None), ("10.1000/a b", None), ("x" * 501, None), (None, None)],
)
def test_doi(spark, raw, expected):
    assert one(spark, raw, T.doi) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [("https://arxiv.org/abs/2401.12345v3", "2401.12345"), ("http://arxiv.org/pdf/2401.1234.pdf", "2401.1234"), ("Hep-TH/9901001v2", "hep-th/9901001"), ("math.GT/0309136", "math.gt/0309136"), ("https://example.com/abs/2401.12345", None)],
)
def test_arxiv_id(spark, raw, expected):
    assert one(spark, raw, T.arxiv_id) == expected


def test_ids_and_ranges(spark):
    assert one(spark, "https://openalex.org/W12", T.work_id) == "W12"
    assert one(spark, "https://openalex.org/A12", T.work_id) is None
    assert one(spark, "A7", T.author_id) == "A7"
    assert one(spark, 'a\\b"c', T.arxiv_query) == "a b c"
    got = spark.range(1).select(T.row_ranges(F.array(*map(F.lit, [1, 2, 3, 5, 7, 8])))).first()[0]
    assert got == "1-3,5,7-8"


def test_facts_headings_skills(spark):
    row = spark.createDataFrame([("The  ﬁnal\nSTRASSE", "final strasse")], "t string, f string")
    assert row.select(T.contains_fact(F.col("t"), F.col("f"))).first()[0]
    kinds = {"1.2 Methods used": "heading", "Results": "heading", "Fig. 3: x": "figure_caption", "Table IV. y": "table_caption", "plain text.": "paragraph"}
    for line, kind in kinds.items():
        assert one(spark, line, T.line_kind) == kind
    assert one(spark, "please write a literature  review and compare papers", T.skill_of) == "research-brief"
    assert one(spark, "compare papers", T.skill_of) == "compare-papers"
    assert one(spark, "what is x", T.skill_of) == "paper-qa"


def test_canonical_json_keeps_nulls_and_sorts(spark):
    row = spark.createDataFrame([("é", None)], "b string, a string")
    assert row.select(T.canonical_json({"b": F.col("b"), "a": F.col("a")})).first()[0] == '{"a":null,"b":"é"}'
