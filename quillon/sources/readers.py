"""Readers with explicit schemas; every path is opened by Spark's own readers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import arxiv_id, doi, squeeze

AUTHOR = "struct<author:struct<id:string,display_name:string>>"
WORK = (
    "id string, title string, display_name string, doi string, publication_year int, publication_date string, type string, cited_by_count int, "
    f"authorships array<{AUTHOR}>, primary_location struct<source:struct<display_name:string>>, open_access struct<is_oa:boolean,oa_status:string,oa_url:string>, "
    "abstract_inverted_index map<string,array<int>>, referenced_works array<string>"
)
PAGE = f"meta struct<count:long,page:int,per_page:int>, results array<struct<{', '.join(x.replace(' ', ':', 1) for x in WORK.split(', '))}>>, fetched_at string"
ENTRY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("published", T.StringType()),
        T.StructField("updated", T.StringType()),
        T.StructField("author", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
        T.StructField("category", T.ArrayType(T.StructType([T.StructField("_term", T.StringType())]))),
        T.StructField("arxiv:doi", T.StringType()),
        T.StructField("arxiv:journal_ref", T.StringType()),
        T.StructField("arxiv:primary_category", T.StructType([T.StructField("_term", T.StringType())])),
    ]
)
#: Bounds of a feed page and of its fields.
FEED_BYTES, FEED_ENTRIES, FEED_NAMESPACE = 2_000_000, 25, "http://www.w3.org/2005/Atom"
LONGEST = {"title": 2_000, "abstract": 100_000, "doi": 500, "journal_ref": 2_000}
MOST_AUTHORS, MOST_CATEGORIES = 200, 100
FEED = (
    "totalResults long, startIndex long, itemsPerPage long, entry array<struct<id:string,title:string,summary:string,published:string,updated:string,"
    "author:array<struct<name:string>>,category:array<struct<_term:string>>,doi:string,journal_ref:string,primary_category:struct<_term:string>>>, _corrupt string"
)
#: Results of a page, and the last result that paging reaches.
PAGE_RESULTS, LAST_RESULT, WORK_ID = 100, 10_000, r"^https://openalex\.org/W\d+$"
MANIFEST = "source_type string, source_id string, text_source_url string, license_id string, license_url string, license_evidence_url string, reviewer string, attribution string, _corrupt string"
#: Licences that full text may have, with their canonical address.
LICENSES = {"CC0-1.0": "https://creativecommons.org/publicdomain/zero/1.0/", "CC-BY-4.0": "https://creativecommons.org/licenses/by/4.0/"}


def work_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed result pages; unknown fields are dropped, malformed files fail."""
    return spark.read.schema(PAGE).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def works(spark: SparkSession, path: str) -> DataFrame:
    """Records of landed pages with their page's time and their 0-based position."""
    return work_pages(spark, path).select("fetched_at", F.posexplode("results").alias("result_position", "w")).select("fetched_at", "result_position", "w.*")


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """Eleven fields of each Atom entry; white space collapsed, times need a zone."""
    e = spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path)
    zoned = lambda c: F.when(F.col(c).rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), F.to_timestamp(c))
    return e.select(
        arxiv_id(F.col("id")).alias("arxiv_id"),
        squeeze(F.col("title")).alias("title"),
        squeeze(F.col("summary")).alias("abstract"),
        F.transform("author", lambda a: a["name"]).alias("authors"),
        F.transform("category", lambda c: c["_term"]).alias("categories"),
        F.col("`arxiv:primary_category`._term").alias("primary_category"),
        zoned("published").alias("published_at"),
        zoned("updated").alias("updated_at"),
        doi(F.col("`arxiv:doi`")).alias("doi"),
        F.col("`arxiv:journal_ref`").alias("journal_ref"),
        F.col("id").alias("source_url"),
    )


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, length) of whole files, for the page checks below; small files share a task."""
    return spark.read.format("binaryFile").load(path).select("path", "content", "length")


def feed_pages(raw: DataFrame, key: str = "path") -> DataFrame:
    """One row per feed page: its key, the first rule that it breaks as ``problem`` or null, total_results, start,
    items_per_page and works (the eleven fields of each entry); a page with a problem has none of them.

    ``raw``: key and content (bytes). Nothing is parsed of a page that is too long or declares a document type or an
    entity. The page must say how many entries it has, and one bad entry refuses it as a whole.
    """
    text = F.col("content").cast("string")
    feed = F.from_xml("safe", FEED, {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    early = (
        F.when(F.octet_length("content") > FEED_BYTES, "too long")
        .when(~F.is_valid_utf8(text), "not UTF-8")
        .when(F.upper(text).rlike("<!DOCTYPE|<!ENTITY"), "declaration")
        .when(~text.rlike(rf"(?s)^\s*(?:<\?xml[^>]*\?>)?\s*(?:<!--.*?-->\s*)*<(?:\w+:)?feed\b[^>]*{re.escape(FEED_NAMESPACE)}"), "not a feed")
    )
    pages = raw.select(key, early.alias("early"), F.when(early.isNull(), text).alias("safe")).select(key, "early", "safe", feed.alias("f"))
    zoned = lambda c: F.when(c.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(c))
    fields = lambda e: F.struct(
        arxiv_id(e["id"]).alias("arxiv_id"),
        squeeze(F.coalesce(e["title"], F.lit(""))).alias("title"),
        squeeze(F.coalesce(e["summary"], F.lit(""))).alias("abstract"),
        F.filter(F.transform(F.coalesce(e["author"], F.array()), lambda a: a["name"]), lambda n: n != "").alias("authors"),
        F.filter(F.transform(F.coalesce(e["category"], F.array()), lambda c: c["_term"]), lambda t: t.isNotNull()).alias("categories"),
        e["primary_category"]["_term"].alias("primary_category"),
        zoned(e["published"]).alias("published_at"),
        zoned(e["updated"]).alias("updated_at"),
        F.trim(e["doi"]).alias("doi"),
        F.trim(e["journal_ref"]).alias("journal_ref"),
        F.concat(F.lit("https://arxiv.org/abs/"), arxiv_id(e["id"])).alias("source_url"),
    )
    pages = pages.select(key, "early", "f", F.transform(F.coalesce("f.entry", F.array()), fields).alias("works"))
    long = lambda w: reduce(Column.__or__, [F.coalesce(F.char_length(w[c]) > n, F.lit(False)) for c, n in LONGEST.items()], (F.size(w["authors"]) > MOST_AUTHORS) | (F.size(w["categories"]) > MOST_CATEGORIES))
    problem = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(F.col("f").isNull() | F.col("f._corrupt").isNotNull(), "malformed")
        .when((F.coalesce("f.itemsPerPage", F.lit(0)) != F.size("works")) | (F.size("works") > FEED_ENTRIES), "entry count")
        .when(F.exists("works", lambda w: w["arxiv_id"].isNull()), "identifier")
        .when(F.exists("works", lambda w: w["published_at"].isNull() | w["updated_at"].isNull()), "time")
        .when(F.exists("works", long), "field length")
        .when((F.coalesce("f.totalResults", F.lit(0)) < 0) | (F.coalesce("f.startIndex", F.lit(0)) < 0), "paging")
    )
    fine = lambda c: F.when(F.col("problem").isNull(), c)
    pages = pages.withColumn("problem", problem)
    return pages.select(key, "problem", fine(F.coalesce("f.totalResults", F.lit(0))).alias("total_results"), fine(F.coalesce("f.startIndex", F.lit(0))).alias("start"), fine(F.col("f.itemsPerPage")).alias("items_per_page"), fine(F.col("works")).alias("works"))


def result_pages(raw: DataFrame, key: str = "path") -> DataFrame:
    """One row per page of results: its key, ``problem`` or null, count, page, per_page and results.

    A page has 1 to 100 results by its own account, none beyond the last result that paging reaches, and all its ids
    are canonical; a page with a problem gives none of its results.
    """
    schema = PAGE + ", _corrupt string"
    pages = raw.select(key, F.from_json(F.col("content").cast("string"), schema, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("p"))
    meta = lambda c: F.col(f"p.meta.{c}")
    problem = (
        F.when(F.col("p").isNull() | F.col("p._corrupt").isNotNull() | F.col("p.results").isNull(), "malformed")
        .when(F.coalesce(meta("count"), F.lit(-1)) < 0, "count")
        .when(~F.coalesce(meta("per_page").between(1, PAGE_RESULTS), F.lit(False)) | (F.size("p.results") > meta("per_page")), "page size")
        .when((meta("page") < 1) | (meta("page").cast("long") * meta("per_page") > LAST_RESULT), "paging")
        .when(F.exists("p.results", lambda w: ~F.coalesce(w["id"].rlike(WORK_ID), F.lit(False))), "identifier")
    )
    fine = lambda c: F.when(F.col("problem").isNull(), c)
    pages = pages.withColumn("problem", problem)
    return pages.select(key, "problem", *(fine(meta(c)).alias(c) for c in ("count", "page", "per_page")), fine(F.col("p.results")).alias("results"))


def plain_texts(spark: SparkSession, path: str, most_bytes: int = 8_000_000) -> DataFrame:
    """(path, sha256, text, error): whole files; not UTF-8 or too long is an error, not a guess."""
    raw = spark.read.format("binaryFile").load(path)
    fine = F.is_valid_utf8(F.col("content").cast("string"))
    error = F.when(F.col("length") > most_bytes, "too long").when(~fine, "not UTF-8")
    return raw.select("path", F.sha2("content", 256).alias("sha256"), F.when(error.isNull(), F.col("content").cast("string")).alias("text"), error.alias("error"))


def binary_documents(spark: SparkSession, path: str, most_bytes: int = 40_000_000) -> DataFrame:
    """(path, sha256, content, error) of PDF files; the hash is of the same bytes. A file that is too long
    or no PDF is a row with an error and without content."""
    raw = spark.read.format("binaryFile").load(path)
    error = F.when(F.col("length") > most_bytes, "too long").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "not a PDF")
    return raw.select("path", F.sha2("content", 256).alias("sha256"), F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"))


def license_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests with the first rule that they break, or null: the gate before any text is opened."""
    raw = spark.read.format("binaryFile").load(path).select("path", "length", F.col("content").cast("string").alias("body"))
    known = [f.split(" ")[0] for f in MANIFEST.split(", ")][:-1]
    keys = F.json_object_keys("body")
    m = raw.select("*", F.from_json("body", MANIFEST, {"columnNameOfCorruptRecord": "_corrupt"}).alias("m"), keys.alias("keys"))
    https = lambda c: F.col(f"m.{c}").rlike(r"^https://\S{1,2040}$")
    links = F.create_map(*[F.lit(x) for kv in LICENSES.items() for x in kv])
    problem = (
        F.when(F.col("length") > 32_768, "too long")
        .when(F.col("keys").isNull() | F.col("m._corrupt").isNotNull(), "not an object")
        .when(F.size(F.array_except("keys", F.array(*map(F.lit, known)))) > 0, "unknown key")
        .when(F.size(F.array_except(F.array(*map(F.lit, known)), "keys")) > 0, "missing key")
        .when(~F.col("m.source_type").isin("arxiv", "openalex"), "source type")
        .when(~F.col("m.license_id").isin(*LICENSES) | (links[F.col("m.license_id")] != F.col("m.license_url")), "license")
        .when(~(https("text_source_url") & https("license_evidence_url")), "address")
        .when(~F.char_length("m.reviewer").between(1, 128) | ~F.char_length("m.attribution").between(1, 500), "review fields")
    )
    return m.select("path", *[F.col(f"m.{k}").alias(k) for k in known], problem.alias("problem"))


def dataset_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, body) of evaluation datasets; the digest is of the exact bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("content").cast("string").alias("body"))
