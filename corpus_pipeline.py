"""The corpus pipeline: quality, line dedup, near-dedup, decontamination and packing, in this order.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; between
stages the rows are written as Parquet and read again. All but the last return the columns of
``documents``; the last returns one row per piece of a document in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import Scratch
from quillon.llm.decontam import clean_documents
from quillon.llm.linededup import line_dedup
from quillon.llm.neardedup import near_deduplicated
from quillon.llm.packing import packed
from quillon.llm.quality import quality_verdicts


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and stay near their language's distributions, unchanged."""
    return quality_verdicts(docs, carry=True)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates; n_chars is counted again."""
    return line_dedup(docs, recount=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8): the one with the smallest id."""
    return near_deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks, unchanged."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", pack),
]

#: Fingerprints, tiling, BPE and the packing search are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
