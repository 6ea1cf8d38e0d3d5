"""Writers: data sets are written first, the small pointer table last, which is the commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_new(df: DataFrame, path: str) -> None:
    """JSON that refuses to replace what is there."""
    df.write.mode("errorifexists").json(path)


def append(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Immutable rows at the end of a table."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def commit_pointer(df: DataFrame, base: str, generation: int) -> str:
    """A new generation of a pointer table beside the old ones; readers take the latest complete one."""
    path = f"{base}/generation={generation}"
    df.write.mode("errorifexists").parquet(path)
    return path


def publish(tables: dict[str, DataFrame], base: str, generation: int) -> str:
    """A new generation of several tables, and then the pointer to it: readers see all of it or the one before."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{base}/{name}/generation={generation}")
    rows = [(name, f"{base}/{name}/generation={generation}") for name in tables]
    return commit_pointer(spark.createDataFrame(rows, "name string, path string"), f"{base}/_pointer", generation)


def published(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The tables of the latest complete generation."""
    pointer = latest_pointer(spark, f"{base}/_pointer")
    return {r["name"]: spark.read.parquet(r["path"]) for r in pointer.collect()} if pointer is not None else {}


def latest_pointer(spark: SparkSession, base: str) -> DataFrame | None:
    """The rows of the latest generation that was written to its end, or None."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = [(int(s.getPath().getName().split("=")[1]), s.getPath().toString()) for s in fs.listStatus(root) if "=" in s.getPath().getName() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(max(found)[1]) if found else None
