"""Shared pieces of the corpus operators.

Rules that hold for all of them: a null text is an empty text (unless an operator says otherwise),
a null id stays null in the result, repeated rows each get their own result row, extra input columns
are ignored or, in pipeline stages, carried along untouched.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that a Python operator holds as objects at a time; it bounds memory, not what is processed.
SLICE_ROWS = 256

#: While a table is written: its shuffle files go when it is done, and Arrow batches stay small, as
#: rows may be packed chunks or long texts and batches lie outside the heap.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        folder = current or tempfile.mkdtemp(prefix="quillon-shared-")
        if not spark.sparkContext.master.startswith("local") and not current:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


_lock, _writers, _before = threading.Lock(), Counter(), {}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """``WRITING`` holds in a session while any of its tables is written, by whichever thread; then it is as it was before."""
    key, conf = id(spark), spark.conf
    with _lock:
        if not _writers[key]:
            _before[key] = {k: conf.get(k) for k in WRITING}
            for k, v in WRITING.items():
                conf.set(k, v)
        _writers[key] += 1
    try:
        yield
    finally:
        with _lock:
            _writers[key] -= 1
            if not _writers[key]:
                for k, v in _before.pop(key).items():
                    conf.set(k, v)


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive lost executors.

    The folder goes when the driver's JVM ends; ``drop`` removes a table before that.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.names = 0

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and read it back under its own schema."""
        self.names += 1
        name = f"{self.base}/{self.names}"
        with writing(self.spark):
            df.write.parquet(name)
        if self.names == 1:
            path, files = self._path(self.base)
            files.deleteOnExit(path)
        out = self.spark.read.schema(df.schema).parquet(name)
        out._scratch_path = name
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this scratch that no later plan reads."""
        path, files = self._path(df._scratch_path)
        files.delete(path, True)


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Views of a batch of at most ``rows`` rows."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def mapped(df: DataFrame, rows_of, schema: str, arrow: pa.Schema) -> DataFrame:
    """mapInArrow over bounded slices: ``rows_of(slice)`` gives a dict of columns."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict(rows_of(part), schema=arrow)

    return df.mapInArrow(run, schema)
