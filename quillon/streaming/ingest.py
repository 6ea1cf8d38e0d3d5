"""Structured Streaming ingest: landed pages become versions, each payload once.

``ingest`` appends with each micro-batch the versions that are new (an anti-join with those stored); a
repeated batch writes nothing twice, as its rows carry the batch id and are replaced. ``ingest_with_state``
keeps the digests that a work has had in the state store instead, so a batch costs what it brings and not
what was stored before; the file sink's log makes it exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillon.operators.catalog import append_if_absent
from quillon.sources.readers import PAGE


def record_versions(pages: DataFrame) -> DataFrame:
    """(work_id, payload_sha256, fetched_at, result_position, record) of landed pages."""
    rows = pages.select("fetched_at", F.posexplode("results").alias("result_position", "w"))
    record = F.to_json("w", {"ignoreNullFields": "false"})
    return rows.select(F.substring_index("w.id", "/", -1).alias("work_id"), F.sha2(record, 256).alias("payload_sha256"), "fetched_at", "result_position", record.alias("record"))


def ingest(spark: SparkSession, landing: str, versions: str, checkpoint: str) -> StreamingQuery:
    """Process all pages that have landed since the last run, then stop."""
    pages = spark.readStream.schema(PAGE).option("multiLine", "true").json(landing)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = record_versions(batch).withColumn("batch_id", F.lit(batch_id))
        path = spark._jvm.org.apache.hadoop.fs.Path(versions)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            stored = spark.read.parquet(versions).filter(F.col("batch_id") < batch_id)
            rows = append_if_absent(stored, rows, ["work_id", "payload_sha256"])
        else:
            rows = rows.dropDuplicates(["work_id", "payload_sha256"])
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(versions)

    return record_versions_trigger(pages, write, checkpoint)


def record_versions_trigger(pages: DataFrame, write, checkpoint: str) -> StreamingQuery:
    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per type and window of event time, with a watermark; works on batches and streams."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")


VERSION = "work_id string, payload_sha256 string, first_seen string, version int, record string"
#: The state store that keeps maps per key.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Versions(StatefulProcessor):
    """Per work the digests that were seen, with when; a row for each new one, numbered from 1.

    A work that comes back to an earlier payload gives no row: that version is there. The state of a work grows with
    its versions, not with how often it is fetched.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "payload_sha256 string", "first_seen string")
        self.count = handle.getValueState("count", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows).sort_values(["fetched_at", "result_position"], kind="stable").drop_duplicates("payload_sha256")
        n = self.count.get()[0] if self.count.exists() else 0
        new = []
        for sha, at, record in zip(frame["payload_sha256"], frame["fetched_at"], frame["record"]):
            if not self.seen.containsKey((sha,)):
                n += 1
                self.seen.updateValue((sha,), (at,))
                new.append((key[0], sha, at, n, record))
        if new:
            self.count.update((n,))
        yield pd.DataFrame(new, columns=[c.split(" ")[0] for c in VERSION.split(", ")]).astype({"version": "int32"})

    def close(self) -> None:
        pass


def new_versions(pages: DataFrame) -> DataFrame:
    """Rows of ``VERSION`` for what a stream of landed pages brings that its work has not had before."""
    rows = record_versions(pages).where("work_id IS NOT NULL")
    return rows.groupBy("work_id").transformWithStateInPandas(statefulProcessor=Versions(), outputStructType=VERSION, outputMode="Append", timeMode="None")


def ingest_with_state(spark: SparkSession, landing: str, versions: str, checkpoint: str) -> StreamingQuery:
    """Process all pages that have landed since the last run, then stop; what was stored is not read again."""
    pages = spark.readStream.schema(PAGE).option("multiLine", "true").json(landing)
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        # the query takes the session's settings when it starts
        return new_versions(pages).writeStream.format("parquet").outputMode("append").option("path", versions).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
