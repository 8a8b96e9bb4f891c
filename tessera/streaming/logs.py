"""Streams of acquisition events: windows, sessions and summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.checkpoints import shared_folder


def events(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The events of a folder's Parquet file as a stream, times as timestamps of the session's zone."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(rows: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) for each tumbling window; later events than `late` are dropped."""
    grouped = rows.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of runs of events without a pause of `gap`."""
    grouped = rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


#: State beyond an executor's memory is kept in files.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def completed(stream: DataFrame) -> DataFrame:
    """The result of a stream over all that is there now, as a table (complete mode, one run). Tasks write it to the shared
    folder; nothing of it passes through the driver, and what the stream remembers is in files, too."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    done: list[str] = []

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/{batch}")
        done.append(f"{folder}/{batch}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        query = stream.writeStream.foreachBatch(store).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(done[-1]) if done else spark.createDataFrame([], stream.schema)
