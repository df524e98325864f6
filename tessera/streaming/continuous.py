"""Continuous variants of the stream queries with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators import kv, oplog
from tessera.operators.stream import AGGREGATES
from tessera.sources import snapshots


def source(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet files ``name`` in a folder, old and new ones, as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(folder)


def tumbling(events: DataFrame, width: str, agg: str, late: str | None = None, ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """One aggregate of each key and window. With ``late`` given, windows close that long after the newest event, and the
    query may append; without, it has to be complete."""
    e = events.withColumn("__at", F.col(ts).cast("timestamp"))
    e = e if late is None else e.withWatermark("__at", late)
    out = e.groupBy(F.col(key).alias("stream"), F.window("__at", width).alias("w")).agg(AGGREGATES[agg](value).cast("double").alias("agg_value"))
    return out.select("stream", F.unix_micros("w.start").alias("bucket_us"), "agg_value")


def changes(log: DataFrame) -> DataFrame:
    """Change records of an op-log as they come."""
    return oplog.changes(log)


def running_anomalies(events: DataFrame, threshold: float = 2.5, least: int = 10, key: str = "event_type", value: str = "value", order: str = "event_id") -> DataFrame:
    """Events whose distance from the running mean of their stream, the event included, exceeds ``threshold`` population
    standard deviations, once there were ``least`` events. The state of a stream is three numbers: count, mean and the sum of
    squared distances."""

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, squares = state.get if state.exists else (0, 0.0, 0.0)
        out = []
        rows = pd.concat(list(parts)).sort_values(order)
        for i, x in zip(rows[order].tolist(), rows[value].tolist(), strict=True):
            n += 1
            delta = x - mean
            mean += delta / n
            squares += delta * (x - mean)
            dev = (squares / n) ** 0.5 or 1e-9
            z = (x - mean) / dev
            if n >= least and abs(z) > threshold:
                out.append((group[0], int(i), float(z)))
        state.update((n, mean, squares))
        yield pd.DataFrame(out, columns=["stream", "seq", "z"])

    slim = events.select(key, order, value)
    return slim.groupBy(key).applyInPandasWithState(step, "stream string, seq long, z double", "n long, mean double, squares double", "append", GroupStateTimeout.NoTimeout)


def write_behind(log: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends operations to a Parquet op-log in micro-batches; the checkpoint makes each batch count once."""
    writer = log.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def snapshot_as_it_grows(log: DataFrame, whole_log, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """A snapshot after each micro-batch of an op-log stream, at intervals of ``every``: the live entries of ``whole_log()``,
    the op-log so far as a table, as of the batch's newest operation."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.agg(F.max("ts_us")).first()[0]
        if newest is not None:
            snapshots.snapshot(kv.fold(whole_log()), folder, newest)

    return consume(log, checkpoint, write, every)


def consume(stream: DataFrame, checkpoint: str, handle, every: str | None = None) -> StreamingQuery:
    """A consumer group: ``handle(batch, number)`` gets each micro-batch once it is read; the group's place is its checkpoint."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
