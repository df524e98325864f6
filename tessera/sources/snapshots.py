"""Snapshots and the op-log on disk, as Parquet partitioned by tenant."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import kv


def append_log(log: DataFrame, folder: str) -> None:
    """Appends operations; a key must not be empty."""
    checked = log.withColumn("key", F.when(F.length("key") > 0, F.col("key")).otherwise(F.raise_error("empty key").cast("string")))
    checked.write.mode("append").partitionBy("tenant").parquet(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def replace(df: DataFrame, folder: str, *by: str) -> None:
    """Writes ``df`` beside ``folder`` and puts it there by renaming, so that a failed write leaves what was there, and a plan
    that reads the folder may be written to it. Between the two renames a reader finds the old data under ``<folder>.old``."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old, at = (jvm.org.apache.hadoop.fs.Path(x) for x in (f"{folder.rstrip('/')}.new-{uuid.uuid4().hex}", f"{folder.rstrip('/')}.old", folder))
    fs = at.getFileSystem(conf)
    df.write.partitionBy(*by).parquet(new.toString())
    if fs.exists(at):
        fs.delete(old, True)
        fs.rename(at, old)
    if not fs.rename(new, at):
        raise OSError(f"could not rename to {folder}")
    fs.delete(old, True)


def snapshot(state: DataFrame, folder: str, as_of_us: int, drop_ttl: bool = False) -> None:
    """Puts the live entries in the place of what the folder holds."""
    live = state.where(kv.is_live(as_of_us))
    live = live.withColumn("expire_us", F.lit(None).cast("bigint")) if drop_ttl else live
    replace(live, folder, "tenant")


def restore(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot as SET operations at the entries' own sequence numbers, to be followed by a log."""
    s = spark.read.parquet(folder)
    return s.select(F.col("tenant").cast("string").alias("tenant"), F.col("write_seq").alias("seq"), F.col("created_us").alias("ts_us"), F.lit("SET").alias("op"), "key", "value", F.lit(None).cast("bigint").alias("delta"), (F.col("expire_us") - F.col("created_us")).alias("ttl_us"))


def compact(spark: SparkSession, log: DataFrame, folder: str, as_of_us: int) -> DataFrame:
    """Folds a log into a snapshot and returns the log that takes its place."""
    snapshot(kv.fold(log), folder, as_of_us)
    return restore(spark, folder)


def snapshot_sets(zsets: DataFrame, folder: str) -> None:
    """Puts sorted sets ``(zkey, member, score)`` in the place of what the folder holds."""
    replace(zsets.select("zkey", "member", "score"), folder)


def restore_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted sets from their snapshot."""
    return spark.read.parquet(folder).select("zkey", "member", "score")
