"""Bitmaps as rows ``(bkey, offset)`` of set bits, from a log ``(bkey, seq, offset, bit)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(log: DataFrame) -> DataFrame:
    """The set bits after the whole log. A bit that is neither 0 nor 1 raises."""
    checked = log.withColumn("bit", F.when(F.col("bit").isin(0, 1), F.col("bit")).otherwise(F.raise_error("bit must be 0 or 1").cast("int")))
    return checked.groupBy("bkey", "offset").agg(F.max_by("bit", "seq").alias("bit")).where("bit = 1").drop("bit")


def previous(log: DataFrame) -> DataFrame:
    """Every write with the bit that it replaced."""
    own = Window.partitionBy("bkey", "offset").orderBy("seq")
    return log.withColumn("previous", F.lag("bit", 1, 0).over(own))


def get(bits: DataFrame, asked: DataFrame) -> DataFrame:
    """The bits of ``asked(bkey, offset)``; 0 where nothing is set."""
    return asked.join(bits.withColumn("bit", F.lit(1)), ["bkey", "offset"], "left").select("bkey", "offset", F.coalesce("bit", F.lit(0)).alias("bit"))


def count(bits: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Set bits of every bitmap, in a range of offsets if one is given, both ends included."""
    if first is not None:
        bits = bits.where(F.col("offset") >= first)
    if last is not None:
        bits = bits.where(F.col("offset") <= last)
    return bits.groupBy("bkey").agg(F.count("*").alias("n"))


def drop(bits: DataFrame, keys: DataFrame) -> DataFrame:
    """The bitmaps but those of ``keys(bkey)``."""
    return bits.join(keys, "bkey", "left_anti")


def packed(bits: DataFrame) -> DataFrame:
    """The bitmap of each 32,768-bit bucket as binary, and how many bits it has."""
    bucket = F.bitmap_bucket_number(F.col("offset") + 1)
    found = bits.groupBy("bkey", bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("offset") + 1)).alias("bitmap"))
    return found.withColumn("n", F.bitmap_count("bitmap"))
