"""Loads of the kinds the engine serves, made where they are used: rows from a range and hashes of their number and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unit(seed: int, *columns: str | Column) -> Column:
    """A number in [0, 1) from the columns and a seed."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 53)) / F.lit(float(1 << 53))


def key_values(spark: SparkSession, n: int, keys: int = 10_000, size: int = 128, seed: int = 42) -> DataFrame:
    """An op-log of ``n`` writes of ``size`` bytes to ``keys`` keys."""
    key = F.concat(F.lit("key:"), F.floor(unit(seed, "id") * keys).cast("string"))
    return spark.range(n).select(F.lit("default").alias("tenant"), F.col("id").alias("seq"), F.col("id").alias("ts_us"), F.lit("SET").alias("op"), key.alias("key"), F.rpad(F.hex(F.xxhash64(F.lit(seed + 1), "id")), size, "x").alias("value"), F.lit(None).cast("bigint").alias("delta"), F.lit(None).cast("bigint").alias("ttl_us"))


def sorted_sets(spark: SparkSession, sets: int = 1000, members: int = 10_000, seed: int = 42) -> DataFrame:
    """``(zkey, member, score, seq)``: one score for every member of every set."""
    return spark.range(sets * members).select(F.concat(F.lit("zset:"), (F.col("id") % sets).cast("string")).alias("zkey"), F.concat(F.lit("m"), F.floor(F.col("id") / sets).cast("string")).alias("member"), F.round(unit(seed, "id") * 1000, 3).alias("score"), F.col("id").alias("seq"))


def bit_writes(spark: SparkSession, n: int, bitmaps: int = 10, most: int = 100_000_000, seed: int = 42) -> DataFrame:
    """``(bkey, seq, offset, bit)``: writes to random offsets."""
    return spark.range(n).select(F.concat(F.lit("bitmap:"), (F.col("id") % bitmaps).cast("string")).alias("bkey"), F.col("id").alias("seq"), F.floor(unit(seed, "id") * most).alias("offset"), (unit(seed + 1, "id") < 0.5).cast("int").alias("bit"))


def unit_vectors(spark: SparkSession, n: int, dim: int = 128, seed: int = 42) -> DataFrame:
    """``(id, v)`` of length 1, their directions without a preference (components are normal deviates)."""
    normal = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.sqrt(-2 * F.log(1 - unit(seed, "id", i))) * F.cos(2 * F.pi() * unit(seed + 1, "id", i)))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return spark.range(n).select("id", normal.alias("v")).select("id", F.transform("v", lambda x: x / length).alias("v"))


def noisy_queries(vectors: DataFrame, every: int, noise: float = 0.1, seed: int = 7) -> DataFrame:
    """``(qid, q)``: every so many-th vector, each component moved by up to half of ``noise``, made of length 1 again."""
    moved = F.transform("v", lambda x, i: x + (unit(seed, "id", i) - 0.5) * noise)
    length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x))
    return vectors.where(F.col("id") % every == 0).select(F.col("id").alias("qid"), moved.alias("q")).select("qid", F.transform("q", lambda x: x / length).alias("q"))


def graph_edges(spark: SparkSession, nodes: int = 100_000, degree: int = 10, seed: int = 42) -> DataFrame:
    """``(src, dst, type, weight)``: up to ``degree`` edges from each node, none to itself and none twice."""
    to = F.floor(unit(seed, "id") * nodes)
    e = spark.range(nodes * degree).select((F.col("id") % nodes).alias("src"), to.alias("dst")).where("src <> dst").distinct()
    return e.select("src", "dst", F.lit("link").alias("type"), F.lit(1).cast("bigint").alias("weight"))


def stream_events(spark: SparkSession, n: int, streams: int = 100, step_us: int = 1000, seed: int = 42) -> DataFrame:
    """``(stream, seq, ts_us, type, value)``, one event after the other in time."""
    return spark.range(n).select(F.concat(F.lit("stream:"), (F.col("id") % streams).cast("string")).alias("stream"), F.col("id").alias("seq"), (F.col("id") * step_us).alias("ts_us"), F.lit("generic").alias("type"), (unit(seed, "id") * 100).alias("value"))
