"""The engine's data model derived from the driver tables: op-log, reads, streams, sorted sets, bitmaps, vectors, graphs.

Times are microseconds since 1970 (BIGINT), so that no session time zone enters a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.order import following
from tessera.sources.tables import table

#: The instant all policy and expiry queries refer to: 2024-01-31 00:00:00.
AS_OF_US = 1_706_659_200_000_000
HOUR_US = 3_600_000_000


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, F.col(ts) if isinstance(ts, str) else ts)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, stream, ts_us, type, user_id, value, k)``: one event stream for each event type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("stream"), micros("ts").alias("ts_us"), F.col("event_type").alias("type"), "user_id", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(tenant, seq, ts_us, op, key, value, delta, ttl_us)``: purchases and sign-ups set a user's value (sign-ups for six
    hours), clicks add to it, errors delete it."""
    e = events(spark, sf_dir).where(F.col("type") != "view")
    sets = F.col("type").isin("purchase", "signup")
    return e.select(
        F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant"),
        "seq",
        "ts_us",
        F.when(sets, "SET").when(F.col("type") == "click", "INCR").otherwise("DEL").alias("op"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.when(sets, F.round("value").cast("bigint").cast("string")).alias("value"),
        F.when(F.col("type") == "click", F.col("k")).alias("delta"),
        F.when(F.col("type") == "signup", F.lit(6 * HOUR_US)).alias("ttl_us"),
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(tenant, seq, ts_us, key)``: every view reads the user's value."""
    e = events(spark, sf_dir).where(F.col("type") == "view")
    return e.select(F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant"), "seq", "ts_us", F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"))


def zset_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(zkey, member, score, seq)``: each event adds its user to its type's set with the event's value as score."""
    return events(spark, sf_dir).select(F.col("type").alias("zkey"), F.col("user_id").cast("string").alias("member"), F.round("value", 2).alias("score"), "seq")


def bit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(bkey, seq, offset, bit)``: each event writes its user's bit of its type's bitmap."""
    return events(spark, sf_dir).select(F.col("type").alias("bkey"), "seq", F.col("user_id").alias("offset"), (F.col("k") % 2).cast("int").alias("bit"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, v, label)`` with the components as doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, name, region)`` and edges ``(src, dst, type, weight)``: who sells to whom, the three heaviest a source."""
    nation = table(spark, sf_dir, "nation")
    nodes = nation.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region"))
    sold = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("src")), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("dst")), F.col("o_custkey") == F.col("c_custkey"))
    )
    pairs = sold.groupBy("src", "dst").agg(F.count("*").alias("weight"))
    best = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    top = pairs.withColumn("r", F.row_number().over(best)).where("r <= 3").drop("r")
    edges = top.join(nodes.select(F.col("id").alias("dst"), F.col("region").cast("string").alias("type")), "dst")
    return nodes, edges.select("src", "dst", "type", "weight")


def user_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id)`` and edges ``(src, dst, type, weight)``: from each user to the next one in the same event type. Events are
    cut into ranges of time, so that a frequent type isn't one task's."""
    e = events(spark, sf_dir)
    pairs = following(e.select("type", "ts_us", "seq", "user_id"), ["type"], ["ts_us", "seq"], "user_id", "dst").where("dst is not null and dst <> user_id")
    edges = pairs.groupBy(F.col("user_id").alias("src"), "dst").agg(F.count("*").alias("weight"), F.min_by("type", "seq").alias("type"))
    return e.select(F.col("user_id").alias("id")).distinct(), edges.select("src", "dst", "type", "weight")
