"""Event streams as rows ``(stream, seq, ts_us, type, value, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def time_range(stream: DataFrame, start_us: int, end_us: int, keep: Column | None = None) -> DataFrame:
    """Events from ``start_us`` to ``end_us``, both included, that satisfy ``keep``."""
    found = stream.where(F.col("ts_us").between(start_us, end_us))
    return found if keep is None else found.where(keep)


def tumbling(stream: DataFrame, width_us: int, agg: str) -> DataFrame:
    """One aggregate of each window that has events; windows start at multiples of their width since 1970."""
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}")
    width = max(width_us, 1)
    bucket = (F.col("ts_us") - F.col("ts_us") % width).alias("bucket_us")
    return stream.groupBy("stream", bucket).agg(AGGREGATES[agg]("value").cast("double").alias("agg_value"))


def retained(stream: DataFrame, as_of_us: int, keep_us: int = 24 * 3_600_000_000) -> DataFrame:
    """Events not older than the retention time."""
    return stream.where(F.col("ts_us") >= as_of_us - keep_us)


def append(stream: DataFrame, batch: DataFrame, now_us: int, keep_us: int = 24 * 3_600_000_000) -> DataFrame:
    """The stream after a batch of events: what is older than the retention time goes first, then the batch comes in whole.
    Events without a time, or with 0, get ``now_us``, and those without a type are of type "generic"."""
    ts = F.when(F.coalesce("ts_us", F.lit(0)) == 0, F.lit(now_us)).otherwise(F.col("ts_us")).cast("bigint")
    new = batch.withColumn("ts_us", ts).withColumn("type", F.coalesce("type", F.lit("generic")))
    return retained(stream, now_us, keep_us).unionByName(new.select(*stream.columns))


def anomalies(stream: DataFrame, threshold: float = 2.5, least: int = 10) -> DataFrame:
    """Events whose distance from their stream's mean, in population standard deviations, exceeds ``threshold``.

    Streams of fewer than ``least`` events have none; a deviation of 0 counts as 1e-9. Means and deviations are aggregated
    first and joined back, so a stream that holds most events isn't gathered in one task.
    """
    found = stream.groupBy("stream").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("dev"), F.count("*").alias("n")).where(F.col("n") >= least)
    z = (F.col("value") - F.col("mean")) / F.when(F.col("dev") == 0, 1e-9).otherwise(F.col("dev"))
    return stream.join(found, "stream").withColumn("z", z).where(F.abs("z") > threshold).drop("mean", "dev", "n")


def forecast(stream: DataFrame, horizon_us: int) -> DataFrame:
    """The value that a least-squares line predicts ``horizon_us`` after each stream's last event; 0 if there is no line."""
    first = stream.groupBy("stream").agg(F.min("ts_us").alias("first_us"), F.max_by("ts_us", "seq").alias("last_us"))
    x = stream.join(first, "stream").withColumn("x", (F.col("ts_us") - F.col("first_us")) / 1e6)
    line = x.groupBy("stream").agg(F.count("*").alias("n"), F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"), F.first("first_us").alias("first_us"), F.first("last_us").alias("last_us"))
    at = (F.col("last_us") + horizon_us - F.col("first_us")) / 1e6
    return line.select("stream", F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce(F.col("intercept") + F.col("slope") * at, F.lit(0.0))).alias("forecast"))


def sequences(stream: DataFrame, by: str, types: list[str], within_us: int) -> DataFrame:
    """Matches of ``types`` one after the other: for each event of the first type the earliest later event of the second,
    then the earliest later one of the third, and so on; kept if the last is at most ``within_us`` after the first.

    Each step looks ahead in one ordered pass over a partition's events, so no pairs are made.
    """
    if len(types) < 2:
        raise ValueError("a pattern has two types at least")
    later = Window.partitionBy(by).orderBy(F.desc("ts_us"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)  # backwards: one running value
    found = stream.where(F.col("type").isin(types)).select(by, "seq", "ts_us", "type")
    chain = F.struct(F.col("ts_us").alias("end_us"), F.array("seq").alias("seqs"))
    found = found.withColumn("chain", F.when(F.col("type") == types[-1], chain))
    for t in reversed(types[:-1]):
        nxt = F.last("chain", ignorenulls=True).over(later)
        found = found.withColumn("next", nxt)
        found = found.withColumn("chain", F.when((F.col("type") == t) & F.col("next").isNotNull(), F.struct(F.col("next.end_us").alias("end_us"), F.concat(F.array("seq"), F.col("next.seqs")).alias("seqs")))).drop("next")
    return found.where("chain is not null").where(F.col("chain.end_us") - F.col("ts_us") <= within_us).select(by, F.col("ts_us").alias("start_us"), F.col("chain.end_us").alias("end_us"), F.col("chain.seqs").alias("seqs"))
