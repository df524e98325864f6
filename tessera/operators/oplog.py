"""The op-log itself: ranges of sequence numbers, trimming, change capture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MOST_SWITCHES = 1000


def since(log: DataFrame, seq: int) -> DataFrame:
    """Operations after ``seq``."""
    return log.where(F.col("seq") > seq)


def between(log: DataFrame, first: int, last: int) -> DataFrame:
    """Operations from ``first`` to ``last``, both included."""
    return log.where(F.col("seq").between(first, last))


def head(log: DataFrame) -> DataFrame:
    """The largest sequence number and the number of operations."""
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"), F.count("*").alias("size"))


def trim(log: DataFrame, keep: int) -> DataFrame:
    """The last ``keep`` operations of a log without gaps or with them: those at or above the keep-th largest number.

    The bound comes from a top-k, so nothing but ``keep`` numbers is ever gathered.
    """
    bound = log.select("seq").orderBy(F.desc("seq")).limit(keep).agg(F.min("seq").alias("bound"))
    return log.join(F.broadcast(bound), F.col("seq") >= F.col("bound")).drop("bound")  # one row


def changes(log: DataFrame) -> DataFrame:
    """Change records: value 1 for a write and 0 for a delete, and the new value if it is between 1 and 1023 bytes."""
    n = F.octet_length("value")
    return log.where(F.col("op").isin("SET", "DEL")).select("seq", "ts_us", F.when(F.col("op") == "SET", "PUT").otherwise("DEL").alias("type"), F.when(F.col("op") == "SET", 1.0).otherwise(0.0).alias("value"), "key", F.when((n > 0) & (n < 1024), F.col("value")).alias("val"))


def changes_while(log: DataFrame, switches: DataFrame) -> DataFrame:
    """The change records of the times at which capture was on: ``switches(seq, is_on)`` holds from its number on, and before
    the first it is off. At most ``MOST_SWITCHES``, which go to the scan as one row."""
    if switches.limit(MOST_SWITCHES + 1).count() > MOST_SWITCHES:
        raise ValueError(f"more than {MOST_SWITCHES} switches")
    one = switches.agg(F.sort_array(F.collect_list(F.struct("seq", "is_on"))).alias("switches"))
    last = F.element_at(F.filter("switches", lambda x: x["seq"] <= F.col("seq")), -1)
    before = F.size(F.filter("switches", lambda x: x["seq"] <= F.col("seq"))) > 0
    return changes(log).join(F.broadcast(one)).where(F.when(before, last["is_on"]).otherwise(F.lit(False))).drop("switches")  # one row


def offsets(log: DataFrame) -> DataFrame:
    """``(stream, group, offset_us)``: the last offset that each group set on each stream in ``log(stream, group, seq,
    offset_us)``."""
    return log.groupBy("stream", "group").agg(F.max_by("offset_us", "seq").alias("offset_us"))


def offset_of(known: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(stream, group)`` with their offsets, 0 for those that never set one."""
    return asked.join(known, ["stream", "group"], "left").select("stream", "group", F.coalesce("offset_us", F.lit(0)).cast("bigint").alias("offset_us"))


def read_after(stream: DataFrame, offset_us: int, count: int) -> DataFrame:
    """The first ``count`` records after an offset, in order of time."""
    return stream.where(F.col("ts_us") > offset_us).orderBy("ts_us", "seq").limit(count)
