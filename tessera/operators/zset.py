"""Sorted sets as rows ``(zkey, member, score)``, ordered by score and then member."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import order

#: Members whose places are asked for at once, and places from an end of a set that count as near to it.
MOST_ASKED, NEAR = 1000, 10_000


def fold(log: DataFrame) -> DataFrame:
    """The last score of each member of each set."""
    return log.groupBy("zkey", "member").agg(F.max_by("score", "seq").alias("score"))


def remove(zset: DataFrame, members: DataFrame) -> DataFrame:
    return zset.join(members, ["zkey", "member"], "left_anti")


def score(zset: DataFrame, zkey: str, member: str) -> DataFrame:
    return zset.where((F.col("zkey") == zkey) & (F.col("member") == member))


def ranks(zset: DataFrame) -> DataFrame:
    """Every member with its place from 0."""
    own = Window.partitionBy("zkey").orderBy("score", "member")
    return zset.withColumn("rank", F.row_number().over(own) - 1)


def rank_of(zset: DataFrame, zkey: str, members: DataFrame) -> DataFrame:
    """Places of the asked ``members(member)`` of one set; -1 for one that isn't there.

    Up to ``MOST_ASKED`` members are a request: their scores go to the scan as one sorted row, each entry of the set counts
    into the gap between two of them that it falls in, and the counts of the gaps are summed up. More are joined to the
    places of the whole set.
    """
    one = zset.where(F.col("zkey") == zkey).select("member", "score")
    asked = members.select("member").distinct()
    if asked.limit(MOST_ASKED + 1).count() > MOST_ASKED:
        found = order.placed(one, [], ["score", "member"]).select("member", F.col("place").alias("rank"))
        return asked.join(found, "member", "left").select("member", F.coalesce("rank", F.lit(-1)).cast("bigint").alias("rank"))
    met = one.join(F.broadcast(asked), "member", "left_semi").agg(F.sort_array(F.collect_list(F.struct("score", "member"))).alias("asked"))  # one row of MOST_ASKED at most
    gap = F.size(F.filter("asked", lambda x: x < F.struct("score", "member")))
    gaps = one.join(F.broadcast(met)).groupBy(gap.alias("gap")).agg(F.count("*").alias("n"))
    before = Window.orderBy("gap").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over MOST_ASKED + 1 rows
    sums = gaps.select("gap", (F.sum("n").over(before) - 1).alias("rank"))
    ranked = met.select(F.posexplode("asked").alias("gap", "x")).join(F.broadcast(sums), "gap").select("x.member", "rank")
    return asked.join(F.broadcast(ranked), "member", "left").select("member", F.coalesce("rank", F.lit(-1)).cast("bigint").alias("rank"))


def by_position(zset: DataFrame, start: int, stop: int) -> DataFrame:
    """Members at places ``start`` to ``stop`` of every set, both included; negative places count from the end.

    Where both places count from the same end and lie within ``NEAR`` of it, each task keeps as many of a set's members
    before the shuffle as could be meant; else places are found by ranges.
    """
    if 0 <= start and 0 <= stop < NEAR:
        return ranks(zset).where(F.col("rank").between(start, stop))
    if -NEAR <= start < 0 and stop < 0:
        back = Window.partitionBy("zkey").orderBy(F.desc("score"), F.desc("member"))
        tail = zset.withColumn("back", F.row_number().over(back)).where(F.col("back") <= -start).where(F.col("back") >= -stop)
        return tail.join(card(zset), "zkey").withColumn("rank", (F.col("card") - F.col("back")).cast("int")).drop("back", "card")
    at = lambda x: F.lit(x) if x >= 0 else F.col("n") + x
    found = order.placed(zset, ["zkey"], ["score", "member"])
    kept = found.where((F.col("place") >= F.greatest(at(start), F.lit(0))) & (F.col("place") <= at(stop)))
    return kept.withColumn("rank", F.col("place").cast("int")).drop("n", "place")


def card(zset: DataFrame) -> DataFrame:
    return zset.groupBy("zkey").agg(F.count("*").alias("card"))
