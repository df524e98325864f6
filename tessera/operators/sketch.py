"""Bloom filters and count-min sketches in row form: a row for each set bit, or for each counter.

Hash values come from digests of the key, two for each sketch, and are combined as ``h1 + i * h2`` with an odd ``h2``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions of a filter for ``n`` keys with a false-positive rate of ``p``."""
    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return m, math.ceil(m / n * math.log(2))


def bloom_sizes(n: Column, p: Column) -> tuple[Column, Column]:
    """The same for columns."""
    m = F.ceil(-n * F.ln(p) / (F.ln(F.lit(2.0)) * F.ln(F.lit(2.0))))
    return m, F.ceil(m / n * F.ln(F.lit(2.0)))


def _hash(key: Column, salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint")


def positions(key: Column, m: int, k: int) -> Column:
    """The ``k`` bit positions of a key."""
    h1, h2 = _hash(key, "a"), _hash(key, "b").bitwiseOR(F.lit(1).cast("bigint"))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(h1 + i * h2, F.lit(m).cast("bigint")))


def bloom_build(keys: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """``(bit)``: the distinct set bits."""
    return keys.select(F.explode(positions(F.col(key), m, k)).alias("bit")).distinct()


def bloom_probe(asked: DataFrame, key: str, bits: DataFrame, m: int, k: int) -> DataFrame:
    """``asked`` with whether the filter may contain each key: all its bits are set."""
    each = asked.select(key, F.explode(F.array_distinct(positions(F.col(key), m, k))).alias("bit"))
    met = each.join(bits.withColumn("is_set", F.lit(1)), "bit", "left").groupBy(key).agg(F.min(F.coalesce("is_set", F.lit(0))).alias("is_set"))
    return met.select(key, (F.col("is_set") == 1).alias("may_contain"))


def bloom_export(bits: DataFrame) -> DataFrame:
    """``(word, value)``: the filter as 64-bit words, bit ``i`` of a word being its ``i``-th from the lowest; words without a
    set bit have no row."""
    at = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    return bits.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(at).alias("value"))


def bloom_import(words: DataFrame, m: int) -> DataFrame:
    """``(bit)`` of an exported filter of ``m`` bits; a bit beyond them is an error."""
    each = words.select("word", "value", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).where(F.expr("shiftrightunsigned(value, i) & 1 = 1"))
    bit = F.col("word") * 64 + F.col("i")
    return each.select(F.when(bit < m, bit).otherwise(F.raise_error("not a filter of that size").cast("bigint")).alias("bit"))


def bloom_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def bloom_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def bloom_stats(bits: DataFrame, m: int, k: int) -> DataFrame:
    """Set bits, share of set bits, and the false-positive rate this implies."""
    return bits.agg(F.count("*").alias("bits")).select("bits", F.round(F.col("bits") / m, 9).alias("fill"), F.round(F.pow(F.col("bits") / m, F.lit(k)), 9).alias("fpr"))


def cms_build(keys: DataFrame, key: str, width: int, depth: int) -> DataFrame:
    """``(d, bucket, n)``: the counters that aren't zero. Equal keys are counted first, so that a hot key is one row a task."""
    counted = keys.groupBy(key).agg(F.count("*").alias("c"))
    return counted.select(F.posexplode(positions(F.col(key), width, depth)).alias("d", "bucket"), "c").groupBy("d", "bucket").agg(F.sum("c").alias("n"))


def cms_estimate(asked: DataFrame, key: str, counters: DataFrame, width: int, depth: int) -> DataFrame:
    """The least of each key's counters; never below its true count."""
    each = asked.select(key, F.posexplode(positions(F.col(key), width, depth)).alias("d", "bucket"))
    return each.join(counters, ["d", "bucket"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).cast("bigint").alias("estimate"))
