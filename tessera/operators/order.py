"""Places and neighbours in a sorted order without a task that holds all of it.

Rows are sorted into ranges by a distributed sort; windows run inside of a range only, and what must be known of other
ranges, a count or a first row for each range and key, is a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import reliable

#: Ranges into which an order is cut at most.
RANGES = 4096


def _free(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores behind them where ``columns`` has them already."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def in_ranges(df: DataFrame, *order, part: str = "part") -> DataFrame:
    """``df`` cut into ranges of the order, the range of each row in ``part``; written once, so that bounds stay as drawn."""
    ranges = min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return reliable(df.repartitionByRange(ranges, *order).withColumn(part, F.spark_partition_id()))


def _with(local: DataFrame, sums: DataFrame, part: str, keys: list[str]) -> DataFrame:
    """``local`` with the row of ``sums`` for its range and keys; a null key equals a null key."""
    names = _free([*local.columns, *sums.columns], *[f"key{i}" for i in range(len(keys) + 1)])
    for c, name in zip([part, *keys], names, strict=True):
        sums = sums.withColumnRenamed(c, name)
    same = F.col(part) == F.col(names[0])
    for c, name in zip(keys, names[1:], strict=True):
        same = same & F.col(c).eqNullSafe(F.col(name))
    return local.join(sums, same).drop(*names)


def placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with each row's ``place`` from 0 among the rows of its keys, and their number ``n``.

    ``order`` should leave no ties. A key's rows may be spread over many ranges; without keys all rows are one order.
    """
    part, c, base, m = _free([*df.columns, "place", "n"], "part", "c", "base", "m")
    cut = in_ranges(df, *keys, *order, part=part)
    sums = cut.groupBy(part, *keys).agg(F.count("*").alias(m))
    each = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # at most RANGES rows a key
    bases = sums.select(part, *keys, (F.sum(m).over(each.orderBy(part)) - F.col(m)).alias(base), F.sum(m).over(each).alias("n"))
    inside = Window.partitionBy(part, *keys).orderBy(*order)
    local = cut.withColumn(c, F.row_number().over(inside) - 1)
    return _with(local, bases, part, keys).withColumn("place", F.col(base) + F.col(c)).drop(part, c, base)


def following(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """``df`` with, in ``name``, the ``column`` of the next row of the same keys; null for the last."""
    part, ends, first, after = _free([*df.columns, name], "part", "ends", "first", "after")
    cut = in_ranges(df, *keys, *order, part=part)
    inside = Window.partitionBy(part, *keys).orderBy(*order)
    local = cut.withColumn(name, F.lead(column).over(inside)).withColumn(ends, F.lead(F.lit(1)).over(inside).isNull())
    firsts = cut.groupBy(part, *keys).agg(F.min_by(column, F.struct(*order)).alias(first))
    nexts = firsts.select(part, *keys, F.lead(first).over(Window.partitionBy(*keys).orderBy(part)).alias(after))  # at most RANGES rows a key
    return _with(local, nexts, part, keys).withColumn(name, F.when(F.col(ends), F.col(after)).otherwise(F.col(name))).drop(part, ends, after)
