"""Catalogs of named objects (vector indexes, graphs) from a log ``(name, seq, op, ...)`` of CREATE and DROP."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live(log: DataFrame) -> DataFrame:
    """The objects that exist after the log, with the columns of the CREATE that made them: the first one after the last
    DROP. Dropping what doesn't exist changes nothing."""
    dropped = log.where("op = 'DROP'").groupBy("name").agg(F.max("seq").alias("gone"))
    made = log.where("op = 'CREATE'").join(dropped, "name", "left").where("gone is null or seq > gone").drop("gone", "op")
    rest = [c for c in made.columns if c != "name"]
    return made.groupBy("name").agg(F.min_by(F.struct(*rest), "seq").alias("o")).select("name", *[F.col(f"o.{c}").alias(c) for c in rest])


def refused(log: DataFrame) -> DataFrame:
    """The CREATEs of names that were taken: the one before them in the name's log was a CREATE too.

    A name's log is short: it has a row for each time the object was made or dropped.
    """
    from pyspark.sql import Window

    own = Window.partitionBy("name").orderBy("seq")
    return log.withColumn("was", F.lag("op").over(own)).where("op = 'CREATE' and was = 'CREATE'").drop("was")
