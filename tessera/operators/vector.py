"""Exact nearest neighbours and semantic lookups over rows ``(id, v, ...)`` with ``v`` an array of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import naming

#: Distances are rounded to this many digits before they are ordered, so that sums taken in another order agree.
DIGITS = 6
#: Queries that may be broadcast to the scan of the vectors; a request's worth.
MOST_QUERIES = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """1 minus the cosine; 1 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 1.0).otherwise(1 - dot(a, b) / F.when(size != 0, size))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def negative_dot(a: Column, b: Column) -> Column:
    return -dot(a, b)


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


METRICS = {"cosine": cosine, "euclidean": euclidean, "dot": negative_dot, "manhattan": manhattan}


def metric(name: str):
    """The distance of that name; cosine for one that isn't known."""
    return METRICS.get(name, cosine)


def nearest(vectors: DataFrame, query: DataFrame, k: int, name: str = "cosine") -> DataFrame:
    """The ``k`` vectors nearest to the one vector of ``query(q)``: a scan and a top-k, without a shuffle of vectors."""
    found = vectors.join(F.broadcast(query.limit(1)), F.size("v") == F.size("q"))  # one row
    return found.withColumn("distance", F.round(metric(name)(F.col("v"), F.col("q")), DIGITS)).drop("v", "q").orderBy("distance", "id").limit(k)


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int, name: str = "cosine") -> DataFrame:
    """The ``k`` nearest of every query of ``queries(qid, q)``, a stated set of at most ``MOST_QUERIES``; each task keeps the
    best ``k`` a query before the shuffle."""
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries; search them in blocks")
    found = vectors.join(F.broadcast(queries), F.size("v") == F.size("q"))
    best = Window.partitionBy("qid").orderBy("distance", "id")
    found = found.withColumn("distance", F.round(metric(name)(F.col("v"), F.col("q")), DIGITS)).drop("v", "q")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def with_values(hits: DataFrame, kv: DataFrame, as_of_us: int) -> DataFrame:
    """Hits whose key still has a live value; fewer than k may be left, as the search came first."""
    live = kv.where(F.col("expire_us").isNull() | (F.col("expire_us") >= as_of_us))
    return hits.join(live.drop("expire_us"), hits.id == live.key).drop("key")


def best_match(vectors: DataFrame, query: DataFrame, kv: DataFrame, least_similarity: float, as_of_us: int) -> DataFrame:
    """The value of the nearest vector, if its distance is at most 1 minus the similarity asked for."""
    hit = nearest(vectors, query, 1).where(F.col("distance") <= F.lit(1 - least_similarity))
    return with_values(hit, kv, as_of_us)


def normalized(v: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def first_of_each(log: DataFrame) -> DataFrame:
    """The first vector that was inserted under each id of ``log(id, seq, v)``; later ones are passed over."""
    return log.groupBy("id").agg(F.min_by("v", "seq").alias("v"), F.min("seq").alias("seq"))


def indexes(log: DataFrame) -> DataFrame:
    """``(name, seq, dimension, metric)`` of the indexes that exist after ``log(name, seq, op, dimension, metric)``; a metric
    that isn't known counts as cosine."""
    known = F.when(F.col("metric").isin(*METRICS), F.col("metric")).otherwise("cosine")
    return naming.live(log).withColumn("metric", known)


def index_entries(made: DataFrame, log: DataFrame) -> DataFrame:
    """``(name, id, seq, v)`` after ``log(name, id, seq, op, v)`` of INSERT and DELETE: the first vector of the index's
    dimension that was inserted under an id since the index was made and the id was last deleted."""
    own = log.join(made.select("name", F.col("seq").alias("made"), "dimension"), "name").where("seq > made")
    gone = own.where("op = 'DELETE'").groupBy("name", "id").agg(F.max("seq").alias("gone"))
    put = own.where((F.col("op") == "INSERT") & (F.size("v") == F.col("dimension"))).join(gone, ["name", "id"], "left").where("gone is null or seq > gone")
    return put.groupBy("name", "id").agg(F.min_by("v", "seq").alias("v"), F.min("seq").alias("seq")).select("name", "id", "seq", "v")


def index_refusals(made: DataFrame, log: DataFrame, most: int) -> DataFrame:
    """Operations on indexes as they are now that were refused: ``(name, id, seq, reason)``. There is no such index, the
    vector has another dimension, or ``most`` INSERTs came before (repeated ids count, as they do for the limit)."""
    ops = log.join(made.select("name", F.col("seq").alias("made"), "dimension"), "name", "left").where("made is null or seq > made")
    wrong = F.when(F.col("made").isNull(), "no index").when((F.col("op") == "INSERT") & (F.size("v") != F.col("dimension")), "dimension")
    judged = ops.select("name", "id", "seq", "op", wrong.alias("reason"))
    taken = judged.where("op = 'INSERT' and reason is null").select("seq").orderBy("seq").limit(most).agg(F.max("seq").alias("last"), F.count("*").alias("n"))
    full = judged.join(F.broadcast(taken)).withColumn("reason", F.when((F.col("op") == "INSERT") & F.col("reason").isNull() & (F.col("n") >= most) & (F.col("seq") > F.col("last")), "full").otherwise(F.col("reason")))  # one row
    return full.where("reason is not null").select("name", "id", "seq", "reason")


def put_with_embeddings(puts: DataFrame) -> DataFrame:
    """``(key, value, v)`` after ``puts(key, seq, value, v)``: the last value of each key, and the first vector put with it
    that has the dimension of the very first put. A key must not be empty."""
    checked = puts.withColumn("key", F.when(F.length("key") > 0, F.col("key")).otherwise(F.raise_error("empty key").cast("string")))
    first = checked.agg(F.min_by(F.size("v"), "seq").alias("dimension"))
    fits = checked.join(F.broadcast(first)).where(F.size("v") == F.col("dimension"))  # one row
    values = checked.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    return values.join(fits.groupBy("key").agg(F.min_by("v", "seq").alias("v")), "key", "left")


def index_stats(vectors: DataFrame) -> DataFrame:
    """Vectors, dimension and distinct labels."""
    return vectors.agg(F.count("*").alias("size"), F.max(F.size("v")).cast("bigint").alias("dimension"), F.count_distinct("label").alias("labels"))
