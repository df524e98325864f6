"""Planning of eviction, admission and times to live. Nothing is removed here: each operator returns what would be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.order import in_ranges


def victims(entries: DataFrame, order: list[Column], need: int, most: int | None = None) -> DataFrame:
    """The first entries in ``order`` until ``need`` bytes are free, the one that reaches it included; ``most`` at most.

    Entries are cut into ranges of the order by a distributed sort; sums of the ranges come first, and only the running
    sum inside a range is a window. ``freed`` is the sum up to and with each victim, ``place`` its place from 1.
    """
    placed = in_ranges(entries, *order)
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumn("s", F.sum("size").over(inside)).withColumn("c", F.count("*").over(inside))
    sums = local.groupBy("part").agg(F.max("s").alias("part_s"), F.max("c").alias("part_c"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    bases = sums.select("part", F.coalesce(F.sum("part_s").over(before), F.lit(0)).alias("base_s"), F.coalesce(F.sum("part_c").over(before), F.lit(0)).alias("base_c"))
    found = local.join(F.broadcast(bases), "part").withColumn("freed", F.col("base_s") + F.col("s")).withColumn("place", F.col("base_c") + F.col("c"))
    found = found.where((F.col("freed") - F.col("size") < need) & F.lit(need > 0))
    found = found if most is None else found.where(F.col("place") <= most)
    return found.drop("part", "s", "c", "base_s", "base_c")


def lru(entries: DataFrame, need: int, most: int | None = None) -> DataFrame:
    """Victims by last access, the oldest first, ties by key."""
    return victims(entries, [F.asc("last_us"), F.asc("key")], need, most)


def lfu(entries: DataFrame, need: int, most: int | None = None) -> DataFrame:
    """Victims by accesses, the fewest first, ties by key."""
    return victims(entries, [F.asc("accesses"), F.asc("key")], need, most)


def emergency(entries: DataFrame, need: int, batch: int = 1000, attempts: int = 3) -> DataFrame:
    """The victims of an emergency: by accesses in up to ``attempts`` batches of ``batch`` entries and, if they free too
    little, by last access for what is left. ``step`` tells the two apart. Ends short if nothing is left to evict."""
    first = lfu(entries, need, batch * attempts).withColumn("step", F.lit("batch"))
    freed = first.agg(F.max("freed")).first()[0] or 0
    if freed >= need:
        return first
    rest = entries.join(first.select("tenant", "key"), ["tenant", "key"], "left_anti")
    return first.unionByName(lru(rest, need - freed).withColumn("step", F.lit("force")))


def evict_key(entries: DataFrame, key: str) -> DataFrame:
    """The entry of one key; none for an empty key or one that isn't there."""
    return entries.where((F.col("key") == key) & F.lit(key != ""))


def reserve(entries: DataFrame, new_size: int, capacity: int) -> DataFrame:
    """The victims, by last access, that make room for ``new_size`` bytes; none if there is room or no capacity is set.

    Raises if the new entry is larger than the capacity.
    """
    if capacity and new_size > capacity:
        raise ValueError("insufficient storage")
    used = (entries.agg(F.sum("size")).first()[0] or 0) if capacity else 0
    return lru(entries, used + new_size - capacity if capacity else 0)


def by_priority(entries: DataFrame) -> DataFrame:
    """The one entry with the least expiry (nanoseconds, 0 if none) plus a million for each byte, ties by key."""
    priority = F.coalesce(F.col("expire_us") * 1000, F.lit(0)) + F.col("size") * 1_000_000
    return entries.withColumn("priority", priority).orderBy("priority", "key").limit(1)


def decision(used: Column, capacity: int, threshold: float = 0.80, target: float = 0.70) -> list[Column]:
    """Usage ratio, whether eviction is due (at the capacity only), whether usage is above the threshold, and the bytes that
    the background worker would free to reach its target."""
    ratio = used / capacity
    over = F.greatest(used - F.lit(int(capacity * target)), F.lit(0)).cast("bigint")
    return [F.round(ratio, 6).alias("ratio"), (ratio >= 1).alias("must_evict"), (ratio >= threshold).alias("above_threshold"), F.when(ratio >= threshold, over).otherwise(F.lit(0).cast("bigint")).alias("target_bytes")]


def admits(new_estimate: Column, victim_estimate: Column) -> Column:
    """A new key is admitted if it would be as frequent as its victim."""
    return new_estimate + 1 >= victim_estimate


def adaptive_ttl(accesses: Column, age_s: Column, least: float, most: float) -> Column:
    """Seconds to live between two bounds, by accesses that decay within an hour of age."""
    share = F.least(F.lit(1.0), accesses * F.exp(-age_s / 3600) / 100)
    return F.when(accesses == 0, F.lit(float(least))).otherwise(least + share * (most - least))


def adaptive_ttl_with(accesses: Column, age_s: Column, least: float, most: float, priority: float = 0.0, least_override: float = 0.0, most_override: float = 0.0) -> Column:
    """The same with other bounds, where they are above 0, and with the accesses weighted by a priority above 0."""
    least, most = least_override if least_override > 0 else least, most_override if most_override > 0 else most
    weighted = accesses * priority if priority > 0 else accesses
    return F.when(accesses == 0, F.lit(float(least))).otherwise(adaptive_ttl(weighted, age_s, least, most))


def optimal_ttl(latency_ms: Column, accesses_per_hour: Column, least: float, most: float) -> Column:
    """Seconds to live by what a miss costs and how often it would occur."""
    return least + F.least(F.lit(1.0), latency_ms / 100 * accesses_per_hour / 1000) * (most - least)


def ttl_distribution(entries: DataFrame, as_of_us: int) -> DataFrame:
    """Least, mean, median and greatest seconds to live of the entries that expire. The median is the mean of the two middle
    values, which are found by ranges."""
    ttl = entries.where("expire_us is not null").select(((F.col("expire_us") - as_of_us) / 1e6).alias("ttl"))
    middle = [F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)]
    median = values_at(ttl, "ttl", lambda total: total.where("total > 0").select(F.explode(F.array(*middle)).alias("i"))).agg(F.round(F.avg("value"), 6).alias("p50_ttl"))
    ends = ttl.agg(F.count("*").alias("n"), F.round(F.min("ttl"), 6).alias("min_ttl"), F.round(F.avg("ttl"), 6).alias("avg_ttl"), F.round(F.max("ttl"), 6).alias("max_ttl"))
    return ends.join(F.broadcast(median)).select("n", "min_ttl", "avg_ttl", "p50_ttl", "max_ttl")  # one row each


def qps_profile(qps: Column) -> Column:
    """Tuning profile of a request rate."""
    return F.when(qps > 100_000, "ultra").when(qps > 50_000, "high").when(qps > 10_000, "balanced").otherwise("lowlatency")


def peer_health(silent_ms: Column, lag_ms: Column) -> Column:
    """DOWN after 30 s of silence, DEGRADED beyond 5 s of lag, HEALTHY else."""
    return F.when(silent_ms > 30_000, "DOWN").when(lag_ms > 5_000, "DEGRADED").otherwise("HEALTHY")


def quorum(configured: Column, peers: Column) -> Column:
    """The acknowledgements that a write waits for: what is configured, or a majority."""
    return F.when(configured > 0, configured).otherwise(F.floor(peers / 2).cast("int") + 1)


def values_at(values: DataFrame, column: str, asked) -> DataFrame:
    """The rows of ``asked(total)`` (``i``: a place from 0; ``total``: one row, how many values there are), each with the
    ``value`` at its place. There should be few.

    Values are counted first and the running count is taken over distinct values cut into ranges, as victims are.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("size")).withColumn("key", F.col("v"))
    places = asked(counted.agg(F.sum("size").alias("total")))
    placed = victims(counted, [F.asc("v")], 1 << 62)
    found = placed.join(F.broadcast(places), (F.col("freed") > F.col("i")) & (F.col("freed") - F.col("size") <= F.col("i")))
    return found.withColumn("value", F.col("v")).select(*places.columns, "value")


def percentiles(values: DataFrame, column: str, points: list[float]) -> DataFrame:
    """Nearest-rank percentiles: the value at place ``int(n * p)`` from 0, the last one at most."""
    at = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.least(F.floor(F.col("total") * F.lit(p)).cast("bigint"), F.col("total") - 1).alias("i")) for p in points]))
    return values_at(values, column, lambda total: total.where("total > 0").select(at.alias("a")).select("a.p", "a.i")).select("p", "value")
