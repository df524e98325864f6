"""Key-value state as a fold of an append-only op-log, and the queries over that state.

The log is ``(tenant, seq, ts_us, op, key, value, delta, ttl_us)`` with SET, DEL and INCR. All folds are aggregates with a
map-side part, so a hot key costs one row a task; nothing sorts a key's whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["tenant", "key"]


def fold(log: DataFrame) -> DataFrame:
    """``(tenant, key, value, size, expire_us, created_us, write_seq, is_error)`` after the whole log.

    The last SET or DEL of a key is its base; INCRs after it are added and clear the expiry. If the base expired before the
    first of them, counting starts at 0. A base that isn't an integer gives an error row without a value.
    """
    base = log.where(F.col("op").isin("SET", "DEL")).groupBy(KEY).agg(F.max_by(F.struct("op", "value", "ts_us", "ttl_us", "seq"), "seq").alias("b"))
    added = log.where(F.col("op") == "INCR").join(base.select(*KEY, F.col("b.seq").alias("base_seq")), KEY, "left").where("base_seq is null or seq > base_seq")
    sums = added.groupBy(KEY).agg(F.sum("delta").alias("inc"), F.min_by("ts_us", "seq").alias("first_us"), F.max_by("ts_us", "seq").alias("last_us"), F.max("seq").alias("last_seq"))
    both = base.join(sums, KEY, "full").where("b.op = 'SET' or inc is not null")
    kept = F.expr("b.op = 'SET' and (b.ttl_us is null or first_us <= b.ts_us + b.ttl_us)")
    start = F.when(kept, F.expr("try_cast(b.value as bigint)")).otherwise(F.lit(0).cast("bigint"))
    counted = F.col("inc").isNotNull()
    value = F.when(counted, (start + F.col("inc")).cast("string")).otherwise(F.col("b.value"))
    return both.select(
        *KEY,
        value.alias("value"),
        F.octet_length(value).cast("bigint").alias("size"),
        F.when(~counted, F.expr("b.ts_us + b.ttl_us")).alias("expire_us"),
        F.when(counted, F.col("last_us")).otherwise(F.col("b.ts_us")).alias("created_us"),
        F.coalesce("last_seq", "b.seq").alias("write_seq"),
        (counted & start.isNull()).alias("is_error"),
    )


def is_live(as_of_us: int | Column) -> Column:
    """An entry is expired only after its expiry, not at it."""
    return F.col("expire_us").isNull() | (F.col("expire_us") >= (F.lit(as_of_us) if isinstance(as_of_us, int) else as_of_us))


def entries(log: DataFrame, reads: DataFrame) -> DataFrame:
    """The folded state with ``accesses`` (two for the write, one for each read after it that found the entry live) and
    ``last_us``, the last of these."""
    state = fold(log)
    met = state.select(*KEY, "write_seq", "expire_us").join(reads, KEY).where((F.col("seq") > F.col("write_seq")) & is_live(F.col("ts_us")))
    seen = met.groupBy(KEY).agg(F.count("*").alias("n"), F.max("ts_us").alias("read_us"))
    return state.join(seen, KEY, "left").select("*", (F.coalesce("n", F.lit(0)) + 2).alias("accesses"), F.greatest("created_us", "read_us").alias("last_us")).drop("n", "read_us")


def get(state: DataFrame, tenant: str, key: str, as_of_us: int) -> DataFrame:
    """The live entry of a key, or no row."""
    return state.where((F.col("tenant") == tenant) & (F.col("key") == key) & is_live(as_of_us))


def mget(state: DataFrame, keys: DataFrame, as_of_us: int) -> DataFrame:
    """The live entries of ``keys(tenant, key)``; misses give no row."""
    return state.where(is_live(as_of_us)).join(keys, KEY)


def exists(state: DataFrame, keys: DataFrame, as_of_us: int) -> DataFrame:
    """``keys`` with whether each has a live entry."""
    live = state.where(is_live(as_of_us)).select(*KEY, F.lit(True).alias("found"))
    return keys.join(live, KEY, "left").select(*KEY, F.coalesce("found", F.lit(False)).alias("is_there"))


def ttl_remaining(state: DataFrame, as_of_us: int) -> DataFrame:
    """Microseconds until each live entry expires; null if it never does."""
    return state.where(is_live(as_of_us)).select(*KEY, F.when(F.col("expire_us").isNotNull(), F.greatest(F.col("expire_us") - as_of_us, F.lit(0))).alias("ttl_us"))


def update_ttl(state: DataFrame, changes: DataFrame, as_of_us: int) -> DataFrame:
    """The state with new times to live for the live entries of ``changes(tenant, key, ttl_us)``; one of 0 or less lets an
    entry live for good."""
    asked = changes.select(*KEY, F.col("ttl_us").alias("new_ttl"), F.lit(True).alias("asked"))
    expire = F.when(F.col("new_ttl") > 0, F.lit(as_of_us) + F.col("new_ttl"))
    found = state.join(asked, KEY, "left")
    return found.withColumn("expire_us", F.when(F.col("asked") & is_live(as_of_us), expire).otherwise(F.col("expire_us"))).select(*state.columns)


def delete_if_expired(state: DataFrame, keys: DataFrame, as_of_us: int) -> DataFrame:
    """``keys(tenant, key)`` with whether each was there, had expired and so is deleted, and the bytes this frees."""
    gone = sweep(state, as_of_us).select(*KEY, "size")
    return keys.join(gone, KEY, "left").select(*KEY, F.col("size").isNotNull().alias("is_deleted"), F.coalesce("size", F.lit(0)).cast("bigint").alias("freed"))


def sweep(state: DataFrame, as_of_us: int) -> DataFrame:
    """The expired entries, all of them: what a clean-up pass removes."""
    return state.where(~is_live(as_of_us))


def metadata(found: DataFrame, as_of_us: int) -> DataFrame:
    """Key, size, accesses, age and time to live in milliseconds, last access and creation of every entry."""
    ttl = F.when(F.col("expire_us").isNotNull(), F.greatest(F.floor((F.col("expire_us") - as_of_us) / 1000), F.lit(0)).cast("bigint"))
    age = F.floor((F.lit(as_of_us) - F.col("created_us")) / 1000).cast("bigint")
    return found.select(*KEY, "size", "accesses", age.alias("age_ms"), ttl.alias("ttl_ms"), "last_us", "created_us")


def scores(found: DataFrame, as_of_us: int) -> DataFrame:
    """Eviction scores: hotness (accesses a second of age, times 1000, cut to an integer), and the LFU, LRU and size ones."""
    age = (F.lit(as_of_us) - F.col("created_us")) / 1e6
    hot = F.when(age <= 0, F.col("accesses")).otherwise((F.col("accesses") / age * 1000).cast("bigint"))
    return found.select(*KEY, hot.alias("score"), F.col("accesses").alias("lfu_score"), (-F.col("last_us")).alias("lru_score"), F.col("size").alias("size_score"))


def stats(state: DataFrame) -> DataFrame:
    """Entries, expired ones not yet swept included, and their bytes."""
    return state.agg(F.count("*").alias("items"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def tenant_stats(state: DataFrame) -> DataFrame:
    return state.groupBy("tenant").agg(F.count("*").alias("items"), F.sum("size").alias("bytes"))


def hits(log: DataFrame, reads: DataFrame) -> DataFrame:
    """``(tenant, key, seq, is_hit)`` of every read: whether the key's state just before it was live.

    Reads meet the last mutation before them in one pass over each key's log, ordered by sequence; the window holds one
    struct, whatever the length of the history. INCR makes an entry that doesn't expire.
    """
    from pyspark.sql import Window

    m = log.select(*KEY, "seq", "ts_us", F.struct(F.col("op"), F.when(F.col("op") == "SET", F.col("ts_us") + F.col("ttl_us")).alias("expire_us")).alias("state"))
    r = reads.select(*KEY, "seq", "ts_us", F.lit(None).cast(m.schema["state"].dataType).alias("state"))
    before = Window.partitionBy(*KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = m.withColumn("is_read", F.lit(False)).union(r.withColumn("is_read", F.lit(True))).withColumn("s", F.last("state", ignorenulls=True).over(before))
    hit = F.coalesce((F.col("s.op") != "DEL") & (F.col("s.expire_us").isNull() | (F.col("s.expire_us") >= F.col("ts_us"))), F.lit(False))
    return both.where("is_read").select(*KEY, "seq", hit.alias("is_hit"))


def full_stats(state: DataFrame, read_hits: DataFrame, capacity: int) -> DataFrame:
    """One row: items, bytes, integer mean size, percentage of capacity used, hits, misses and hit percentage."""
    a = stats(state)
    b = read_hits.agg(F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses"))
    reads = F.col("hits") + F.col("misses")
    rate = F.when(reads > 0, F.col("hits") / reads * 100).otherwise(0.0)
    mean = F.when(F.col("items") > 0, F.expr("bytes div items")).otherwise(F.lit(0).cast("bigint"))
    return a.join(b).select("items", "bytes", mean.alias("avg_item_size"), F.round(F.col("bytes") / capacity * 100, 6).alias("usage_pct"), "hits", "misses", F.round(rate, 6).alias("hit_rate"))


def prometheus(one_row: DataFrame, prefix: str = "tessera") -> DataFrame:
    """The numbers of a one-row frame as lines of the text exposition format."""
    lines = [F.format_string(f"# TYPE {prefix}_{c} gauge\n{prefix}_{c} %s", F.col(c).cast("string")) for c in one_row.columns]
    return one_row.select(F.concat_ws("\n", *lines).alias("text"))
