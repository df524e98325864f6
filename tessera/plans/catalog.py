"""Named queries over the driver tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import bitmap, graph, kv, naming, oplog, policy, sketch, stream, vector, zset
from tessera.sources import derived
from tessera.sources.derived import AS_OF_US, HOUR_US

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAY_US = 24 * HOUR_US
#: Instants that range queries refer to: 2024-01-10 and 2024-01-12.
FROM_US, TO_US = AS_OF_US - 21 * DAY_US, AS_OF_US - 19 * DAY_US
#: An instant at which some values are about to expire.
LATE_US = AS_OF_US - 30 * HOUR_US

# The derivations of tessera.sources.derived in SQL.
EV = """ev AS (SELECT event_id AS seq, event_type AS stream, epoch_us(ts) AS ts_us, event_type AS type, user_id, value,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
LOG = f"""{EV}, log AS (SELECT 't' || (user_id % 4) AS tenant, seq, ts_us,
    CASE WHEN type IN ('purchase', 'signup') THEN 'SET' WHEN type = 'click' THEN 'INCR' ELSE 'DEL' END AS op, 'user:' || user_id AS key,
    CASE WHEN type IN ('purchase', 'signup') THEN CAST(CAST(round(value) AS BIGINT) AS VARCHAR) END AS value,
    CASE WHEN type = 'click' THEN k END AS delta, CASE WHEN type = 'signup' THEN {6 * HOUR_US} END AS ttl_us FROM ev WHERE type <> 'view'),
rd AS (SELECT 't' || (user_id % 4) AS tenant, seq, ts_us, 'user:' || user_id AS key FROM ev WHERE type = 'view')"""
STATE = f"""{LOG}, b AS (SELECT * FROM log WHERE op <> 'INCR' QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
i AS (SELECT l.key, any_value(l.tenant) AS tenant, CAST(sum(l.delta) AS BIGINT) AS inc, arg_min(l.ts_us, l.seq) AS first_us, arg_max(l.ts_us, l.seq) AS last_us, max(l.seq) AS last_seq
    FROM log l LEFT JOIN b USING (key) WHERE l.op = 'INCR' AND (b.seq IS NULL OR l.seq > b.seq) GROUP BY l.key),
st AS (SELECT coalesce(b.tenant, i.tenant) AS tenant, key, CASE WHEN i.inc IS NULL THEN b.value ELSE CAST(i.inc +
        CASE WHEN b.op = 'SET' AND (b.ttl_us IS NULL OR i.first_us <= b.ts_us + b.ttl_us) THEN CAST(b.value AS BIGINT) ELSE 0 END AS VARCHAR) END AS value,
    CASE WHEN i.inc IS NULL THEN b.ts_us + b.ttl_us END AS expire_us, CASE WHEN i.inc IS NULL THEN b.ts_us ELSE i.last_us END AS created_us,
    coalesce(i.last_seq, b.seq) AS write_seq FROM b FULL JOIN i USING (key) WHERE b.op = 'SET' OR i.inc IS NOT NULL),
state AS (SELECT *, CAST(strlen(value) AS BIGINT) AS size FROM st)"""
ENTRIES = f"""{STATE}, entries AS (SELECT s.tenant, s.key, s.value, s.size, s.expire_us, s.created_us, 2 + count(r.seq) AS accesses,
    greatest(s.created_us, coalesce(max(r.ts_us), s.created_us)) AS last_us FROM state s LEFT JOIN rd r ON r.key = s.key AND r.seq > s.write_seq AND (s.expire_us IS NULL OR s.expire_us >= r.ts_us)
    GROUP BY s.tenant, s.key, s.value, s.size, s.expire_us, s.created_us)"""
ZSET = f"""{EV}, z AS (SELECT type AS zkey, CAST(user_id AS VARCHAR) AS member, arg_max(round(value, 2), seq) AS score FROM ev GROUP BY 1, 2)"""
BITS = f"""{EV}, bl AS (SELECT type AS bkey, seq, user_id AS "offset", CAST(k % 2 AS INTEGER) AS bit FROM ev),
bits AS (SELECT bkey, "offset" FROM bl GROUP BY 1, 2 HAVING arg_max(bit, seq) = 1)"""
VEC = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"""
NATION = """nodes AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation),
sold AS (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, count(*) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
edges AS MATERIALIZED (SELECT src, dst, CAST(region AS VARCHAR) AS type, weight FROM (SELECT * FROM sold QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 3) JOIN nodes ON id = dst)"""
USERS = f"""{EV}, steps AS (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY type ORDER BY ts_us, seq) AS dst, type, seq FROM ev),
edges AS MATERIALIZED (SELECT src, dst, arg_min(type, seq) AS type, count(*) AS weight FROM steps WHERE dst IS NOT NULL AND dst <> src GROUP BY 1, 2),
nodes AS (SELECT DISTINCT user_id AS id FROM ev)"""


def hashed(key: str, salt: str) -> str:
    return f"CAST(concat('0x', substr(md5('{salt}' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT)"


def bit_rows(key: str, m: int, k: int) -> str:
    """SQL for the bit positions of a key as (i, bit)."""
    return f"unnest([{{'i': i, 'bit': ({hashed(key, 'a')} + i * ({hashed(key, 'b')} | 1)) % {m}}} for i in range(0, {k})])"


def query(name: str, sql: str | None = None):
    """Registers a query and, if SQL can express it, its counterpart."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


# --- event streams -------------------------------------------------------------------------------------------------------


def _window(agg: str):
    def run(spark, sf):
        return stream.tumbling(derived.events(spark, sf), HOUR_US, agg).withColumn("agg_value", F.round("agg_value", 4))

    return run


for _agg in stream.AGGREGATES:
    _count = "count(*)" if _agg == "count" else f"{_agg}(value)"
    query(f"stream_window_{_agg}", f"WITH {EV} SELECT stream, ts_us - ts_us % {HOUR_US} AS bucket_us, round(CAST({_count} AS DOUBLE), 4) AS agg_value FROM ev GROUP BY 1, 2")(_window(_agg))


@query("stream_range", f"WITH {EV} SELECT seq, stream, ts_us, round(value, 4) AS value FROM ev WHERE ts_us BETWEEN {FROM_US} AND {TO_US} AND value > 20")
def stream_range(spark, sf):
    return stream.time_range(derived.events(spark, sf), FROM_US, TO_US, F.col("value") > 20).select("seq", "stream", "ts_us", F.round("value", 4).alias("value"))


@query("stream_retention", f"WITH {EV} SELECT seq, stream, ts_us FROM ev WHERE ts_us >= {AS_OF_US - 2 * DAY_US}")
def stream_retention(spark, sf):
    return stream.retained(derived.events(spark, sf), AS_OF_US, 2 * DAY_US).select("seq", "stream", "ts_us")


@query("stream_append", f"WITH {EV} SELECT seq, stream, ts_us, type FROM ev WHERE seq % 10 <> 0 AND ts_us >= {AS_OF_US - 2 * DAY_US} UNION ALL SELECT seq, stream, CASE WHEN seq % 20 = 0 THEN {AS_OF_US} ELSE ts_us END, CASE WHEN seq % 30 = 0 THEN 'generic' ELSE type END FROM ev WHERE seq % 10 = 0")
def stream_append(spark, sf):
    e = derived.events(spark, sf)
    batch = e.where("seq % 10 = 0").withColumn("ts_us", F.when(F.col("seq") % 40 == 0, F.lit(None)).when(F.col("seq") % 20 == 0, 0).otherwise(F.col("ts_us"))).withColumn("type", F.when(F.col("seq") % 30 != 0, F.col("type")))
    return stream.append(e.where("seq % 10 <> 0"), batch, AS_OF_US, 2 * DAY_US).select("seq", "stream", "ts_us", "type")


@query(
    "stream_anomaly",
    f"""WITH {EV}, s AS (SELECT stream, avg(value) AS m, stddev_pop(value) AS d FROM ev GROUP BY 1 HAVING count(*) >= 10)
    SELECT seq, stream, round((value - m) / CASE WHEN d = 0 THEN 1e-9 ELSE d END, 6) AS z FROM ev JOIN s USING (stream) WHERE abs((value - m) / CASE WHEN d = 0 THEN 1e-9 ELSE d END) > 2.5""",
)
def stream_anomaly(spark, sf):
    return stream.anomalies(derived.events(spark, sf)).select("seq", "stream", F.round("z", 6).alias("z"))


@query(
    "stream_forecast",
    f"""WITH {EV}, f AS (SELECT stream, min(ts_us) AS a, arg_max(ts_us, seq) AS b FROM ev GROUP BY 1),
    l AS (SELECT stream, a, b, regr_slope(value, (ts_us - a) / 1e6) AS s, regr_intercept(value, (ts_us - a) / 1e6) AS c FROM ev JOIN f USING (stream) GROUP BY 1, 2, 3)
    SELECT stream, round(c + s * ((b + {HOUR_US} - a) / 1e6), 4) AS forecast FROM l""",
)
def stream_forecast(spark, sf):
    return stream.forecast(derived.events(spark, sf), HOUR_US).withColumn("forecast", F.round("forecast", 4))


@query(
    "stream_pattern",
    f"""WITH {EV}, a AS (SELECT * FROM ev WHERE type = 'view'), b AS (SELECT * FROM ev WHERE type = 'click'), c AS (SELECT * FROM ev WHERE type = 'purchase'),
    ab AS (SELECT a.user_id, a.seq AS s1, a.ts_us AS t1, min(b.ts_us) AS t2 FROM a JOIN b ON a.user_id = b.user_id AND b.ts_us > a.ts_us GROUP BY 1, 2, 3),
    abc AS (SELECT ab.user_id, s1, t1, t2, min(c.ts_us) AS t3 FROM ab JOIN c ON ab.user_id = c.user_id AND c.ts_us > ab.t2 GROUP BY 1, 2, 3, 4)
    SELECT user_id, t1 AS start_us, t3 AS end_us FROM abc WHERE t3 - t1 <= {2 * DAY_US}""",
)
def stream_pattern(spark, sf):
    return stream.sequences(derived.events(spark, sf), "user_id", ["view", "click", "purchase"], 2 * DAY_US).select("user_id", "start_us", "end_us")


@query("stream_read_group", f"WITH {EV} SELECT seq, stream, ts_us FROM ev WHERE stream = 'click' AND ts_us > {FROM_US} ORDER BY ts_us, seq LIMIT 10")
def stream_read_group(spark, sf):
    return oplog.read_after(derived.events(spark, sf).where("stream = 'click'"), FROM_US, 10).select("seq", "stream", "ts_us")


CDC = """cdc AS (SELECT seq, ts_us, CASE WHEN op = 'SET' THEN 'PUT' ELSE 'DEL' END AS type, CASE WHEN op = 'SET' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS value, key,
    CASE WHEN strlen(value) BETWEEN 1 AND 1023 THEN value END AS val FROM log WHERE op <> 'INCR')"""


@query("cdc_log", f"WITH {LOG}, {CDC} SELECT * FROM cdc")
def cdc_log(spark, sf):
    return oplog.changes(derived.oplog(spark, sf))


@query("cdc_switch", f"WITH {LOG}, {CDC} SELECT * FROM cdc WHERE seq BETWEEN 100 AND 499 OR seq >= 700")
def cdc_switch(spark, sf):
    switches = spark.createDataFrame([(100, True), (500, False), (600, False), (700, True)], "seq long, is_on boolean")
    return oplog.changes_while(derived.oplog(spark, sf), switches)


@query("group_offsets", f"WITH {EV}, o AS (SELECT stream, 'g' || (user_id % 3) AS \"group\", arg_max(ts_us, seq) AS offset_us FROM ev WHERE user_id % 5 = 1 AND stream <> 'view' GROUP BY 1, 2), a AS (SELECT stream, 'g' || x AS \"group\" FROM (SELECT DISTINCT stream FROM ev), range(0, 4) r(x)) SELECT stream, \"group\", coalesce(offset_us, 0) AS offset_us FROM a LEFT JOIN o USING (stream, \"group\")")
def group_offsets(spark, sf):
    e = derived.events(spark, sf)
    log = e.where("user_id % 5 = 1 and stream <> 'view'").select("stream", F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("group"), "seq", F.col("ts_us").alias("offset_us"))
    asked = e.select("stream").distinct().select("stream", F.explode(F.array(*[F.lit(f"g{k}") for k in range(4)])).alias("group"))
    return oplog.offset_of(oplog.offsets(log), asked)


@query("cdc_changes", f"WITH {LOG}, {CDC} SELECT * FROM cdc WHERE ts_us > {FROM_US} ORDER BY ts_us, seq LIMIT 100")
def cdc_changes(spark, sf):
    return oplog.read_after(oplog.changes(derived.oplog(spark, sf)), FROM_US, 100)


# --- op-log and key-value state ------------------------------------------------------------------------------------------


def _log_columns(df: DataFrame) -> DataFrame:
    return df.select("tenant", "seq", "ts_us", "op", "key", "value", "delta")


for _name, _cond, _f in (
    ("oplog_since", "seq > 9000", lambda log: oplog.since(log, 9000)),
    ("oplog_range", "seq BETWEEN 100 AND 900", lambda log: oplog.between(log, 100, 900)),
    ("oplog_trim", "seq >= (SELECT min(seq) FROM (SELECT seq FROM log ORDER BY seq DESC LIMIT 500))", lambda log: oplog.trim(log, 500)),
):
    query(_name, f"WITH {LOG} SELECT tenant, seq, ts_us, op, key, value, delta FROM log WHERE {_cond}")(lambda spark, sf, f=_f: _log_columns(f(derived.oplog(spark, sf))))


@query("oplog_head", f"WITH {LOG} SELECT coalesce(max(seq), 0) AS head, count(*) AS size FROM log")
def oplog_head(spark, sf):
    return oplog.head(derived.oplog(spark, sf))


def _state(spark, sf) -> DataFrame:
    return kv.fold(derived.oplog(spark, sf))


def _entries(spark, sf) -> DataFrame:
    return kv.entries(derived.oplog(spark, sf), derived.reads(spark, sf))


def _keys(spark) -> DataFrame:
    return spark.sql("SELECT concat('t', id % 4) AS tenant, concat('user:', id) AS key FROM range(0, 400, 7)")


KEYS = "keys AS (SELECT 't' || (x % 4) AS tenant, 'user:' || x AS key FROM range(0, 400, 7) r(x))"
STATE_COLUMNS = "tenant, key, value, size, expire_us, created_us"


@query("kv_fold", f"WITH {STATE} SELECT {STATE_COLUMNS} FROM state")
def kv_fold(spark, sf):
    return _state(spark, sf).select(*STATE_COLUMNS.split(", "))


@query("kv_replay", f"WITH {STATE.replace('FROM ev WHERE type <> ', 'FROM ev WHERE seq <= 5000 AND type <> ', 1)} SELECT {STATE_COLUMNS} FROM state")
def kv_replay(spark, sf):
    return kv.fold(derived.oplog(spark, sf).where("seq <= 5000")).select(*STATE_COLUMNS.split(", "))


@query("kv_snapshot", f"WITH {STATE} SELECT {STATE_COLUMNS} FROM state WHERE expire_us IS NULL OR expire_us >= {LATE_US}")
def kv_snapshot(spark, sf):
    return _state(spark, sf).where(kv.is_live(LATE_US)).select(*STATE_COLUMNS.split(", "))


@query("kv_get", f"WITH {STATE} SELECT key, value FROM state WHERE tenant = 't1' AND key = 'user:33' AND (expire_us IS NULL OR expire_us >= {LATE_US})")
def kv_get(spark, sf):
    return kv.get(_state(spark, sf), "t1", "user:33", LATE_US).select("key", "value")


@query("kv_mget", f"WITH {STATE}, {KEYS} SELECT tenant, key, value FROM state JOIN keys USING (tenant, key) WHERE expire_us IS NULL OR expire_us >= {LATE_US}")
def kv_mget(spark, sf):
    return kv.mget(_state(spark, sf), _keys(spark), LATE_US).select("tenant", "key", "value")


@query("kv_exists", f"WITH {STATE}, {KEYS} SELECT k.tenant, k.key, s.key IS NOT NULL AS is_there FROM keys k LEFT JOIN (SELECT * FROM state WHERE expire_us IS NULL OR expire_us >= {LATE_US}) s ON s.tenant = k.tenant AND s.key = k.key")
def kv_exists(spark, sf):
    return kv.exists(_state(spark, sf), _keys(spark), LATE_US)


@query("kv_incr", f"WITH {STATE} SELECT state.tenant, state.key, state.value FROM state JOIN i USING (key)")
def kv_incr(spark, sf):
    log = derived.oplog(spark, sf)
    counted = log.groupBy(kv.KEY).agg(F.max_by("op", "seq").alias("op")).where("op = 'INCR'")
    return kv.fold(log).join(counted, kv.KEY).select("tenant", "key", "value")


@query("kv_live", f"WITH {STATE} SELECT key, (expire_us IS NULL OR expire_us >= {LATE_US}) AS is_live FROM state")
def kv_live(spark, sf):
    return _state(spark, sf).select("key", kv.is_live(LATE_US).alias("is_live"))


@query("ttl_remaining", f"WITH {STATE} SELECT tenant, key, CASE WHEN expire_us IS NOT NULL THEN greatest(expire_us - {LATE_US}, 0) END AS ttl_us FROM state WHERE expire_us IS NULL OR expire_us >= {LATE_US}")
def ttl_remaining(spark, sf):
    state = _state(spark, sf)
    return kv.ttl_remaining(state, LATE_US).select("tenant", "key", "ttl_us")


@query("kv_sweep", f"WITH {STATE} SELECT tenant, key, expire_us FROM state WHERE expire_us < {LATE_US}")
def kv_sweep(spark, sf):
    return kv.sweep(_state(spark, sf), LATE_US).select("tenant", "key", "expire_us")


@query("kv_update_ttl", f"WITH {STATE} SELECT tenant, key, CASE WHEN (expire_us IS NULL OR expire_us >= {LATE_US}) AND CAST(substr(key, 6) AS BIGINT) % 7 = 0 THEN CASE WHEN CAST(substr(key, 6) AS BIGINT) % 2 = 0 THEN {LATE_US + HOUR_US} END ELSE expire_us END AS expire_us FROM state")
def kv_update_ttl(spark, sf):
    changes = _keys(spark).withColumn("ttl_us", F.when(F.substring("key", 6, 9).cast("bigint") % 2 == 0, HOUR_US).otherwise(0))
    everyone = spark.range(0, 200_000, 7).select(F.concat(F.lit("t"), (F.col("id") % 4).cast("string")).alias("tenant"), F.concat(F.lit("user:"), F.col("id").cast("string")).alias("key"), F.when(F.col("id") % 2 == 0, HOUR_US).otherwise(0).alias("ttl_us"))
    return kv.update_ttl(_state(spark, sf), changes.unionByName(everyone).distinct(), LATE_US).select("tenant", "key", "expire_us")


@query("kv_delete_if_expired", f"WITH {STATE}, {KEYS} SELECT k.tenant, k.key, s.key IS NOT NULL AS is_deleted, coalesce(s.size, 0) AS freed FROM keys k LEFT JOIN (SELECT * FROM state WHERE expire_us < {LATE_US}) s ON s.tenant = k.tenant AND s.key = k.key")
def kv_delete_if_expired(spark, sf):
    return kv.delete_if_expired(_state(spark, sf), _keys(spark), LATE_US)


@query(
    "kv_metadata",
    f"""WITH {ENTRIES} SELECT tenant, key, size, accesses, CAST(floor(({LATE_US} - created_us) / 1000) AS BIGINT) AS age_ms,
    CASE WHEN expire_us IS NOT NULL THEN CAST(greatest(floor((expire_us - {LATE_US}) / 1000), 0) AS BIGINT) END AS ttl_ms, last_us, created_us FROM entries""",
)
def kv_metadata(spark, sf):
    return kv.metadata(_entries(spark, sf), LATE_US)


@query(
    "kv_score",
    f"""WITH {ENTRIES} SELECT tenant, key, CASE WHEN {AS_OF_US} - created_us <= 0 THEN accesses ELSE CAST(trunc(accesses / (({AS_OF_US} - created_us) / 1e6) * 1000) AS BIGINT) END AS score,
    accesses AS lfu_score, -last_us AS lru_score, size AS size_score FROM entries""",
)
def kv_score(spark, sf):
    return kv.scores(_entries(spark, sf), AS_OF_US)


@query("kv_stats", f"WITH {STATE} SELECT count(*) AS items, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM state")
def kv_stats(spark, sf):
    return kv.stats(_state(spark, sf))


@query("tenant_stats", f"WITH {STATE} SELECT tenant, count(*) AS items, CAST(sum(size) AS BIGINT) AS bytes FROM state GROUP BY 1")
def tenant_stats(spark, sf):
    return kv.tenant_stats(_state(spark, sf))


@query(
    "kv_stats_full",
    f"""WITH {STATE}, h AS (SELECT r.seq, m.op IS NOT NULL AND m.op <> 'DEL' AND (m.op = 'INCR' OR m.ttl_us IS NULL OR m.ts_us + m.ttl_us >= r.ts_us) AS is_hit
        FROM rd r ASOF LEFT JOIN log m ON r.key = m.key AND r.seq >= m.seq),
    c AS (SELECT count(*) FILTER (is_hit) AS hits, count(*) FILTER (NOT is_hit) AS misses FROM h), a AS (SELECT count(*) AS items, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM state)
    SELECT items, bytes, CASE WHEN items > 0 THEN bytes // items ELSE 0 END AS avg_item_size, round(bytes / 1000 * 100, 6) AS usage_pct, hits, misses,
    round(CASE WHEN hits + misses > 0 THEN hits / (hits + misses) * 100 ELSE 0 END, 6) AS hit_rate FROM a, c""",
)
def kv_stats_full(spark, sf):
    log = derived.oplog(spark, sf)
    return kv.full_stats(kv.fold(log), kv.hits(log, derived.reads(spark, sf)), 1000)


@query("list_objects", f"WITH {LOG} SELECT DISTINCT tenant AS name, 'tenant' AS kind FROM log UNION ALL SELECT DISTINCT stream, 'stream' FROM ev")
def list_objects(spark, sf):
    tenants = derived.oplog(spark, sf).select(F.col("tenant").alias("name")).distinct().withColumn("kind", F.lit("tenant"))
    return tenants.union(derived.events(spark, sf).select("stream").distinct().withColumn("kind", F.lit("stream")))


# --- sorted sets and bitmaps ---------------------------------------------------------------------------------------------


def _zset(spark, sf) -> DataFrame:
    return zset.fold(derived.zset_log(spark, sf))


@query("zset_fold", f"WITH {ZSET} SELECT * FROM z")
def zset_fold(spark, sf):
    return _zset(spark, sf)


@query("zrem", f"WITH {ZSET} SELECT * FROM z WHERE NOT (zkey = 'click' AND CAST(member AS BIGINT) % 3 = 0)")
def zrem(spark, sf):
    gone = derived.zset_log(spark, sf).where("zkey = 'click' and cast(member as bigint) % 3 = 0").select("zkey", "member").distinct()
    return zset.remove(_zset(spark, sf), gone)


@query("zscore", f"WITH {ZSET} SELECT zkey, member, printf('%.6f', score) AS score FROM z WHERE zkey = 'view' AND member = '7'")
def zscore(spark, sf):
    return zset.score(_zset(spark, sf), "view", "7").withColumn("score", F.format_string("%.6f", "score"))


@query("zrank", f"WITH {ZSET}, r AS (SELECT member, row_number() OVER (ORDER BY score, member) - 1 AS rank FROM z WHERE zkey = 'view'), a AS (SELECT CAST(x AS VARCHAR) AS member FROM range(0, 200000, 13) t(x)) SELECT member, CAST(coalesce(rank, -1) AS BIGINT) AS rank FROM a LEFT JOIN r USING (member) WHERE CAST(member AS BIGINT) < 600")
def zrank(spark, sf):
    return zset.rank_of(_zset(spark, sf), "view", spark.range(0, 600, 13).select(F.col("id").cast("string").alias("member")))


for _name, _a, _b, _cond in (("zrange", 10, 20, "rank BETWEEN 10 AND 20"), ("zrange_neg", -5, -2, "rank BETWEEN n - 5 AND n - 2")):
    query(_name, f"WITH {ZSET}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY zkey ORDER BY score, member) - 1 AS INTEGER) AS rank, count(*) OVER (PARTITION BY zkey) AS n FROM z) SELECT zkey, member, score, rank FROM r WHERE {_cond}")(
        lambda spark, sf, a=_a, b=_b: zset.by_position(_zset(spark, sf), a, b)
    )


@query("zcard", f"WITH {ZSET} SELECT zkey, count(*) AS card FROM z GROUP BY 1")
def zcard(spark, sf):
    return zset.card(_zset(spark, sf))


def _bits(spark, sf) -> DataFrame:
    return bitmap.fold(derived.bit_log(spark, sf))


@query("bit_set_prev", f'WITH {BITS} SELECT bkey, seq, "offset", bit, lag(bit, 1, 0) OVER (PARTITION BY bkey, "offset" ORDER BY seq) AS previous FROM bl')
def bit_set_prev(spark, sf):
    return bitmap.previous(derived.bit_log(spark, sf))


@query("bit_get", f"""WITH {BITS}, a AS (SELECT 'click' AS bkey, x AS "offset" FROM range(0, 300, 3) r(x)) SELECT a.bkey, a."offset", CASE WHEN b.bkey IS NULL THEN 0 ELSE 1 END AS bit FROM a LEFT JOIN bits b ON a.bkey = b.bkey AND a."offset" = b."offset" """)
def bit_get(spark, sf):
    return bitmap.get(_bits(spark, sf), spark.range(0, 300, 3).select(F.lit("click").alias("bkey"), F.col("id").alias("offset")))


@query("bit_count", f"WITH {BITS} SELECT bkey, count(*) AS n FROM bits GROUP BY 1")
def bit_count(spark, sf):
    return bitmap.count(_bits(spark, sf))


@query("bit_count_range", f'WITH {BITS} SELECT bkey, count(*) AS n FROM bits WHERE "offset" BETWEEN 20 AND 90 GROUP BY 1')
def bit_count_range(spark, sf):
    return bitmap.count(_bits(spark, sf), 20, 90)


PACKED = f"""{BITS}, pb AS (SELECT bkey, CAST("offset" // 32768 + 1 AS BIGINT) AS bucket, ("offset" % 32768) // 8 AS i, sum(1 << CAST("offset" % 8 AS INTEGER)) AS byte, count(*) AS n FROM bits GROUP BY 1, 2, 3),
    bk AS (SELECT bkey, bucket, CAST(sum(n) AS BIGINT) AS n FROM pb GROUP BY 1, 2)"""


@query("bitmap_packed", f"WITH {PACKED} SELECT bk.bkey, bk.bucket, bk.n, string_agg(printf('%02X', CAST(coalesce(pb.byte, 0) AS INTEGER)), '' ORDER BY x) AS bitmap FROM bk CROSS JOIN range(0, 4096) r(x) LEFT JOIN pb ON pb.bkey = bk.bkey AND pb.bucket = bk.bucket AND pb.i = x GROUP BY 1, 2, 3")
def bitmap_packed(spark, sf):
    return bitmap.packed(_bits(spark, sf)).select("bkey", "bucket", "n", F.hex("bitmap").alias("bitmap"))


@query("bitmap_drop", f'WITH {BITS} SELECT bkey, "offset" FROM bits WHERE bkey NOT IN (\'click\', \'error\')')
def bitmap_drop(spark, sf):
    return bitmap.drop(_bits(spark, sf), spark.sql("SELECT explode(array('click', 'error', 'none')) AS bkey"))


# --- vectors -------------------------------------------------------------------------------------------------------------

COSINE = "1 - list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q)))"
DISTANCES = {"cosine": COSINE, "euclidean": "list_distance(v, q)", "dot": "-list_inner_product(v, q)", "manhattan": "list_sum([abs(v[i] - q[i]) for i in range(1, len(v) + 1)])"}
ASK = f"{VEC}, q AS (SELECT v AS q FROM v WHERE id = 0)"


def _query_vector(spark, sf) -> DataFrame:
    return derived.vectors(spark, sf).where("id = 0").select(F.col("v").alias("q"))


for _metric, _sql in DISTANCES.items():
    query(f"vector_knn_{_metric}", f"WITH {ASK} SELECT id, round({_sql}, 6) + 0 AS distance FROM v, q ORDER BY distance, id LIMIT 10")(
        lambda spark, sf, m=_metric: vector.nearest(derived.vectors(spark, sf), _query_vector(spark, sf), 10, m).select("id", (F.col("distance") + 0).alias("distance"))
    )


@query("vector_knn_batch", f"WITH {VEC}, q AS (SELECT id AS qid, v AS q FROM v WHERE id < 10), d AS (SELECT qid, id, round({COSINE}, 6) + 0 AS distance FROM v, q) SELECT qid, id, distance, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS rank FROM d QUALIFY rank <= 5")
def vector_knn_batch(spark, sf):
    v = derived.vectors(spark, sf)
    found = vector.nearest_of_each(v, v.where("id < 10").select(F.col("id").alias("qid"), F.col("v").alias("q")), 5)
    return found.select("qid", "id", (F.col("distance") + 0).alias("distance"), "rank")


@query("vector_search_meta", f"WITH {ASK}, t AS (SELECT id, round({COSINE}, 6) + 0 AS distance FROM v, q ORDER BY distance, id LIMIT 10) SELECT t.id, distance, label FROM t LEFT JOIN (SELECT vec_id, label FROM embeddings WHERE label < 6) m ON m.vec_id = t.id")
def vector_search_meta(spark, sf):
    v = derived.vectors(spark, sf)
    hits = vector.nearest(v.drop("label"), _query_vector(spark, sf), 10)
    return hits.join(v.where("label < 6").select("id", "label"), "id", "left").select("id", (F.col("distance") + 0).alias("distance"), "label")


def _labels(spark, sf) -> DataFrame:
    """Values by vector id; every seventh has expired."""
    return derived.vectors(spark, sf).select(F.col("id").alias("key"), F.col("label").cast("string").alias("value"), F.when(F.col("id") % 7 == 0, AS_OF_US - 1).alias("expire_us"))


@query("semantic_search", f"WITH {ASK}, t AS (SELECT id, label, round({COSINE}, 6) + 0 AS distance FROM v, q ORDER BY distance, id LIMIT 10) SELECT id, distance, CAST(label AS VARCHAR) AS value FROM t WHERE id % 7 <> 0")
def semantic_search(spark, sf):
    hits = vector.nearest(derived.vectors(spark, sf).drop("label"), _query_vector(spark, sf), 10)
    return vector.with_values(hits, _labels(spark, sf), AS_OF_US).select("id", (F.col("distance") + 0).alias("distance"), "value")


@query("semantic_get", f"WITH {VEC}, q AS (SELECT v AS q FROM v WHERE id = 5), t AS (SELECT id, label, round({COSINE}, 6) AS distance FROM v, q ORDER BY distance, id LIMIT 1) SELECT id, CAST(label AS VARCHAR) AS value FROM t WHERE distance <= 1 - 0.8 AND id % 7 <> 0")
def semantic_get(spark, sf):
    v = derived.vectors(spark, sf)
    return vector.best_match(v.drop("label"), v.where("id = 5").select(F.col("v").alias("q")), _labels(spark, sf), 0.8, AS_OF_US).select("id", "value")


@query("vector_normalize", f"WITH {VEC}, u AS (SELECT id, [3 * x for x in v] AS u FROM v), c AS (SELECT id, sqrt(list_inner_product(u, u)) AS n, unnest(u) AS x, generate_subscripts(u, 1) - 1 AS i FROM u) SELECT id, CAST(i AS INTEGER) AS i, round(x / n, 6) AS x FROM c")
def vector_normalize(spark, sf):
    v = derived.vectors(spark, sf).select("id", vector.normalized(F.transform("v", lambda x: x * 3)).alias("v"))
    return v.select("id", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("vector_dedup_first", f"WITH {VEC}, f AS (SELECT id % 100 AS id, min(id) AS seq, arg_min(v, id) AS v FROM v GROUP BY 1), c AS (SELECT id, seq, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM f) SELECT id, seq, CAST(i AS INTEGER) AS i, round(x, 6) AS x FROM c")
def vector_dedup_first(spark, sf):
    log = derived.vectors(spark, sf).select((F.col("id") % 100).alias("id"), F.col("id").alias("seq"), "v")
    return vector.first_of_each(log).select("id", "seq", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 6))


def _index_log(spark, sf) -> DataFrame:
    """Indexes named after regions; one takes vectors of half the size, one is made twice, one dropped and made again."""
    r = derived.table(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("k"))
    half = F.when(F.col("k") == 3, 32).otherwise(64)
    kind = F.element_at(F.array(*[F.lit(x) for x in METRIC_NAMES]), (F.col("k") + 1).cast("int"))
    name = F.concat(F.lit("r"), F.col("k").cast("string")).alias("name")
    made = r.select(name, (F.col("k") * 10 - 100).alias("seq"), F.lit("CREATE").alias("op"), half.alias("dimension"), kind.alias("metric"))
    again = r.where("k in (1, 2)").select(name, F.when(F.col("k") == 1, 300).otherwise(20).cast("bigint"), F.lit("CREATE"), F.lit(64), F.lit("dot"))
    return made.union(again).union(r.where("k in (1, 4)").select(name, (F.col("k") * 50 + 150).cast("bigint"), F.lit("DROP"), F.lit(None).cast("int"), F.lit(None).cast("string")))


def _index_writes(spark, sf) -> DataFrame:
    """Every vector inserted into one of six indexes, of which one never was; every fiftieth a delete of its id."""
    op = F.when(F.col("id") % 50 == 0, "DELETE").otherwise("INSERT")
    return derived.vectors(spark, sf).select(F.concat(F.lit("r"), (F.col("id") % 6).cast("string")).alias("name"), (F.col("id") % 90).alias("id"), F.col("id").alias("seq"), op.alias("op"), "v")


METRIC_NAMES = ["cosine", "euclidean", "dot", "manhattan", "no such"]
INDEXES = f"""{VEC}, rk AS (SELECT CAST(r_regionkey AS BIGINT) AS k FROM region), il AS (SELECT 'r' || k AS name, k * 10 - 100 AS seq, 'CREATE' AS op, CASE WHEN k = 3 THEN 32 ELSE 64 END AS dimension, ({METRIC_NAMES!r})[k + 1] AS metric FROM rk
    UNION ALL SELECT 'r' || k, CASE WHEN k = 1 THEN 300 ELSE 20 END, 'CREATE', 64, 'dot' FROM rk WHERE k IN (1, 2) UNION ALL SELECT 'r' || k, k * 50 + 150, 'DROP', NULL, NULL FROM rk WHERE k IN (1, 4)),
    ix AS (SELECT name, min(seq) AS seq, arg_min(dimension, seq) AS dimension, CASE arg_min(metric, seq) WHEN 'no such' THEN 'cosine' ELSE arg_min(metric, seq) END AS metric FROM il c
        WHERE op = 'CREATE' AND NOT EXISTS (SELECT 1 FROM il d WHERE d.name = c.name AND d.op = 'DROP' AND d.seq > c.seq) GROUP BY 1),
    wr AS (SELECT 'r' || (id % 6) AS name, id % 90 AS id, id AS seq, CASE WHEN id % 50 = 0 THEN 'DELETE' ELSE 'INSERT' END AS op, v FROM v)"""


@query("vector_indexes", f"WITH {INDEXES} SELECT name, seq, dimension, metric FROM ix")
def vector_indexes(spark, sf):
    return vector.indexes(_index_log(spark, sf))


@query("vector_index_entries", f"WITH {INDEXES}, a AS (SELECT w.* FROM wr w JOIN ix ON ix.name = w.name AND w.seq > ix.seq AND w.op = 'INSERT' AND len(w.v) = ix.dimension AND NOT EXISTS (SELECT 1 FROM wr d WHERE d.name = w.name AND d.id = w.id AND d.op = 'DELETE' AND d.seq > w.seq)), f AS (SELECT name, id, min(seq) AS seq, arg_min(v, seq) AS v FROM a GROUP BY 1, 2) SELECT name, id, seq, round(list_sum(v), 6) AS total, round(v[1], 6) AS x0, round(v[64], 6) AS x63 FROM f")
def vector_index_entries(spark, sf):
    found = vector.index_entries(vector.indexes(_index_log(spark, sf)), _index_writes(spark, sf))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return found.select("name", "id", "seq", F.round(total, 6).alias("total"), F.round(F.col("v")[0], 6).alias("x0"), F.round(F.col("v")[63], 6).alias("x63"))


@query("vector_index_refusals", f"""WITH {INDEXES}, j AS (SELECT w.name, w.id, w.seq, w.op, CASE WHEN ix.name IS NULL THEN 'no index' WHEN w.op = 'INSERT' AND len(w.v) <> ix.dimension THEN 'dimension' END AS reason FROM wr w LEFT JOIN ix ON ix.name = w.name WHERE ix.name IS NULL OR w.seq > ix.seq),
    k AS (SELECT *, CASE WHEN op = 'INSERT' AND reason IS NULL THEN row_number() OVER (PARTITION BY op = 'INSERT' AND reason IS NULL ORDER BY seq) END AS nth FROM j)
    SELECT name, id, seq, CASE WHEN nth > 200 THEN 'full' ELSE reason END AS reason FROM k WHERE nth > 200 OR reason IS NOT NULL""")
def vector_index_refusals(spark, sf):
    return vector.index_refusals(vector.indexes(_index_log(spark, sf)), _index_writes(spark, sf), 200)


@query("put_embedding", f"WITH {VEC}, p AS (SELECT 'k' || (id % 70) AS key, id AS seq, 'v' || id AS value, CASE WHEN id % 3 = 1 THEN v[1:32] ELSE v END AS v FROM v), f AS (SELECT key, min(seq) AS seq, arg_min(v, seq) AS v FROM p WHERE len(v) = 64 GROUP BY 1) SELECT l.key, l.value, round(list_sum(f.v), 6) AS total FROM (SELECT key, arg_max(value, seq) AS value FROM p GROUP BY 1) l LEFT JOIN f USING (key)")
def put_embedding(spark, sf):
    v = derived.vectors(spark, sf)
    puts = v.select(F.concat(F.lit("k"), (F.col("id") % 70).cast("string")).alias("key"), F.col("id").alias("seq"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"), F.when(F.col("id") % 3 == 1, F.slice("v", 1, 32)).otherwise(F.col("v")).alias("v"))
    return vector.put_with_embeddings(puts).select("key", "value", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("vector_index_stats", f"WITH {VEC} SELECT count(*) AS size, CAST(max(len(v)) AS BIGINT) AS dimension, count(DISTINCT label) AS labels FROM v")
def vector_index_stats(spark, sf):
    return vector.index_stats(derived.vectors(spark, sf))


# --- graphs --------------------------------------------------------------------------------------------------------------


@query("graph_stats", f"WITH {NATION} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def graph_stats(spark, sf):
    return graph.stats(*derived.nation_graph(spark, sf))


@query("graph_valid_edges", f"WITH {NATION} SELECT src, dst, weight FROM edges WHERE src % 3 <> 0 AND dst % 3 <> 0")
def graph_valid_edges(spark, sf):
    nodes, edges = derived.nation_graph(spark, sf)
    return graph.valid_edges(edges, nodes.where("id % 3 <> 0")).select("src", "dst", "weight")


def _both(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges in one table; a node is an edge without an end."""
    return edges.select("src", "dst", "weight").union(nodes.select("id", F.lit(None).cast("bigint"), F.lit(None).cast("bigint")))


@query("graph_delete_node", f"WITH {NATION} SELECT src, dst, weight FROM edges WHERE src NOT IN (2, 5) AND dst NOT IN (2, 5) UNION ALL SELECT id, NULL, NULL FROM nodes WHERE id NOT IN (2, 5)")
def graph_delete_node(spark, sf):
    nodes, edges = derived.nation_graph(spark, sf)
    return _both(*graph.delete_nodes(nodes, edges, spark.sql("SELECT explode(array(2L, 5L)) AS id")))


@query("graph_subgraph", f"WITH {NATION} SELECT src, dst, weight FROM edges WHERE src < 12 AND dst < 12 UNION ALL SELECT id, NULL, NULL FROM nodes WHERE id < 12")
def graph_subgraph(spark, sf):
    nodes, edges = derived.nation_graph(spark, sf)
    return _both(*graph.subgraph(nodes, edges, nodes.where("id < 12").select("id")))


GRAPHS = f"{EV}, gl AS (SELECT 'g' || user_id AS name, seq, CASE WHEN type = 'error' THEN 'DROP' ELSE 'CREATE' END AS op FROM ev)"


def _graph_log(spark, sf) -> DataFrame:
    """Every event makes its user's graph, errors drop it."""
    return derived.events(spark, sf).select(F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("name"), "seq", F.when(F.col("type") == "error", "DROP").otherwise("CREATE").alias("op"))


@query("graph_catalog", f"WITH {GRAPHS} SELECT name, min(seq) AS seq FROM gl c WHERE op = 'CREATE' AND seq > coalesce((SELECT max(seq) FROM gl d WHERE d.name = c.name AND op = 'DROP'), -1) GROUP BY 1")
def graph_catalog(spark, sf):
    return graph.graphs(_graph_log(spark, sf))


@query("graph_catalog_refused", f"WITH {GRAPHS} SELECT name, seq FROM (SELECT *, lag(op) OVER (PARTITION BY name ORDER BY seq) AS was FROM gl) WHERE op = 'CREATE' AND was = 'CREATE'")
def graph_catalog_refused(spark, sf):
    return naming.refused(_graph_log(spark, sf)).select("name", "seq")


@query("graph_add_node", f"WITH {EV} SELECT user_id AS id, CASE WHEN arg_max(type, seq) <> 'error' THEN arg_max(type, seq) END AS last_type, CASE WHEN arg_max(type, seq) <> 'error' THEN 1 ELSE 0 END AS n_props FROM ev GROUP BY 1")
def graph_add_node(spark, sf):
    log = derived.events(spark, sf).select(F.col("user_id").alias("id"), "seq", F.when(F.col("type") != "error", F.create_map(F.lit("last_type"), F.col("type"))).alias("props"))
    return graph.add_nodes(log).select("id", F.try_element_at("props", F.lit("last_type")).alias("last_type"), F.size("props").alias("n_props"))


@query("graph_get_node", f"WITH {NATION}, a AS (SELECT x AS id FROM range(0, 60, 4) r(x)) SELECT a.id, name, nodes.id IS NOT NULL AS is_there FROM a LEFT JOIN nodes USING (id)")
def graph_get_node(spark, sf):
    return graph.get_nodes(derived.nation_graph(spark, sf)[0], spark.range(0, 60, 4)).select("id", "name", "is_there")


@query("graph_get_edge", f"WITH {NATION}, a AS (SELECT x AS src, (x * 7) % 25 AS dst FROM range(0, 30) r(x)) SELECT a.src, a.dst, weight, edges.src IS NOT NULL AS is_there FROM a LEFT JOIN edges ON edges.src = a.src AND edges.dst = a.dst")
def graph_get_edge(spark, sf):
    asked = spark.range(30).select(F.col("id").alias("src"), ((F.col("id") * 7) % 25).alias("dst"))
    return graph.get_edges(derived.nation_graph(spark, sf)[1], asked).select("src", "dst", "weight", "is_there")


@query("graph_update_node", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CASE WHEN n_nationkey < 10 THEN 'new' ELSE CAST(n_regionkey AS VARCHAR) END AS region, CASE WHEN n_nationkey < 10 THEN 'yes' END AS tag FROM nation")
def graph_update_node(spark, sf):
    nodes = derived.nation_graph(spark, sf)[0].select("id", F.create_map(F.lit("name"), "name", F.lit("region"), F.col("region").cast("string")).alias("props"))
    changes = nodes.where("id < 10").select("id", F.create_map(F.lit("region"), F.lit("new"), F.lit("tag"), F.lit("yes")).alias("props"))
    found = graph.update_nodes(nodes, changes)
    return found.select("id", *[F.try_element_at("props", F.lit(c)).alias(c) for c in ("name", "region", "tag")])


@query("graph_neighbors", f"WITH RECURSIVE {NATION}, walk AS (SELECT CAST(0 AS BIGINT) AS id, 0 AS d UNION SELECT e.dst, d + 1 FROM walk JOIN edges e ON e.src = walk.id WHERE d < 3) SELECT id, CAST(min(d) AS INTEGER) AS steps FROM walk WHERE id <> 0 GROUP BY 1")
def graph_neighbors(spark, sf):
    return graph.neighbours(derived.nation_graph(spark, sf)[1], 0, 3)


def _paths_sql(rounds: int) -> str:
    """Costs relaxed as often as a way can have edges, then the ways back over the smallest node of those that are tight."""
    out = f"WITH RECURSIVE {NATION}, c0 AS MATERIALIZED (SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS DOUBLE) AS cost)"
    for k in range(rounds):
        out += f", c{k + 1} AS MATERIALIZED (SELECT id, min(cost) AS cost FROM (SELECT * FROM c{k} UNION ALL SELECT e.dst, c.cost + e.weight FROM c{k} c JOIN edges e ON e.src = c.id) GROUP BY 1)"
    return out + f""", before AS MATERIALIZED (SELECT t.id, min(e.src) AS b FROM c{rounds} t JOIN edges e ON e.dst = t.id JOIN c{rounds} s ON s.id = e.src WHERE t.id <> 0 AND s.cost + e.weight = t.cost GROUP BY 1),
    walk AS (SELECT id, id AS at, CAST(id AS VARCHAR) AS path FROM c{rounds} UNION ALL SELECT w.id, b.b, b.b || '>' || w.path FROM walk w JOIN before b ON b.id = w.at)
    SELECT walk.id, cost, path FROM walk JOIN c{rounds} ON c{rounds}.id = walk.id WHERE walk.at = 0"""


@query("graph_shortest_path", _paths_sql(25))
def graph_shortest_path(spark, sf):
    found = graph.shortest_paths(derived.nation_graph(spark, sf)[1], 0)
    return found.select("id", "cost", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def _pagerank_sql(rounds: int) -> str:
    out = f"WITH {USERS}, deg AS MATERIALIZED (SELECT src, count(*) AS n FROM edges GROUP BY 1), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"
    for k in range(rounds):
        out += f", r{k + 1} AS MATERIALIZED (SELECT nodes.id, 0.15::DOUBLE / (SELECT count(*) FROM nodes) + 0.85 * coalesce(g, 0) AS rank FROM nodes LEFT JOIN (SELECT dst, sum(r.rank / deg.n) AS g FROM edges JOIN deg USING (src) JOIN r{k} r ON r.id = edges.src GROUP BY 1) x ON x.dst = nodes.id)"
    return out + f" SELECT id, round(rank, 8) AS rank FROM r{rounds}"


@query("graph_pagerank", _pagerank_sql(20))
def graph_pagerank(spark, sf):
    return graph.pagerank(*derived.user_graph(spark, sf)).withColumn("rank", F.round("rank", 8))


def _community_sql(rounds: int, greedy: bool) -> str:
    out = f"WITH {NATION}, l0 AS MATERIALIZED (SELECT id, id AS label FROM nodes)"
    for k in range(rounds):
        keep = "WHERE label <> own" if greedy else ""
        go = "b.w > coalesce(m.w, 0)" if greedy else "true"
        out += f""", v{k} AS MATERIALIZED (SELECT e.src AS id, l.label, sum(e.weight) AS w, any_value(o.label) AS own FROM edges e JOIN l{k} l ON l.id = e.dst JOIN l{k} o ON o.id = e.src GROUP BY 1, 2 HAVING sum(e.weight) > 0),
        b{k} AS MATERIALIZED (SELECT * FROM v{k} {keep} QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1),
        l{k + 1} AS MATERIALIZED (SELECT l.id, CASE WHEN b.id IS NOT NULL AND {go} THEN b.label ELSE l.label END AS label FROM l{k} l LEFT JOIN b{k} b ON b.id = l.id LEFT JOIN (SELECT id, w FROM v{k} WHERE label = own) m ON m.id = l.id)"""
    return out + f" SELECT id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS community FROM l{rounds}"


@query("graph_label_propagation", _community_sql(50, False))
def graph_label_propagation(spark, sf):
    return graph.communities(*derived.nation_graph(spark, sf))


@query("graph_louvain_greedy", _community_sql(50, True))
def graph_louvain_greedy(spark, sf):
    return graph.communities(*derived.nation_graph(spark, sf), strict_gain=True, other_only=True)


# --- sketches ------------------------------------------------------------------------------------------------------------

M, K = sketch.bloom_size(1000, 0.01)
W, D = 256, 4


def _users(spark, sf, cond: str = "true") -> DataFrame:
    return derived.events(spark, sf).where(cond).select("user_id").distinct()


def _bloom(cond: str) -> str:
    return f"(SELECT DISTINCT x.bit AS bit FROM (SELECT {bit_rows('user_id', M, K)} AS x FROM (SELECT DISTINCT user_id FROM ev WHERE {cond})))"


@query("bloom_sizing", f"WITH {EV}, c AS (SELECT type, CAST(count(DISTINCT user_id) AS DOUBLE) AS n FROM ev GROUP BY 1), m AS (SELECT type, p, n, CAST(ceil(-n * ln(p) / (ln(2) * ln(2))) AS BIGINT) AS m FROM c, (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.2 AS DOUBLE))) t(p)) SELECT type, p, m, CAST(ceil(m / n * ln(2)) AS BIGINT) AS k FROM m")
def bloom_sizing(spark, sf):
    n = derived.events(spark, sf).groupBy("type").agg(F.count_distinct("user_id").cast("double").alias("n"))
    each = n.select("type", "n", F.explode(F.array(F.lit(0.01), F.lit(0.2))).alias("p"))
    m, k = sketch.bloom_sizes(F.col("n"), F.col("p"))
    return each.select("type", "p", m.alias("m"), k.alias("k"))


@query("bloom_build", f"WITH {EV} SELECT bit FROM {_bloom('user_id % 2 = 0')}")
def bloom_build(spark, sf):
    return sketch.bloom_build(_users(spark, sf, "user_id % 2 = 0"), "user_id", M, K)


PROBE = f"p AS (SELECT user_id, min(CASE WHEN b.bit IS NULL THEN 0 ELSE 1 END) AS ok FROM (SELECT user_id, {bit_rows('user_id', M, K)} AS x FROM (SELECT DISTINCT user_id FROM ev)) LEFT JOIN bl b ON b.bit = x.bit GROUP BY 1)"


@query("bloom_probe", f"WITH {EV}, bl AS {_bloom('user_id % 2 = 0')}, {PROBE} SELECT user_id, ok = 1 AS may_contain FROM p")
def bloom_probe(spark, sf):
    return sketch.bloom_probe(_users(spark, sf), "user_id", bloom_build(spark, sf), M, K)


@query("bloom_semijoin", f"WITH {EV}, bl AS {_bloom('user_id % 2 = 0')}, {PROBE} SELECT type, count(*) AS n FROM ev JOIN p USING (user_id) WHERE ok = 1 AND user_id % 2 = 0 GROUP BY 1")
def bloom_semijoin(spark, sf):
    e = derived.events(spark, sf)
    may = bloom_probe(spark, sf).where("may_contain").select("user_id")
    return e.join(may, "user_id", "left_semi").where("user_id % 2 = 0").groupBy("type").agg(F.count("*").alias("n"))


@query("bloom_merge", f"WITH {EV} SELECT bit FROM {_bloom('user_id % 2 = 0')} UNION SELECT bit FROM {_bloom('user_id % 3 = 0')}")
def bloom_merge(spark, sf):
    return sketch.bloom_union(bloom_build(spark, sf), sketch.bloom_build(_users(spark, sf, "user_id % 3 = 0"), "user_id", M, K))


@query("bloom_intersect", f"WITH {EV} SELECT bit FROM {_bloom('user_id % 2 = 0')} INTERSECT SELECT bit FROM {_bloom('user_id % 3 = 0')}")
def bloom_intersect(spark, sf):
    return sketch.bloom_intersection(bloom_build(spark, sf), sketch.bloom_build(_users(spark, sf, "user_id % 3 = 0"), "user_id", M, K))


@query("bloom_export", f"WITH {EV}, w AS (SELECT bit // 64 AS word, sum(CAST(1 AS HUGEINT) << CAST(bit % 64 AS INTEGER)) AS v FROM {_bloom('user_id % 2 = 0')} GROUP BY 1) SELECT CAST(word AS BIGINT) AS word, CAST(CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END AS BIGINT) AS value FROM w")
def bloom_export(spark, sf):
    return sketch.bloom_export(bloom_build(spark, sf))


@query("bloom_import", f"WITH {EV} SELECT bit FROM {_bloom('user_id % 2 = 0')}")
def bloom_import(spark, sf):
    return sketch.bloom_import(bloom_export(spark, sf), M)


@query("bloom_stats", f"WITH {EV} SELECT count(*) AS bits, round(count(*) / {M}, 9) AS fill, round(pow(count(*) / {M}, {K}), 9) AS fpr FROM {_bloom('user_id % 2 = 0')}")
def bloom_stats(spark, sf):
    return sketch.bloom_stats(bloom_build(spark, sf), M, K)


CMS = f"""each AS (SELECT user_id, x.i AS d, x.bit AS bucket, n FROM (SELECT user_id, count(*) AS n, {bit_rows('user_id', W, D)} AS x FROM ev GROUP BY user_id)),
cms AS (SELECT d, bucket, sum(n) AS n FROM each GROUP BY 1, 2), est AS (SELECT user_id, CAST(min(cms.n) AS BIGINT) AS estimate FROM each JOIN cms USING (d, bucket) GROUP BY 1)"""


@query("cms_estimate", f"WITH {EV}, {CMS} SELECT user_id, estimate FROM est")
def cms_estimate(spark, sf):
    counters = sketch.cms_build(derived.events(spark, sf), "user_id", W, D)
    return sketch.cms_estimate(_users(spark, sf), "user_id", counters, W, D)


# --- policies, metrics and scalar functions ------------------------------------------------------------------------------


def _victims_sql(order: str, need: int, most: int | None = None) -> str:
    limit = "" if most is None else f" AND place <= {most}"
    return f"WITH {ENTRIES}, r AS (SELECT key, size, CAST(sum(size) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS freed, row_number() OVER (ORDER BY {order}) AS place FROM entries) SELECT key, size, freed, place FROM r WHERE freed - size < {need}{limit}"


for _name, _order, _f, _need, _most in (("evict_lru", "last_us, key", policy.lru, 60, 100), ("evict_overwrite", "last_us, key", policy.lru, 90, None), ("evict_lfu", "accesses, key", policy.lfu, 40, 1000)):
    query(_name, _victims_sql(_order, _need, _most))(lambda spark, sf, f=_f, need=_need, most=_most: f(_entries(spark, sf), need, most).select("key", "size", "freed", "place"))


EMERGENCY = f"""{ENTRIES}, ea AS (SELECT tenant, key, size, CAST(sum(size) OVER (ORDER BY accesses, key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS freed, row_number() OVER (ORDER BY accesses, key) AS place FROM entries),
    ef AS (SELECT * FROM ea WHERE freed - size < 90 AND place <= 12), eb AS (SELECT key, size, CAST(sum(size) OVER (ORDER BY last_us, key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS freed, row_number() OVER (ORDER BY last_us, key) AS place FROM entries WHERE key NOT IN (SELECT key FROM ef))"""


@query("evict_emergency", f"WITH {EMERGENCY} SELECT key, size, freed, place, 'batch' AS step FROM ef UNION ALL SELECT key, size, freed, place, 'force' FROM eb WHERE freed - size < 90 - (SELECT max(freed) FROM ef)")
def evict_emergency(spark, sf):
    return policy.emergency(_entries(spark, sf), 90, 4).select("key", "size", "freed", "place", "step")


@query("evict_key", f"WITH {ENTRIES} SELECT key, size FROM entries WHERE key = 'user:33'")
def evict_key(spark, sf):
    return policy.evict_key(_entries(spark, sf), "user:33").select("key", "size")


@query("evict_reserve", f"WITH {ENTRIES}, r AS (SELECT key, size, CAST(sum(size) OVER (ORDER BY last_us, key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS freed, row_number() OVER (ORDER BY last_us, key) AS place FROM entries) SELECT key, size, freed, place FROM r WHERE freed - size < (SELECT sum(size) FROM entries) + 50 - 100")
def evict_reserve(spark, sf):
    return policy.reserve(_entries(spark, sf), 50, 100).select("key", "size", "freed", "place")


@query("evict_legacy", f"WITH {ENTRIES} SELECT key, coalesce(expire_us * 1000, 0) + size * 1000000 AS priority FROM entries ORDER BY priority, key LIMIT 1")
def evict_legacy(spark, sf):
    return policy.by_priority(_entries(spark, sf)).select("key", "priority")


@query(
    "eviction_decision",
    f"""WITH {STATE}, t AS (SELECT tenant, CAST(sum(size) AS BIGINT) AS bytes FROM state GROUP BY 1)
    SELECT tenant, bytes, round(bytes / 50, 6) AS ratio, bytes / 50 >= 1 AS must_evict, bytes / 50 >= 0.8 AS above_threshold, CASE WHEN bytes / 50 >= 0.8 THEN greatest(bytes - 35, 0) ELSE 0 END AS target_bytes FROM t""",
)
def eviction_decision(spark, sf):
    return kv.tenant_stats(_state(spark, sf)).select("tenant", "bytes", *policy.decision(F.col("bytes"), 50))


@query("tinylfu_admit", f"WITH {EV}, {CMS}, u AS (SELECT user_id, user_id % 4 AS tenant, max(ts_us) AS last_us FROM ev GROUP BY 1), vi AS (SELECT tenant, arg_min(user_id, (last_us, user_id)) AS victim FROM u GROUP BY 1), ve AS (SELECT tenant, estimate AS victim_estimate FROM vi JOIN est ON est.user_id = victim) SELECT u.user_id, estimate, estimate + 1 >= victim_estimate AS admitted FROM u JOIN est USING (user_id) JOIN ve USING (tenant)")
def tinylfu_admit(spark, sf):
    """Every user against the least recently seen one of the same tenant."""
    est = cms_estimate(spark, sf)
    last = derived.events(spark, sf).groupBy("user_id").agg(F.max("ts_us").alias("last_us")).withColumn("tenant", F.col("user_id") % 4)
    victims = last.groupBy("tenant").agg(F.min_by("user_id", F.struct("last_us", "user_id")).alias("victim"))
    ve = victims.join(est, F.col("victim") == F.col("user_id")).select("tenant", F.col("estimate").alias("victim_estimate"))
    return last.join(est, "user_id").join(ve, "tenant").select("user_id", "estimate", policy.admits(F.col("estimate"), F.col("victim_estimate")).alias("admitted"))


TTL = "CASE WHEN accesses = 0 THEN 60 ELSE {lo} + least(1, accesses * {p} * exp(-age / 3600) / 100) * ({hi} - {lo}) END"
AGE = f"SELECT key, accesses, ({AS_OF_US} - created_us) / 1e6 / 24 AS age FROM entries"


def _aged(spark, sf) -> DataFrame:
    return _entries(spark, sf).select("key", "accesses", ((F.lit(AS_OF_US) - F.col("created_us")) / 1e6 / 24).alias("age"))


@query("ttl_adaptive", f"WITH {ENTRIES} SELECT key, round({TTL.format(lo=60, hi=3660, p=1)}, 6) AS ttl FROM ({AGE})")
def ttl_adaptive(spark, sf):
    return _aged(spark, sf).select("key", F.round(policy.adaptive_ttl(F.col("accesses"), F.col("age"), 60, 3660), 6).alias("ttl"))


@query("ttl_adaptive_opts", f"WITH {ENTRIES} SELECT key, round({TTL.format(lo=30, hi=7200, p=1.5)}, 6) AS ttl FROM ({AGE})")
def ttl_adaptive_opts(spark, sf):
    return _aged(spark, sf).select("key", F.round(policy.adaptive_ttl_with(F.col("accesses"), F.col("age"), 60, 3660, 1.5, 30, 7200), 6).alias("ttl"))


@query("ttl_optimal", f"WITH {ENTRIES} SELECT key, round(60 + least(1, size * 25 / 100 * accesses * 60 / 1000) * 3600, 6) AS ttl FROM entries")
def ttl_optimal(spark, sf):
    return _entries(spark, sf).select("key", F.round(policy.optimal_ttl(F.col("size") * 25, F.col("accesses") * 60, 60, 3660), 6).alias("ttl"))


@query("ttl_distribution", f"WITH {STATE}, t AS (SELECT (expire_us - {LATE_US}) / 1e6 AS ttl FROM state WHERE expire_us IS NOT NULL) SELECT count(*) AS n, round(min(ttl), 6) AS min_ttl, round(avg(ttl), 6) AS avg_ttl, round(quantile_cont(ttl, 0.5), 6) AS p50_ttl, round(max(ttl), 6) AS max_ttl FROM t")
def ttl_distribution(spark, sf):
    return policy.ttl_distribution(_state(spark, sf), LATE_US)


@query("qps_profile", f"WITH {EV} SELECT ts_us - ts_us % {DAY_US} AS bucket_us, count(*) * 200 AS qps, CASE WHEN count(*) * 200 > 100000 THEN 'ultra' WHEN count(*) * 200 > 50000 THEN 'high' WHEN count(*) * 200 > 10000 THEN 'balanced' ELSE 'lowlatency' END AS profile FROM ev GROUP BY 1")
def qps_profile(spark, sf):
    e = derived.events(spark, sf)
    rate = e.groupBy((F.col("ts_us") - F.col("ts_us") % DAY_US).alias("bucket_us")).agg((F.count("*") * 200).alias("qps"))
    return rate.withColumn("profile", policy.qps_profile(F.col("qps")))


@query("latency_percentiles", f"WITH {EV}, r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM ev) SELECT p, any_value(value) AS value FROM r, (VALUES (CAST(0.5 AS DOUBLE)), (0.9), (0.99), (0.999)) t(p) WHERE i = least(CAST(floor(n * p) AS BIGINT), n - 1) GROUP BY 1")
def latency_percentiles(spark, sf):
    return policy.percentiles(derived.events(spark, sf), "value", [0.5, 0.9, 0.99, 0.999])


@query("eviction_metrics", f"WITH {_victims_sql('last_us, key', 90)[5:].replace('SELECT key, size, freed, place FROM r', 'x AS (SELECT * FROM r', 1).replace('x AS', ', x AS', 1)}) SELECT count(*) AS evictions, round(count(*) / 3600, 9) AS per_second, CASE WHEN count(*) > 0 THEN CAST(sum(size) // count(*) AS BIGINT) ELSE 0 END AS avg_bytes FROM x")
def eviction_metrics(spark, sf):
    gone = policy.lru(_entries(spark, sf), 90)
    mean = F.when(F.count("*") > 0, F.expr("sum(size) div count(*)")).otherwise(F.lit(0).cast("bigint"))
    return gone.agg(F.count("*").alias("evictions"), F.round(F.count("*") / 3600, 9).alias("per_second"), mean.alias("avg_bytes"))


@query("request_metrics", f"WITH {EV} SELECT count(*) AS requests, round(count(*) / ((max(ts_us) - min(ts_us)) / 1e6), 9) AS rps, round(sum(value) / ((max(ts_us) - min(ts_us)) / 1e6), 6) AS bps, round(count(*) FILTER (type = 'error') / count(*) * 100, 6) AS error_rate FROM ev")
def request_metrics(spark, sf):
    span = (F.max("ts_us") - F.min("ts_us")) / 1e6
    return derived.events(spark, sf).agg(F.count("*").alias("requests"), F.round(F.count("*") / span, 9).alias("rps"), F.round(F.sum("value") / span, 6).alias("bps"), F.round(F.count_if(F.col("type") == "error") / F.count("*") * 100, 6).alias("error_rate"))


PEERS = "peers AS (SELECT user_id AS peer, (max(max(ts_us)) OVER () - max(ts_us)) / 1000 / 1000 AS silent_ms, max(k) * 60 AS lag_ms FROM ev GROUP BY 1)"
HEALTH = "CASE WHEN silent_ms > 30000 THEN 'DOWN' WHEN lag_ms > 5000 THEN 'DEGRADED' ELSE 'HEALTHY' END"


def _peers(spark, sf) -> DataFrame:
    e = derived.events(spark, sf)
    last = e.agg(F.max("ts_us").alias("now"))
    per = e.groupBy(F.col("user_id").alias("peer")).agg(F.max("ts_us").alias("t"), (F.max("k") * 60).alias("lag_ms")).join(F.broadcast(last))  # one row
    return per.select("peer", ((F.col("now") - F.col("t")) / 1000 / 1000).alias("silent_ms"), "lag_ms").withColumn("status", policy.peer_health(F.col("silent_ms"), F.col("lag_ms")))


@query("peer_health", f"WITH {EV}, {PEERS} SELECT peer, {HEALTH} AS status FROM peers")
def peer_health(spark, sf):
    return _peers(spark, sf).select("peer", "status")


@query("replication_stats", f"WITH {EV}, {PEERS}, h AS (SELECT {HEALTH} AS status FROM peers) SELECT count(*) AS peers, count(*) FILTER (status = 'HEALTHY') AS healthy, count(*) FILTER (status = 'DEGRADED') AS degraded, count(*) FILTER (status = 'DOWN') AS down FROM h")
def replication_stats(spark, sf):
    return _peers(spark, sf).agg(F.count("*").alias("peers"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("HEALTHY", "DEGRADED", "DOWN")])


@query("quorum", f"WITH {EV}, g AS (SELECT type, CAST(count(DISTINCT user_id) AS INTEGER) AS peers FROM ev GROUP BY 1) SELECT type, configured, peers, CAST(CASE WHEN configured > 0 THEN configured ELSE peers // 2 + 1 END AS INTEGER) AS quorum FROM g, (SELECT CAST(x AS INTEGER) AS configured FROM range(0, 4) r(x))")
def quorum(spark, sf):
    peers = derived.events(spark, sf).groupBy("type").agg(F.count_distinct("user_id").cast("int").alias("peers"))
    grid = peers.select("type", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("configured"), "peers")
    return grid.withColumn("quorum", policy.quorum(F.col("configured"), F.col("peers")).cast("int"))


@query("rate_limit", f"WITH {EV} SELECT user_id, ts_us - ts_us % {HOUR_US} AS bucket_us, count(*) AS requests, greatest(count(*) - 2, 0) AS rejected FROM ev GROUP BY 1, 2 HAVING count(*) > 2")
def rate_limit(spark, sf):
    bucket = (F.col("ts_us") - F.col("ts_us") % HOUR_US).alias("bucket_us")
    counted = derived.events(spark, sf).groupBy("user_id", bucket).agg(F.count("*").alias("requests"))
    return counted.where("requests > 2").withColumn("rejected", F.greatest(F.col("requests") - 2, F.lit(0)))


BYTES_SQL = "CASE " + " ".join(f"WHEN n >= {1024**k} THEN printf('%.1f {u}', n / {1024**k}.0::DOUBLE)" for k, u in reversed(list(enumerate(("KB", "MB", "GB", "TB", "PB", "EB"), 1)))) + " ELSE n || ' B' END"
SIZES = "SELECT CAST(o_orderkey * o_orderkey * o_orderkey * (o_orderkey % 977) AS BIGINT) AS n FROM orders UNION SELECT unnest([0, 1023, 1024, 1536, 1048576, 1280, 1792])"


@query("fmt_bytes", f"SELECT n, {BYTES_SQL} AS text FROM ({SIZES})")
def fmt_bytes(spark, sf):
    n = derived.table(spark, sf, "orders").select(F.expr("o_orderkey * o_orderkey * o_orderkey * (o_orderkey % 977)").alias("n"))
    n = n.union(spark.sql("SELECT explode(array(0L, 1023L, 1024L, 1536L, 1048576L, 1280L, 1792L))")).distinct()
    return n.select("n", scalar.format_bytes(F.col("n")).alias("text"))


@query("fmt_duration", f"WITH {EV} SELECT ms, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1fs', ms / 1000.0::DOUBLE) WHEN ms < 3600000 THEN printf('%.1fm', ms / 60000.0::DOUBLE) ELSE printf('%.1fh', ms / 3600000.0::DOUBLE) END AS text FROM (SELECT DISTINCT seq * seq * 7 + seq AS ms FROM ev)")
def fmt_duration(spark, sf):
    ms = derived.events(spark, sf).select((F.col("seq") * F.col("seq") * 7 + F.col("seq")).alias("ms")).distinct()
    return ms.withColumn("text", scalar.format_duration(F.col("ms")))


@query("fmt_percent", f"WITH {EV}, c AS (SELECT type, count(*) AS n FROM ev GROUP BY 1), t AS (SELECT sum(n) AS total FROM c) SELECT type, printf('%.1f%%', n / total * 100) AS percent, printf('%.1f/s', n / 8.0::DOUBLE) AS rate FROM c, t")
def fmt_percent(spark, sf):
    c = derived.events(spark, sf).groupBy("type").agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("total"))
    return c.join(F.broadcast(t)).select("type", scalar.format_percent(F.col("n"), F.col("total")).alias("percent"), scalar.format_rate(F.col("n"), F.lit(8)).alias("rate"))  # one row


@query("sanitize_key", "SELECT p_partkey AS id, regexp_replace(p_name || '/' || p_type || ' #' || p_brand, '[^A-Za-z0-9_.-]', '_', 'g') AS name FROM part")
def sanitize_key(spark, sf):
    return derived.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), scalar.sanitize_key(F.concat("p_name", F.lit("/"), "p_type", F.lit(" #"), "p_brand")).alias("name"))


@query("tenant_valid", "SELECT name, regexp_full_match(name, '[A-Za-z0-9_-]{1,64}') AS ok FROM (SELECT DISTINCT c_name AS name FROM customer UNION SELECT unnest(['a-b_1', '', repeat('x', 64), repeat('x', 65), 'a b', 'a.b']))")
def tenant_valid(spark, sf):
    names = derived.table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    extra = spark.sql("SELECT explode(array('a-b_1', '', repeat('x', 64), repeat('x', 65), 'a b', 'a.b')) AS name")
    return names.union(extra).distinct().withColumn("ok", scalar.is_tenant(F.col("name")))


BOUNDS = [1, 5, 10, 20, 50, 100]


@query("first_true", f"WITH {EV} SELECT seq, CAST(len(list_filter({BOUNDS}, lambda b: b < value)) AS INTEGER) AS bucket FROM ev")
def first_true(spark, sf):
    bounds = F.array(*[F.lit(float(b)) for b in BOUNDS])
    return derived.events(spark, sf).select("seq", scalar.first_true(bounds, lambda b: b >= F.col("value")).alias("bucket"))


@query("json_decode", f"SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.no') AS missing FROM events")
def json_decode(spark, sf):
    found = derived.table(spark, sf, "events").select(F.col("event_id").alias("seq"), scalar.from_json(F.col("props"), "k bigint, no string").alias("j"))
    return found.select("seq", "j.k", F.col("j.no").alias("missing"))


@query("json_encode", f"WITH {EV} SELECT seq, '{{\"seq\":' || seq || ',\"type\":\"' || type || '\"' || CASE WHEN user_id % 2 = 0 THEN ',\"k\":' || k ELSE '' END || '}}' AS json FROM ev")
def json_encode(spark, sf):
    e = derived.events(spark, sf).select("seq", "type", F.when(F.col("user_id") % 2 == 0, F.col("k")).alias("k"))
    return e.select("seq", scalar.as_json("seq", "type", "k").alias("json"))


@query("next_pow2", "SELECT n, CAST(CASE WHEN n <= 1 THEN 1 ELSE 1 << CAST(ceil(log2(n)) AS INTEGER) END AS BIGINT) AS power FROM (SELECT DISTINCT CAST(o_orderkey AS BIGINT) AS n FROM orders)")
def next_pow2(spark, sf):
    n = derived.table(spark, sf, "orders").select(F.col("o_orderkey").cast("bigint").alias("n")).distinct()
    return n.select("n", scalar.next_power_of_two(F.col("n")).alias("power"))


def _fnv_sql(steps: int) -> str:
    h = "CAST(2166136261 AS BIGINT)"
    out = f"WITH h0 AS (SELECT DISTINCT 'user:' || user_id AS key, {h} AS h FROM events)"
    for i in range(1, steps + 1):
        out += f", h{i} AS (SELECT key, CASE WHEN length(key) >= {i} THEN (xor(h, ascii(substr(key, {i}, 1))) * 16777619) & 4294967295 ELSE h END AS h FROM h{i - 1})"
    return out + f" SELECT key, h & 255 AS shard FROM h{steps}"


@query("shard_route", _fnv_sql(12))
def shard_route(spark, sf):
    keys = derived.events(spark, sf).select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key")).distinct()
    return keys.select("key", scalar.shard_of(F.col("key"), 256).alias("shard"))
