"""Small cases with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import bitmap, graph, kv, oplog, order, policy, sketch, stream, vector, zset
from tessera.sources import generators, snapshots
from tessera.store import Store
from tessera.streaming import continuous

S = 1_000_000
LOG = "tenant string, seq long, ts_us long, op string, key string, value string, delta long, ttl_us long"


def log(spark, *rows):
    return spark.createDataFrame([("t", i, ts, op, k, v, d, ttl) for i, (ts, op, k, v, d, ttl) in enumerate(rows)], LOG)


def events(spark, rows):
    return spark.createDataFrame([("s", i, t * S, "e", float(v)) for i, (t, v) in enumerate(rows)], "stream string, seq long, ts_us long, type string, value double")


def test_windows(spark):
    e = events(spark, [(0, 1), (59, 2), (60, 3), (119, 4), (180, 5)])
    want = {"sum": [3, 7, 5], "avg": [1.5, 3.5, 5], "min": [1, 3, 5], "max": [2, 4, 5], "count": [2, 2, 1]}
    for agg, values in want.items():
        got = stream.tumbling(e, 60 * S, agg).orderBy("bucket_us").collect()
        assert [(r.bucket_us // S, r.agg_value) for r in got] == list(zip((0, 60, 180), values, strict=True))
    with pytest.raises(ValueError):
        stream.tumbling(e, S, "median")
    assert [r.value for r in stream.time_range(e, 60 * S, 119 * S).orderBy("seq").collect()] == [3, 4]


def test_anomalies(spark):
    e = events(spark, [(i, 10) for i in range(9)] + [(9, 100)])
    assert [r.seq for r in stream.anomalies(e, 2.5).collect()] == [9]
    assert stream.anomalies(e, 3.0).collect() == [] == stream.anomalies(e.where("seq > 0"), 2.5).collect()
    assert stream.anomalies(events(spark, [(i, 5) for i in range(10)])).collect() == []


def test_forecast(spark):
    assert stream.forecast(events(spark, [(0, 1), (1, 3), (2, 5), (3, 7)]), 2 * S).first().forecast == pytest.approx(11)
    assert stream.forecast(events(spark, [(0, 1)]), S).first().forecast == 0
    assert stream.forecast(events(spark, [(1, 1), (1, 3)]), S).first().forecast == 0


def test_read_group(spark):
    e = events(spark, [(1, 0), (2, 0), (2, 0), (3, 0)])
    first = oplog.read_after(e, 0, 2).collect()
    assert [r.seq for r in first] == [0, 1]
    assert [r.seq for r in oplog.read_after(e, first[-1].ts_us, 2).collect()] == [3]


def test_sequences(spark):
    rows = [("u", i, t * S, k) for i, (t, k) in enumerate([(0, "A"), (1, "B"), (2, "C"), (3, "A"), (4, "C")])]
    e = spark.createDataFrame(rows, "user string, seq long, ts_us long, type string")
    assert [r.seqs for r in stream.sequences(e, "user", ["A", "B", "C"], 3 * S).collect()] == [[0, 1, 2]]
    assert stream.sequences(e, "user", ["A", "B", "C"], S).collect() == []


def test_zset(spark):
    z = zset.fold(spark.createDataFrame([("k", m, float(s), i) for i, (m, s) in enumerate([("a", 2), ("b", 1), ("c", 1), ("a", 0.5)])], "zkey string, member string, score double, seq long"))
    assert [r.member for r in zset.ranks(z).orderBy("rank").collect()] == ["a", "b", "c"]
    asked = spark.createDataFrame([("c",), ("z",)], "member string")
    assert {r.member: r["rank"] for r in zset.rank_of(z, "k", asked).collect()} == {"c": 2, "z": -1}
    want = {(0, -1): "abc", (-2, -1): "bc", (1, 100): "bc", (3, 5): "", (2, 1): "", (-100, 0): "a"}
    for (a, b), members in want.items():
        assert "".join(r.member for r in zset.by_position(z, a, b).orderBy("rank").collect()) == members
    assert zset.card(z).first().card == 3


def test_bitmap(spark):
    rows = [("b", i, o, v) for i, (o, v) in enumerate([(5, 1), (5, 1), (70000, 1), (5, 0)])]
    bits = spark.createDataFrame(rows, "bkey string, seq long, offset long, bit int")
    assert [r.previous for r in bitmap.previous(bits).orderBy("seq").collect()] == [0, 1, 0, 1]
    assert bitmap.count(bitmap.fold(bits.where("seq < 3"))).first().n == 2 and bitmap.count(bitmap.fold(bits)).first().n == 1
    assert [r.n for r in bitmap.packed(bitmap.fold(bits.where("seq < 3"))).orderBy("bucket").collect()] == [1, 1]
    with pytest.raises(Exception, match="bit must be"):
        bitmap.fold(bits.withColumn("bit", F.lit(2))).collect()


def test_counters_and_expiry(spark):
    l = log(spark, (0, "SET", "a", "10", None, None), (1, "INCR", "a", None, 5, None), (2, "SET", "b", "x", None, None), (3, "INCR", "b", None, 1, None), (4, "SET", "c", "1", None, 3600 * S), (5, "INCR", "c", None, 1, None), (6, "SET", "d", "7", None, 1), (9, "INCR", "d", None, 2, None), (10, "SET", "e", "v", None, 5), (11, "SET", "f", "v", None, None), (12, "DEL", "f", None, None, None))
    got = {r.key: r for r in kv.fold(l).collect()}
    assert got["a"].value == "15" and got["b"].value is None and got["b"].is_error
    assert got["c"].value == "2" and got["c"].expire_us is None and got["d"].value == "2" and "f" not in got
    more = l.unionByName(spark.createDataFrame([("t", 20, 20, "DEL", "a", None, None, None), ("t", 21, 21, "INCR", "a", None, 1, None)], LOG))
    assert {r.key: r.value for r in kv.fold(more).collect()}["a"] == "1"
    state = kv.fold(l)
    assert kv.get(state, "t", "e", 15).count() == 1 and kv.get(state, "t", "e", 16).count() == 0  # expired after, not at, its expiry


def test_snapshot_round_trip(spark, tmp_path):
    l = log(spark, (0, "SET", "a", "1", None, None), (1, "SET", "b", "2", None, 100), (2, "SET", "c", "3", None, 1))
    state = kv.fold(l)
    snapshots.snapshot(state, str(tmp_path / "s"), 50)
    back = kv.fold(snapshots.restore(spark, str(tmp_path / "s")))
    assert {(r.key, r.value, r.expire_us) for r in back.collect()} == {("a", "1", None), ("b", "2", 101)}
    snapshots.append_log(l, str(tmp_path / "l"))
    assert kv.fold(snapshots.read_log(spark, str(tmp_path / "l"))).count() == 3
    s = Store(l)
    assert s.get("t", "a", 9).first().value == "1" and s.tenant("u").log.count() == 0 and s.clear().state().count() == 0


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "id long, v array<double>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    want = {"cosine": [(1, 0.0), (3, 0.292893), (2, 1.0), (4, 1.0)], "euclidean": [(1, 0.0), (3, 1.0), (4, 1.0), (2, 1.414214)], "dot": [(1, -1.0), (3, -1.0), (2, 0.0), (4, 0.0)], "manhattan": [(1, 0.0), (3, 1.0), (4, 1.0), (2, 2.0)]}
    for name, rows in want.items():
        assert [(r.id, r.distance + 0) for r in vector.nearest(v, q, 4, name).collect()] == rows


GRAPH = [("A", "B", 1, "f"), ("B", "C", 1, "f"), ("A", "C", 5, "g"), ("C", "D", 1, "f")]


def small_graph(spark):
    number = {c: i for i, c in enumerate("ABCD")}
    e = spark.createDataFrame([(number[a], number[b], w, t) for a, b, w, t in GRAPH], "src long, dst long, weight long, type string")
    return spark.createDataFrame([(i,) for i in range(4)], "id long"), e


def test_graph(spark):
    nodes, edges = small_graph(spark)
    paths = {r.id: (r.cost, r.path) for r in graph.shortest_paths(edges, 0).collect()}
    assert paths[3] == (3.0, [0, 1, 2, 3]) and {r.id for r in graph.shortest_paths(edges, 3).collect()} == {3}
    reach = lambda d, t: {r.id for r in graph.neighbours(edges, 0, d, t).collect()}
    assert reach(1, "") == {1, 2} and reach(2, "") == {1, 2, 3} and reach(2, "f") == {1, 2} and reach(1, "g") == {2}
    got = {r.id: r["rank"] for r in graph.pagerank(nodes, edges, 1).collect()}
    assert [round(got[i], 5) for i in range(4)] == [0.0375, 0.14375, 0.35625, 0.25]
    kept, inner = graph.subgraph(nodes, edges, nodes.where("id in (0, 2)"))
    assert kept.count() == 2 and [(r.src, r.dst) for r in inner.collect()] == [(0, 2)]
    again = spark.createDataFrame([(0, 1, "f", 1, 0), (0, 1, "x", 2, 1)], "src long, dst long, type string, weight long, seq long")
    assert [(r.weight, r.type) for r in graph.latest_edges(again).collect()] == [(2, "x")]


def test_sketches(spark):
    assert sketch.bloom_size(1000, 0.01) == (9586, 7)
    m, k = sketch.bloom_size(500, 0.01)
    keys = spark.range(500).select(F.col("id").alias("key"))
    got = sketch.bloom_probe(spark.range(3000).select(F.col("id").alias("key")), "key", sketch.bloom_build(keys, "key", m, k), m, k).collect()
    assert all(r.may_contain for r in got if r.key < 500) and sum(r.may_contain for r in got if r.key >= 500) < 0.03 * 2500
    many = spark.range(4000).select((F.col("id") % 97 * (F.col("id") % 5)).alias("key"))
    true = {r.key: r.n for r in many.groupBy("key").agg(F.count("*").alias("n")).collect()}
    est = sketch.cms_estimate(many.distinct(), "key", sketch.cms_build(many, "key", 64, 4), 64, 4).collect()
    assert all(r.estimate >= true[r.key] for r in est)


def test_policies(spark):
    e = spark.createDataFrame([("k1", 10, 1, 5), ("k2", 20, 2, 5), ("k3", 30, 3, 1)], "key string, size long, last_us long, accesses long")
    got = policy.lru(e, 25).orderBy("place").collect()
    assert [(r.key, r.freed) for r in got] == [("k1", 10), ("k2", 30)]
    assert [r.key for r in policy.lfu(e, 35).orderBy("place").collect()] == ["k3", "k1"] and policy.lru(e, 0).collect() == []
    one = spark.range(1)
    ttl = [one.select(policy.adaptive_ttl(F.lit(a), F.lit(float(age)), 60, 3660)).first()[0] for a, age in ((0, 0), (100, 0), (100, 3600))]
    assert [round(x, 2) for x in ttl] == [60, 3660, 1384.37]
    assert one.select(policy.admits(F.lit(3), F.lit(4))).first()[0]
    points = policy.percentiles(spark.range(1, 11).select("id"), "id", [0.5, 0.9, 0.99]).collect()
    assert {r.p: r.value for r in points} == {0.5: 6, 0.9: 10, 0.99: 10}


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(scalar.format_bytes(F.lit(n).cast("bigint"))) for n in (0, 1023, 1536, 1048576)] == ["0 B", "1023 B", "1.5 KB", "1.0 MB"]
    assert [one(scalar.format_duration(F.lit(n).cast("bigint"))) for n in (999, 1500, 90000, 7200000)] == ["999ms", "1.5s", "1.5m", "2.0h"]
    assert one(scalar.format_percent(F.lit(1), F.lit(0))) == "0.0%" and one(scalar.format_rate(F.lit(5), F.lit(0))) == "0/s"
    assert [one(scalar.next_power_of_two(F.lit(n))) for n in (0, 1, 2, 5, 256)] == [1, 1, 2, 8, 256]
    assert [one(scalar.is_tenant(F.lit(x))) for x in ("a-b_1", "", "x" * 65, "a b", "a\n")] == [True, False, False, False, False]
    assert [scalar.parse_duration_ns(x) for x in ("5m", "1h30m", "-1.5s", "0", "100us")] == [300 * 10**9, 5400 * 10**9, -15 * 10**8, 0, 10**5]
    with pytest.raises(ValueError):
        scalar.parse_duration_ns("5 minutes")
    assert one(scalar.shard_of(F.lit(""), 256)) == 2166136261 & 255


def test_texts(spark):
    assert kv.prometheus(spark.sql("select 3L as items, 10L as bytes"), "x").first().text == "# TYPE x_items gauge\nx_items 3\n# TYPE x_bytes gauge\nx_bytes 10"
    assert graph.as_json(spark.sql("select 1L as src, 2L as dst")).first().json == '{"src":1,"dst":2}'


def test_streaming(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    src = continuous.source(spark, d, "events.parquet")
    q = continuous.tumbling(src, "1 hour", "avg").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.stream, r.bucket_us): round(r.agg_value, 6) for r in spark.table("w").collect()}
    from tessera.sources import derived

    want = {(r.stream, r.bucket_us): round(r.agg_value, 6) for r in stream.tumbling(derived.events(spark, d), 3600 * S, "avg").collect()}
    assert got == want
    q = continuous.running_anomalies(src).writeStream.outputMode("append").format("memory").queryName("z").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert 0 < spark.table("z").count() < 200 and spark.table("z").where("abs(z) <= 2.5").count() == 0
    seen = []
    continuous.consume(src, str(tmp_path / "c"), lambda df, n: seen.append(df.count())).awaitTermination(120)
    continuous.consume(src, str(tmp_path / "c"), lambda df, n: seen.append(df.count())).awaitTermination(120)
    assert sum(seen) == 1000
    continuous.write_behind(src, str(tmp_path / "o"), str(tmp_path / "oc")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1000


def test_registered_shortest_path_has_no_bound(spark, monkeypatch):
    from tessera.plans import catalog

    edges = spark.range(10).selectExpr("id AS src", "id + 1 AS dst", "'x' AS type", "1L AS weight")
    monkeypatch.setattr(catalog.derived, "nation_graph", lambda *_: (spark.range(11), edges))
    assert {r.id: r.cost for r in catalog.QUERIES["graph_shortest_path"](spark, "").collect()} == {i: float(i) for i in range(11)}


def test_places_by_ranges(spark, monkeypatch):
    rows = [(k, f"m{i:03d}", float(i * 7 % 10)) for k, n in (("a", 200), ("b", 3), ("c", 1), (None, 7)) for i in range(n)]
    z = spark.createDataFrame(rows, "zkey string, member string, score double").repartition(5)
    want = {k: sorted((s, m) for x, m, s in rows if x == k) for k in ("a", "b", "c", None)}
    got = order.placed(z, ["zkey"], ["score", "member"]).collect()
    assert all(want[r.zkey][r.place] == (r.score, r.member) and r.n == len(want[r.zkey]) for r in got) and len(got) == 211
    nexts = order.following(z, ["zkey"], ["score", "member"], "member", "after").collect()
    for r in nexts:
        k = want[r.zkey].index((r.score, r.member))
        assert r.after == (want[r.zkey][k + 1][1] if k + 1 < len(want[r.zkey]) else None)
    monkeypatch.setattr(zset, "NEAR", 2)
    for a, b in ((0, -1), (-5, -2), (5, 20), (-300, 150), (3, 1)):
        places = zset.by_position(z, a, b).collect()
        for k in "abc":
            members = want[k]
            n = len(members)
            first, last = max(a if a >= 0 else n + a, 0), b if b >= 0 else n + b
            assert sorted((r["rank"], r.member) for r in places if r.zkey == k) == [(i, members[i][1]) for i in range(first, min(last + 1, n))]
    asked = spark.createDataFrame([("m007",), ("m150",), ("none",), ("m007",)], "member string")
    want_ranks = {m: k for k, (_, m) in enumerate(want["a"])} | {"none": -1}
    for most in (1000, 1):
        monkeypatch.setattr(zset, "MOST_ASKED", most)
        ranks = zset.rank_of(z, "a", asked).collect()
        assert len(ranks) == 3 and all(r["rank"] == want_ranks[r.member] for r in ranks)
    assert [r["rank"] for r in zset.rank_of(z.where("score > 99"), "a", asked).collect()] == [-1, -1, -1]


def test_percentile_of_two_middles(spark):
    e = spark.createDataFrame([(i * S,) for i in (5, 1, 9, 3)] + [(None,)], "expire_us long")
    r = policy.ttl_distribution(e, 0).first()
    assert (r.n, r.min_ttl, r.avg_ttl, r.p50_ttl, r.max_ttl) == (4, 1, 4.5, 4, 9)
    assert policy.ttl_distribution(e.limit(0), 0).first().p50_ttl is None


def test_paths_of_asked_nodes(spark):
    _, e = small_graph(spark)
    got = {r.id: (r.cost, r.path) for r in graph.shortest_paths(e, 0).collect()}
    assert got == {0: (0, [0]), 1: (1, [0, 1]), 2: (2, [0, 1, 2]), 3: (3, [0, 1, 2, 3])}
    assert [r.path for r in graph.shortest_paths(e, 0, to=spark.createDataFrame([(3,), (99,)], "id long")).collect()] == [[0, 1, 2, 3]]
    assert [r.id for r in graph.cheapest(e, 3).collect()] == [3]


def test_snapshots_take_the_place_of_the_last(spark, tmp_path):
    folder = str(tmp_path / "s")
    l = log(spark, (0, "SET", "a", "1", None, None), (1, "SET", "b", "2", None, None))
    snapshots.snapshot(kv.fold(l), folder, 50)
    snapshots.compact(spark, snapshots.restore(spark, folder).unionByName(log(spark, (2, "SET", "c", "3", None, None))), folder, 60)  # a log that reads the folder
    assert {r.key for r in snapshots.restore(spark, folder).collect()} == {"a", "b", "c"}
    bad = kv.fold(l).withColumn("value", F.raise_error("no").cast("string"))
    with pytest.raises(Exception, match="no"):
        snapshots.snapshot(bad, folder, 50)
    assert snapshots.restore(spark, folder).count() == 3  # a failed write leaves what was there
    z = spark.createDataFrame([("k", "a", 1.5), ("k", "b", -2.0)], "zkey string, member string, score double")
    snapshots.snapshot_sets(z, str(tmp_path / "z"))
    assert {tuple(r) for r in snapshots.restore_sets(spark, str(tmp_path / "z")).collect()} == {("k", "a", 1.5), ("k", "b", -2.0)}


def test_snapshot_as_the_log_grows(spark, tmp_path):
    folder, snap, marks = (str(tmp_path / x) for x in ("l", "s", "c"))
    for k in range(2):
        snapshots.append_log(log(spark, (k, "SET", f"k{k}", "v", None, None)).withColumn("seq", F.lit(k).cast("long")), folder)
        source = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
        continuous.snapshot_as_it_grows(source, lambda: snapshots.read_log(spark, folder), snap, marks).awaitTermination()
        assert {r.key for r in snapshots.restore(spark, snap).collect()} == {f"k{i}" for i in range(k + 1)}


def test_generators(spark):
    v = generators.unit_vectors(spark, 50, 16)
    assert v.where(F.abs(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) - 1) > 1e-9).count() == 0
    q = generators.noisy_queries(v, 10)
    found = vector.nearest_of_each(v, q, 1).collect()
    assert len(found) == 5 and all(r.qid == r.id for r in found)
    assert generators.key_values(spark, 100, 10).where("length(value) = 128").select("key").distinct().count() == 10
    assert zset.card(zset.fold(generators.sorted_sets(spark, 3, 20))).where("card = 20").count() == 3
    assert bitmap.fold(generators.bit_writes(spark, 200, 2, 1000)).where("offset between 0 and 999").count() > 50
    e = generators.graph_edges(spark, 20, 3)
    assert 0 < e.count() <= 60 and e.where("src = dst").count() == 0
    assert stream.tumbling(generators.stream_events(spark, 100, 4), 10_000, "count").agg(F.sum("agg_value")).first()[0] == 100


def test_refusals(spark):
    e = spark.createDataFrame([("t", "a", 10, 1, 3), ("t", "b", 20, 2, 4)], "tenant string, key string, size long, last_us long, accesses long")
    assert policy.evict_key(e, "").count() == 0 and policy.evict_key(e, "b").first().size == 20
    assert [r.key for r in policy.reserve(e, 5, 30).collect()] == ["a"] and policy.reserve(e, 5, 0).count() == 0 == policy.reserve(e, 5, 35).count()
    with pytest.raises(ValueError, match="insufficient"):
        policy.reserve(e, 40, 30)
    assert sorted((r.key, r.step) for r in policy.emergency(e, 25, 1, 1).collect()) == [("a", "batch"), ("b", "force")]
    with pytest.raises(Exception, match="not a filter"):
        sketch.bloom_import(spark.createDataFrame([(1, 1)], "word long, value long"), 64).collect()
    with pytest.raises(Exception, match="empty key"):
        vector.put_with_embeddings(spark.createDataFrame([("", 1, "v", [1.0])], "key string, seq long, value string, v array<double>")).collect()
    with pytest.raises(ValueError):
        oplog.changes_while(spark.createDataFrame([], LOG), spark.range(1001).selectExpr("id as seq", "true as is_on"))


def test_json_and_search(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ("not json",), (None,)], "t string")
    assert [r.j and tuple(r.j) for r in df.select(scalar.from_json(F.col("t"), "a int, b string").alias("j")).collect()] == [(1, "x"), None, None]
    assert spark.range(1).select(scalar.first_true(F.array(F.lit(1), F.lit(4), F.lit(9)), lambda x: x >= 4), scalar.first_true(F.array(F.lit(1)), lambda x: x > 4)).first() == (1, 1)
