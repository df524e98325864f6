"""A directed property graph as two tables: nodes ``(id, ...)`` and edges ``(src, dst, type, weight)``, one edge a pair.

Iterative operators write their edges once, so that no round works them out anew, and cut their lineage each round with a
reliable checkpoint, or keep a handful of rounds as one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import naming, order
from tessera.operators.lineage import reliable

#: Rounds between two checkpoints.
EVERY = 4


def _cut(df: DataFrame, round_: int) -> DataFrame:
    """A reliable checkpoint every few rounds."""
    return df if (round_ + 1) % EVERY else reliable(df)


def graphs(log: DataFrame) -> DataFrame:
    """``(name, seq)`` of the graphs that exist after a log of CREATE and DROP."""
    return naming.live(log)


def add_nodes(log: DataFrame) -> DataFrame:
    """``(id, props)``: writing a node again replaces its properties; missing ones are an empty map."""
    last = log.groupBy("id").agg(F.max_by(F.struct("props"), "seq").alias("n"))
    return last.select("id", F.coalesce("n.props", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("props"))


def get_nodes(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(id)`` with the columns of the node; null, and ``is_there`` false, where there is none."""
    return asked.join(nodes.withColumn("is_there", F.lit(True)), "id", "left").withColumn("is_there", F.coalesce("is_there", F.lit(False)))


def get_edges(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(src, dst)`` with the columns of the edge; null, and ``is_there`` false, where there is none."""
    return asked.join(edges.withColumn("is_there", F.lit(True)), ["src", "dst"], "left").withColumn("is_there", F.coalesce("is_there", F.lit(False)))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids, edges.src == ids.id, "left_semi").join(ids, edges.dst == ids.id, "left_semi")


def latest_edges(log: DataFrame) -> DataFrame:
    """The last edge written of each pair: writing one again replaces it."""
    return log.groupBy("src", "dst").agg(F.max_by(F.struct("type", "weight"), "seq").alias("e")).select("src", "dst", "e.type", "e.weight")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without some nodes and the edges that touch them."""
    left = edges.join(gone, edges.src == gone.id, "left_anti").join(gone, edges.dst == gone.id, "left_anti")
    return nodes.join(gone, "id", "left_anti"), left


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes asked for and the edges between them."""
    kept = nodes.join(ids, "id", "left_semi")
    return kept, valid_edges(edges, kept)


def update_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes with the property maps of ``changes(id, props)`` merged in, the change winning."""
    c = changes.withColumnRenamed("props", "new")
    merged = F.map_from_entries(F.filter(F.map_entries("props"), lambda e: ~F.map_contains_key("new", e["key"])))
    return nodes.join(c, "id", "left").withColumn("props", F.when(F.col("new").isNull(), F.col("props")).otherwise(F.map_concat(merged, "new"))).drop("new")


def neighbours(edges: DataFrame, start: int, depth: int, kind: str = "") -> DataFrame:
    """Distinct nodes at 1 to ``depth`` steps from ``start`` over edges of one type ("" for any), with the fewest steps."""
    e = reliable((edges if not kind else edges.where(F.col("type") == kind)).select("src", "dst"))
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0)], "id bigint, steps int")
    front = seen
    for d in range(1, depth + 1):
        front = e.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("steps", F.lit(d))
        front = _cut(front, d)
        seen = seen.union(front)
    return seen.where(F.col("id") != start)


def cheapest(edges: DataFrame, start: int, rounds: int | None = None) -> DataFrame:
    """``(id, cost, before)``: the cost of the cheapest way to every node within reach, and the node before it on such a way,
    the smallest if there are several; null for ``start``.

    Relaxes the nodes whose cost fell until none does; weights must be above 0, or at least not negative on a way without
    cycles of weight 0. ``rounds`` bounds the number of edges. A row holds three numbers, however long the ways are.
    """
    spark = edges.sparkSession
    steps = reliable(edges.select("src", "dst", "weight"))
    best = spark.createDataFrame([(start, 0.0, None)], "id bigint, cost double, before bigint")
    front, r = best, 0
    while rounds is None or r < rounds:
        offers = steps.join(front.select(F.col("id").alias("src"), "cost"), "src").select(F.col("dst").alias("id"), (F.col("cost") + F.col("weight")).alias("cost"), F.col("src").alias("before"))
        offers = offers.where(F.col("id") != start).groupBy("id").agg(F.min(F.struct("cost", "before")).alias("o")).select("id", "o.cost", "o.before")
        old = best.select("id", F.col("cost").alias("old"), F.col("before").alias("old_before"))
        new = offers.join(old, "id", "full").select("id", "old", F.when(F.col("old").isNull() | (F.col("cost") < F.col("old")) | ((F.col("cost") == F.col("old")) & (F.col("before") < F.col("old_before"))), F.struct("cost", "before")).otherwise(F.struct(F.col("old").alias("cost"), F.col("old_before").alias("before"))).alias("o"))
        both = reliable(new.select("id", "o.cost", "o.before", (F.col("old").isNull() | (F.col("o.cost") < F.col("old"))).alias("fell")))
        best, front = both.select("id", "cost", "before"), both.where("fell").select("id", "cost")
        if front.isEmpty():
            break
        r += 1
    return best


def shortest_paths(edges: DataFrame, start: int, rounds: int | None = None, to: DataFrame | None = None) -> DataFrame:
    """``(id, cost, path)``: the cheapest path from ``start`` to every node within reach, or to those of ``to(id)``; at every
    step back the smallest node is taken. Paths are put together from ``cheapest`` for the asked nodes only, a join a step."""
    best = cheapest(edges, start, rounds)
    asked = best if to is None else best.join(to.select("id").distinct(), "id", "left_semi")
    back = best.select(F.col("id").alias("at"), F.col("before").alias("next"))
    live = asked.select("id", "cost", F.col("before").alias("at"), F.array("id").alias("path"))
    done = None
    while True:
        ended = live.where("at is null").select("id", "cost", "path")
        done = ended if done is None else done.union(ended)
        live = live.where("at is not null")
        if live.isEmpty():
            return done
        live = reliable(live.join(back, "at").select("id", "cost", F.col("next").alias("at"), F.concat(F.array("at"), "path").alias("path")))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """``(id, rank)`` after a fixed number of rounds from 1/N; the rank of nodes without out-edges is dropped."""
    rounds = rounds if rounds > 0 else 20
    damping = damping if 0 < damping < 1 else 0.85
    ids = reliable(nodes.select("id"))
    n = ids.count()
    links = reliable(edges.select("src", "dst"))
    e = reliable(links.join(links.groupBy("src").agg(F.count("*").alias("degree")), "src").select("src", "dst", "degree"))
    ranks = ids.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for r in range(rounds):
        given = e.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        ranks = _cut(ids.join(given, "id", "left").select("id", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")), r)
    return ranks


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 50, strict_gain: bool = False, other_only: bool = False) -> DataFrame:
    """``(id, community)`` by synchronous weighted label propagation.

    Every node starts with a label of its own; in a round it takes the label with the greatest positive weight among its
    out-neighbours, ties to the smallest. With ``other_only`` the candidate is the best label that it doesn't hold, and with
    ``strict_gain`` it moves only for more than its own label weighs. Ends when nothing changes; labels are numbered from 0.
    """
    edges = reliable(edges.select("src", "dst", "weight"))
    labels = reliable(nodes.select("id")).withColumn("label", F.col("id"))
    top = Window.partitionBy("id").orderBy(F.desc("w"), "label")
    for r in range(rounds):
        held = labels.select(F.col("id").alias("dst"), "label")
        votes = edges.join(held, "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("weight").alias("w")).where("w > 0")
        own = labels.select("id", F.col("label").alias("own"))
        votes = votes.join(own, "id")
        mine = votes.where("label = own").select("id", F.col("w").alias("own_w"))
        rivals = votes.where("label <> own") if other_only else votes
        best = rivals.withColumn("k", F.row_number().over(top)).where("k = 1").select("id", F.col("label").alias("new"), "w")
        moved = own.join(best, "id", "left").join(mine, "id", "left")
        go = F.col("new").isNotNull() & (F.col("w") > F.coalesce("own_w", F.lit(0)) if strict_gain else F.lit(True))
        nxt = _cut(moved.select("id", F.when(go, F.col("new")).otherwise(F.col("own")).alias("label"), F.col("own")), EVERY - 1)
        changed = not nxt.where("label <> own").isEmpty()
        labels = nxt.select("id", "label")
        if not changed:
            break
    names = order.placed(labels.select("label").distinct(), [], ["label"])
    return labels.join(names, "label").select("id", F.col("place").cast("bigint").alias("community"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")))


def as_json(df: DataFrame) -> DataFrame:
    """Each node or edge as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
