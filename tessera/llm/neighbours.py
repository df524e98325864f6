"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more component, which makes all their norms equal, so that the largest inner product is the smallest
distance. Centroids come from a bounded sample by balanced bisection. A vector goes to its nearest list and, near a
boundary, to others as well: those within a distance ratio whose centroid is not closer to a list already chosen. A query
walks a graph over the centroids, which is held in memory, and visits the lists within a distance ratio of its nearest
one; the ratio and the number of lists are measured on the sample. Identical vectors are one entry of a list, and long lists are divided into blocks, so that no task gets an unbounded
group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, written

#: Bounds of the fit: rows of the sample, numbers in it, and lists.
SAMPLE_ROWS, SAMPLE_NUMBERS, MAX_LISTS = 20_000, 4_000_000, 4096
#: Vectors that a list is planned for, copies of a boundary vector at most, their distance ratio, and how far the centroids
#: of two lists of a vector must lie apart, as a share of its distance.
LIST_ROWS, REPLICAS, BOUNDARY_RATIO, APART = 256, 4, 1.15, 0.5
#: Edges of a centroid in the graph, and lists that a query visits at least.
DEGREE, LEAST_LISTS = 24, 12
#: How many lists a query visits at most, and within which distance ratio, is measured on the sample: so many that this
#: share of the true neighbours of TRIALS of its vectors is met.
COVERED, TRIALS = 0.97, 200
#: Vectors, and queries, that a task compares at once.
BLOCK = 2048


def _bisect(x: np.ndarray, leaf: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Index sets of at most ``leaf`` rows: each set is divided by 2-means and cut at the median of the two distances."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        ids = todo.pop()
        if len(ids) <= leaf:
            out.append(ids)
            continue
        part = x[ids]
        c = part[rng.choice(len(ids), 2, replace=False)]
        for _ in range(6):
            lean = part @ (c[0] - c[1]) - (c[0] @ c[0] - c[1] @ c[1]) / 2
            order = np.argsort(lean, kind="stable")
            half = len(ids) // 2
            c = np.stack([part[order[half:]].mean(0), part[order[:half]].mean(0)])
        todo += [ids[order[:half]], ids[order[half:]]]
    return out


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0))


@dataclass
class Centroids:
    """Centroids, the graph that joins each to its nearest and to two random others, the largest squared norm, and the
    lists a query visits at most and their distance ratio."""

    points: np.ndarray
    graph: np.ndarray
    norm2: float
    most: int = LEAST_LISTS
    ratio: float = 1.0

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))
        return np.concatenate([x, last[:, None]], 1)

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and lists of vectors, boundary vectors more than once."""
        d = _distances(self.lifted(x), self.points)
        k = min(REPLICAS, len(self.points))
        near = np.argpartition(d, k - 1, 1)[:, :k]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), 1, kind="stable"), 1)
        own = np.take_along_axis(d, near, 1)
        ok = own <= BOUNDARY_RATIO * own[:, :1] + 1e-12
        for j in range(1, k):
            for i in range(j):
                apart = np.sqrt(((self.points[near[:, j]] - self.points[near[:, i]]) ** 2).sum(1))
                ok[:, j] &= ~ok[:, i] | (apart >= APART * own[:, j])
        rows, cols = np.nonzero(ok)
        return rows, near[rows, cols]

    def visits(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and lists of queries: a best-first walk over the graph, all queries in step."""
        n, k = len(q), len(self.points)
        x = self.lifted(q, query=True)
        width = min(self.most, k)
        seen = np.zeros((n, k), bool)
        start = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(int))
        ids = np.tile(start, (n, 1))
        seen[:, start] = True
        dist = _distances(x, self.points[start])
        opened = np.zeros(ids.shape, bool)
        alive = np.arange(n)
        while len(alive):
            waiting = np.where(opened[alive], np.inf, dist[alive])
            pick = waiting.argmin(1)
            alive, pick = alive[np.isfinite(waiting[np.arange(len(alive)), pick])], pick[np.isfinite(waiting[np.arange(len(alive)), pick])]
            if not len(alive):
                break
            opened[alive, pick] = True
            ring = self.graph[ids[alive, pick]]
            new = ~seen[alive[:, None], ring]
            seen[alive[:, None], ring] = True
            d = np.full((n, ring.shape[1]), np.inf)
            d[alive] = np.where(new, np.sqrt(((self.points[ring] - x[alive, None, :]) ** 2).sum(2)), np.inf)
            more = np.zeros((n, ring.shape[1]), ids.dtype)
            more[alive] = ring
            ids, dist = np.concatenate([ids, more], 1), np.concatenate([dist, d], 1)
            opened = np.concatenate([opened, ~np.isfinite(d)], 1)
            if ids.shape[1] > width:
                keep = np.argpartition(dist, width - 1, 1)[:, :width]
                ids, dist, opened = (np.take_along_axis(a, keep, 1) for a in (ids, dist, opened))
        order = np.argsort(dist, 1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        ok = np.isfinite(dist) & ((dist <= self.ratio * dist[:, :1]) | (np.arange(ids.shape[1]) < LEAST_LISTS))
        rows, cols = np.nonzero(ok)
        return rows, ids[rows, cols]


def fit_centroids(sample: np.ndarray, total: int, norm2: float, seed: int = 7) -> Centroids:
    """Balanced centroids of a sample that stands for ``total`` vectors."""
    rng = np.random.default_rng(seed)
    holder = Centroids(np.zeros((1, sample.shape[1] + 1)), np.zeros((1, 1), np.int64), norm2)
    x = holder.lifted(sample)
    lists = max(1, min(MAX_LISTS, len(x) // 4, -(-total // LIST_ROWS)))
    points = np.stack([x[i].mean(0) for i in _bisect(x, max(1, -(-len(x) // lists)), rng)])
    for _ in range(3):
        near = np.concatenate([_distances(x[a : a + BLOCK], points).argmin(1) for a in range(0, len(x), BLOCK)])
        count = np.bincount(near, minlength=len(points))
        sums = np.zeros_like(points)
        np.add.at(sums, near, x)
        points = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], points)
    k = len(points)
    d = _distances(points, points)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1, kind="stable")[:, : min(DEGREE, max(1, k - 1))]
    ring = np.arange(k)[:, None]
    found = Centroids(points, np.concatenate([near, (ring + 1) % k, rng.integers(0, k, (k, 2))], 1), norm2)
    _calibrate(found, sample, rng)
    return found


def _calibrate(c: Centroids, sample: np.ndarray, rng: np.random.Generator, k: int = 20) -> None:
    """Sets how many lists, and within which ratio, a query has to visit to meet its neighbours in the sample."""
    asked = rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)
    parts = [c.lists_of(sample[a : a + 512]) for a in range(0, len(sample), 512)]
    rows = np.concatenate([r + 512 * i for i, (r, _) in enumerate(parts)])
    lists = np.concatenate([x for _, x in parts])
    first = np.searchsorted(rows, np.arange(len(sample) + 1))
    d = _distances(c.lifted(sample[asked], query=True), c.points)
    place = d.argsort(1, kind="stable").argsort(1, kind="stable")
    scores = sample[asked] @ sample.T
    needed, ratios = [], []
    for i, own in enumerate(asked.tolist()):
        scores[i, own] = -np.inf
        for n in np.argsort(-scores[i], kind="stable")[: min(k, len(sample) - 1)].tolist():
            of = lists[first[n] : first[n + 1]]
            best = of[place[i, of].argmin()]
            needed.append(place[i, best] + 1)
            ratios.append(d[i, best] / max(d[i].min(), 1e-12))
    if needed:
        c.most = max(LEAST_LISTS, int(np.quantile(needed, COVERED)) + 1)
        c.ratio = 1e-9 + float(np.quantile(ratios, 1 - (1 - COVERED) / 3))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass
class NeighbourIndex:
    """Posting lists ``(list, block, cid, v)`` over distinct vectors, the smallest ids of each, and the centroids."""

    centroids: Centroids | None
    rows: DataFrame
    heads: DataFrame
    postings: DataFrame | None
    blocks: dict[int, int]
    k: int


def _taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    v = v.where("forall(v, x -> x is not null and not isnan(x) and abs(x) <= 1.7976931348623157e308) and exists(v, x -> x <> 0)")
    return v.groupBy("vec_id").agg(F.min("v").alias("v"))


def build_index(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> NeighbourIndex:
    """Indexes every row. Null, zero and non-finite vectors and null ids take no part; nor do vectors of another length
    than the most frequent one. An id that is repeated counts once, with its smallest vector. An empty table gives an index
    that finds nothing; other columns are ignored."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    v = written(_taking_part(vectors, id_col, vector_col), "neighbours-vectors")
    lengths = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dim = lengths[0].d if lengths else 0
    v = v.where(F.size("v") == dim)
    classes = written(v.groupBy("v").agg(F.min("vec_id").alias("cid")), "neighbours-classes")
    rows = written(v.join(classes, "v").select("vec_id", "cid"), "neighbours-rows")
    spread = Window.partitionBy("cid", F.pmod("vec_id", F.lit(64))).orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(spread)).where(F.col("r") <= k + 1)
    first = Window.partitionBy("cid").orderBy("vec_id")
    few = few.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    heads = written(few.groupBy("cid").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "neighbours-heads")
    if not dim:
        return NeighbourIndex(None, rows, heads, None, {}, k)
    total, norm2 = classes.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    sample = classes.orderBy(F.xxhash64("cid"), "cid").limit(min(SAMPLE_ROWS, max(1, SAMPLE_NUMBERS // dim))).select("v").toArrow()
    centroids = fit_centroids(_matrix(sample.column(0).combine_chunks()), total, norm2)
    shared = spark.sparkContext.broadcast(centroids)  # MAX_LISTS points at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                at, lists = shared.value.lists_of(_matrix(part.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), part.column(1).take(pa.array(at)), part.column(0).take(pa.array(at))], ["list", "cid", "v"])

    assigned = written(classes.select("v", "cid").mapInArrow(assign, "list int, cid long, v array<double>"), "neighbours-postings")
    blocks = {r.list: -(-r.n // BLOCK) for r in assigned.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
    return NeighbourIndex(centroids, rows, heads, assigned, blocks, k)


def search(index: NeighbourIndex, queries: DataFrame) -> DataFrame:
    """The ``k`` nearest rows of every indexed row in ``queries(vec_id)``, its own left out.

    Returns ``(query_id, rank, vec_id, score)``: nearest first, ties to the smaller id, score the inner product in double
    precision. Queries that take no part in the index give no rows; a repeated query counts once.
    """
    spark = queries.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if index.centroids is None:
        return spark.createDataFrame([], schema)
    k, shared = index.k, spark.sparkContext.broadcast(index.centroids)
    asked = written(queries.select("vec_id").distinct().join(index.rows, "vec_id"), "neighbours-asked")
    distinct = asked.select("cid").distinct()
    # a class lies in one list at least, so its vector is found there
    of = index.postings.groupBy("cid").agg(F.first("v").alias("v")).join(distinct, "cid")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                at, lists = shared.value.visits(_matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at))], ["list", "qid", "q"])

    visits = written(of.select("cid", "v").mapInArrow(walk, "list int, qid long, q array<double>"), "neighbours-visits")
    loads = {r.list: -(-r.n // BLOCK) for r in visits.groupBy("list").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame([(x, index.blocks.get(x, 0), loads.get(x, 0)) for x in range(len(index.centroids.points))], "list int, pb int, qb int")
    plan = F.broadcast(plan.where("pb > 0 and qb > 0"))  # a row a list, MAX_LISTS at most
    left = visits.join(plan, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("b"), F.pmod(F.xxhash64("qid"), F.col("qb")).cast("int").alias("c"), "qid", "q")
    right = index.postings.join(plan, "list").select("list", F.pmod(F.xxhash64("cid"), F.col("pb")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("c"), "cid", "v")

    def compare(asks: pa.Table, posts: pa.Table) -> pa.Table:
        none = pa.table({"qid": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not asks.num_rows or not posts.num_rows:
            return none
        q, v = _matrix(asks["q"].combine_chunks()), _matrix(posts["v"].combine_chunks())
        qid, cid = asks["qid"].to_numpy(), posts["cid"].to_numpy()
        out = []
        for a in range(0, len(q), 512):
            s = q[a : a + 512] @ v.T
            if s.shape[1] > k + 1:
                bar = np.partition(s, -(k + 1), 1)[:, -(k + 1)]
                rows, cols = np.nonzero(s >= (bar - 1e-9 * np.abs(bar) - 1e-12)[:, None])  # ties stay, whatever the order of the sums
            else:
                rows, cols = (i.ravel() for i in np.indices(s.shape))
            score = np.concatenate([(q[a + rows[z : z + 8192]] * v[cols[z : z + 8192]]).sum(1) for z in range(0, len(rows), 8192)])
            order = np.lexsort((cid[cols], -score, rows))
            rows, cols, score = rows[order], cols[order], score[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            ok = place <= k
            out.append((qid[a + rows[ok]], cid[cols[ok]], score[ok]))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"qid": a, "cid": b, "score": c})

    met = left.groupBy("list", "b", "c").cogroup(right.groupBy("list", "b", "c")).applyInArrow(compare, "qid long, cid long, score double")
    best = met.groupBy("qid", "cid").agg(F.max("score").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    best = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    each = best.join(index.heads, "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    found = each.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qid")).join(found, "qid")
    listed = own.select("query_id", F.posexplode(F.expr(f"slice(filter(found, x -> x.vec_id <> query_id), 1, {k})")).alias("p", "x"))
    return listed.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op8_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row of ``embeddings`` whose id is divisible by 20, searched among all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(build_index(vectors), vectors.where("vec_id % 20 = 0").select("vec_id"))
