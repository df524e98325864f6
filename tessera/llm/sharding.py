"""Balanced shards by Karmarkar-Karp differencing.

Documents with equal texts form a group that is never divided. A partial partition is a tuple of ``shards`` sums; the
differencing step takes the two tuples of the largest spread (largest minus smallest sum) and adds the largest sum of one
to the smallest of the other, and so on. A task takes the groups it gets in blocks of ``BLOCK_GROUPS``, reduces each block to
one tuple, and then the tuples of its blocks to one; the driver combines one tuple for each task in the same way. A task
therefore holds one block and one tuple a block, and the driver sees ``shards`` numbers a task, never the groups.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, discard, written

SHARDS = 16
#: Groups that are differenced at once, and groups planned for a task.
BLOCK_GROUPS, TASK_GROUPS = 20_000, 500_000


def difference(tuples: list[list[int]], shards: int) -> tuple[list[int], list[list[int]]]:
    """Combines partial partitions until one is left.

    Returns its sums, largest first, and for each input tuple the shard that each of its entries went to. Ties are broken
    by input order, so that a task that runs again gives the same answer.
    """
    if not tuples:
        return [0] * shards, []
    sums, parts, heap = [], [], []
    for k, t in enumerate(tuples):
        order = sorted(range(shards), key=lambda i: (-t[i], i))
        values = [t[i] for i in order]
        sums.append(values)
        parts.append((k, order, None, None))
        heap.append((values[-1] - values[0], k))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        x, y = sums[a], sums[b]
        both = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(shards), key=lambda i: (-both[i], i))
        values = [both[i] for i in order]
        k = len(sums)
        sums.append(values)
        sums[a] = sums[b] = None
        parts.append((None, order, a, b))
        heapq.heappush(heap, (values[-1] - values[0], k))
    root = heap[0][1]
    placed: list[list[int]] = [[]] * len(tuples)
    stack = [(root, list(range(shards)))]  # node and the shard of each of its sorted entries
    while stack:
        node, where = stack.pop()
        k, order, a, b = parts[node]
        at = [0] * shards  # by entry before sorting
        for place, i in enumerate(order):
            at[i] = where[place]
        if k is not None:
            placed[k] = at
        else:
            stack.append((a, at))
            stack.append((b, at[::-1]))
    return sums[root], placed


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Puts every row into one of ``shards`` shards of nearly equal bytes, rows of equal text together.

    Returns ``(doc_id, size, text_crc32, shard, slot)`` for each input row: size is the UTF-8 bytes of the text plus 1,
    slot the row's place in its shard, gapless from 0. A null text counts as an empty one, in size and in its group; null
    and repeated ids keep their rows; an empty table gives an empty result. A group larger than a fair share fills its
    shard alone and the rest is balanced over the others. Other columns are ignored. Texts stay where they are read: only
    digests are shuffled, pre-aggregated to a row for each distinct text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"))
    groups = rows.groupBy("key").agg(F.sum("size").alias("total"))

    written_groups = written(groups, "shards-totals")
    tasks = max(spark.sparkContext.defaultParallelism, -(-written_groups.count() // TASK_GROUPS))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "part", "block", "entry", "task_entry", "task_sum"]
        part, block, sums = TaskContext.get().partitionId(), 0, []
        keys: list[bytes] = []
        totals: list[int] = []

        def reduced() -> pa.RecordBatch:
            order = sorted(range(len(keys)), key=lambda i: (-totals[i], keys[i]))
            found, placed = difference([[totals[i]] + [0] * (shards - 1) for i in order], shards)
            sums.append(found)
            n = len(order)
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in order], pa.binary()), pa.array([part] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array([p[0] for p in placed], pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names)

        for b in batches:
            for a in range(0, b.num_rows, BLOCK_GROUPS):
                some = b.slice(a, BLOCK_GROUPS)
                keys += some.column(0).to_pylist()
                totals += some.column(1).to_pylist()
                if len(keys) >= BLOCK_GROUPS:
                    yield reduced()
                    keys, totals, block = [], [], block + 1
        if keys:
            yield reduced()
        if sums:  # what each block's entries become in the task's tuple, and that tuple's sums
            found, where = difference(sums, shards)
            own, entry, to = zip(*[(k, e, w[e]) for k, w in enumerate(where) for e in range(shards)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.binary()), pa.array([part] * len(own), pa.int32()), pa.array(own, pa.int32()), pa.array(entry, pa.int32()), pa.array(to, pa.int32()), pa.array([found[t] for t in to], pa.int64())], names)

    placed = written(written_groups.repartition(tasks).mapInArrow(local, "key binary, part int, block int, entry int, task_entry int, task_sum long"), "shards-groups")
    discard(written_groups)
    blocks = placed.where("key is null").select("part", "block", "entry", "task_entry", "task_sum")
    partial: dict[int, list[int]] = {}
    for r in blocks.groupBy("part", "task_entry").agg(F.first("task_sum").alias("s")).collect():  # shards rows a task
        partial.setdefault(r.part, [0] * shards)[r.task_entry] = r.s
    ids = sorted(partial)
    _, where = difference([partial[p] for p in ids], shards)
    final = [(p, e, where[k][e]) for k, p in enumerate(ids) for e in range(shards)]
    table = spark.createDataFrame(final, "part int, task_entry int, shard int")
    shard_of = blocks.join(F.broadcast(table), ["part", "task_entry"]).select("part", "block", "entry", "shard")  # shards rows a task: a few MB for any cluster
    owner = placed.where("key is not null").join(shard_of, ["part", "block", "entry"]).select("key", "shard")
    located = rows.join(owner, "key").select("doc_id", "size", "text_crc32", "shard")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * shards
        for b in batches:
            ranks = []
            for s in b.column(3).to_pylist():
                ranks.append(seen[s])
                seen[s] += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(ranks, pa.int64())], ["doc_id", "size", "text_crc32", "shard", "part", "rank"])

    ranked = written(located.mapInArrow(number, "doc_id long, size long, text_crc32 long, shard int, part int, rank long"), "shards-rows")
    counts = ranked.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return ranked.join(bases, ["part", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).alias("slot"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of ``balanced_shards`` over the whole ``documents`` table, under the law of equal bytes."""
    found = balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
