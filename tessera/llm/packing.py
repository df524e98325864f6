"""Packing of tokenised documents into windows by minimum bin slack.

A document is cut into full windows and a rest. The rests are described by their histogram: how many there are of each
length, at most ``window - 1`` numbers however many documents there are. For each new window the longest remaining rest is
fixed, and a subset-sum program over bitsets finds the multiset of the others that comes closest to the capacity; the
counts used are read back from the stored bitsets, and the same multiset is repeated as often as the histogram allows.
Rests then find their window by rank within their length, without any of them leaving its task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, written
from tessera.llm.tokens import encoder_of

WINDOW = 1024
END_ID = 0
_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is the largest that doesn't exceed ``capacity``.

    Bit s of the running bitset says that a sum of s can be made. The bitset before each group of equal lengths is kept;
    the way back takes as few of the later lengths as reach the sum.
    """
    keep, made, full = [], 1, (1 << (capacity + 1)) - 1
    lengths = sorted((x for x in counts if x <= capacity and counts[x] > 0), reverse=True)
    done = []
    for x in lengths:
        keep.append(made)
        done.append(x)
        left, k = min(counts[x], capacity // x), 1
        while left > 0:  # binary splitting: 1, 2, 4, ... copies and what is left over
            take = min(k, left)
            made |= (made << (take * x)) & full
            left -= take
            k *= 2
        if made >> capacity & 1:
            break
    at, used = made.bit_length() - 1, {}
    for x, before in zip(reversed(done), reversed(keep), strict=True):
        n = 0
        while not before >> at & 1:
            at -= x
            n += 1
        if n:
            used[x] = n
    return used


def patterns(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """``(multiset, times)`` until the histogram is used up; each turn empties a length at least, or nearly so."""
    left, out = {x: n for x, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = fullest(left, window - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[x] // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((used, times))
    return out


def places(found: list[tuple[dict[int, int], int]]) -> tuple[dict[int, tuple[list[int], list[tuple[int, int, int]]]], int]:
    """For each length: the first rank of every pattern that uses it, with (first window, offset, number in a window)."""
    out: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for used, times in found:
        offset = 0
        for x in sorted(used, reverse=True):
            ranks, what = out.setdefault(x, ([], []))
            ranks.append(taken.get(x, 0))
            what.append((first, offset, used[x]))
            taken[x] = taken.get(x, 0) + used[x] * times
            offset += used[x] * x
        first += times
    return out, first


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, window: int, end_id: int, keeps_space: bool) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, part, rank)``: rank counts, in this task, pieces of the same length."""
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = encoder_of(tokenizer_path, keeps_space), TaskContext.get().partitionId(), [0] * (window + 1)
        for b in batches:
            rows = []
            for i, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1)), strict=True):
                ids = np.concatenate((ids, end))
                n = len(ids)
                for a in range(0, n, window):
                    z = min(n, a + window)
                    rows.append((i, a, z - a, zlib.crc32(ids[a:z]), n, part, seen[z - a]))
                    seen[z - a] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, [pa.int64()] * 5 + [pa.int32(), pa.int64()], strict=True)], [*_PIECE, "part", "rank"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, keeps_space: bool = True) -> DataFrame:
    """Packs every document into sequences of at most ``window`` tokens.

    Returns ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, one row a piece; each token of a
    document, its end id included, lies in exactly one piece, and the pieces of a sequence fill it from offset 0 without a
    gap. A null text counts as an empty one and is the end id alone; null and repeated ids keep their rows, an empty table
    gives no piece, other columns are ignored. Texts are read whole; only piece descriptions are written and shuffled.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    cut = written(pieces(docs, tokenizer_path, id_col, text_col, window, end_id, keeps_space), "packing-pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most window rows
    histogram.pop(window, None)
    table, bins = places(patterns(histogram, window))
    table[window] = ([0], [(bins, 0, 1)])  # a full window is a sequence of its own
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["part", "length"]).select(*_PIECE, (F.col("base") + F.col("rank")).alias("rank"))
    shared = spark.sparkContext.broadcast(table)  # one entry for each pattern and length: bounded by the window, not by the data

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            ids, offsets = [], []
            for x, rank in zip(b.column(2).to_pylist(), b.column(5).to_pylist(), strict=True):
                ranks, what = known[x]
                k = bisect_right(ranks, rank) - 1
                first, offset, n = what[k]
                turn, which = divmod(rank - ranks[k], n)
                ids.append(first + turn)
                offsets.append(offset + which * x)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], [*_PIECE, "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of ``pack`` over the whole ``documents`` table."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
