"""Exact-substring removal with suffix arrays.

Every string of ``length`` bytes that starts at two places is removed at both. Whether such a string repeats is decided by
suffix arrays over shards. What goes into the shards:

1. Each string of ``length`` bytes has an anchor, the leftmost of its smallest ``GRAM``-byte grams by hash. Equal strings
   have equal anchors at equal places. The consecutive strings of a text that share an anchor form a piece. All of a
   text's strings lie in exactly one piece each, about one piece for 85 strings. Where a text repeats itself at once, a piece
   follows its equal; such a run is one entry with a count.
2. Pieces are counted by anchor, pre-aggregated before the shuffle. A piece whose anchor is met once holds no repeated
   string and goes no further; equal pieces (same anchor, same digest) are one entry with a count.
3. Pieces that share an anchor but differ come together in a shard with their bytes. The shard's suffix array is built by
   Larsson-Sadakane refinement in numpy, common prefixes by Kasai's walk, and strings whose common prefix with a neighbour
   reaches ``length`` repeat. An anchor with more bytes than ``HOT_BYTES`` is dealt over several shards; each then hands on
   its distinct strings as a sorted run for each of a number of ranges, and two runs at a time are merged by binary search
   until a range has one. Runs hold 128-bit digests of the strings: a piece has some 85 strings of 200 bytes each, which as
   they are would take twelve times the room. So a passage in a third of all documents is spread over as many tasks as it
   needs.

Repeated strings are united to byte ranges for each document, and the ranges are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, discard, written

LENGTH = 200
GRAM = 32
#: Bytes that are hashed as one numpy block, bytes planned for a shard, bytes of an anchor beyond which it is dealt out.
BLOCK, SHARD_BYTES, HOT_BYTES = 1 << 18, 1 << 19, 1 << 18
#: Positions of a shard at most: three numbers of 21 bits fit in one 63-bit sort key. Larger groups are cut in parts.
MOST = (1 << 21) - 1
#: Ranges of digests that the strings of a divided anchor are merged in, for each of its shards.
LANES = 4
_BASE = 0x9E3779B97F4A7C15  # any odd number will do
#: A spot in 63 bits: how often a piece follows itself, less one (16 bits), its start (31 bits) and its width (16 bits).
_WIDTH_BITS, _AGAIN_SHIFT, _MOST_AGAIN = 16, 47, 1 << 16
_ADDED = ("n_bytes", "n_removed", "n_spans", "kept", "kept_text")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(n, _BASE, np.uint64)
    base[0] = 1
    inverse = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(base), np.cumprod(inverse)


_POWERS: list = []


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``GRAM`` bytes, by prefix sums of a polynomial modulo 2^64 and a final mix."""
    if not _POWERS:
        _POWERS.extend(_powers(2 * BLOCK + GRAM))
    up, down = _POWERS
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:n])))
        h = (total[GRAM:] - total[:-GRAM]) * up[: n - GRAM + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def _window_least(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` consecutive numbers, from running minima of blocks in both directions."""
    n = len(x)
    pad = -n % w
    full = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    left = np.minimum.accumulate(full, 1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def pieces_of(data: np.ndarray, owner: np.ndarray | None, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, start, width)`` of the pieces of a block; strings that reach over a change of ``owner`` don't exist."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(data)
    low = np.uint64((1 << 20) - 1)
    marked = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    at = (_window_least(marked, length - GRAM + 1) & low).astype(np.int64)
    cut = np.concatenate(([True], at[1:] != at[:-1]))
    if owner is not None:
        inside = owner[: n - length + 1] == owner[length - 1 :]
        cut |= np.concatenate(([True], inside[1:] != inside[:-1]))
    starts = np.flatnonzero(cut)
    widths = np.diff(np.concatenate((starts, [len(at)])))
    if owner is not None:
        ok = inside[starts]
        starts, widths = starts[ok], widths[ok]
    return h[at[starts]], starts, widths


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array by Larsson-Sadakane refinement: ranks by the first bytes, then, in turns that double the depth, only the
    suffixes whose group isn't single yet are sorted, by the rank of what follows. A suffix that ends is the smaller."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    bits = 21
    keys = np.zeros(n, np.uint64)
    padded = np.concatenate((data.astype(np.uint64) + np.uint64(1), np.zeros(4, np.uint64)))
    depth = 4
    for k in range(depth):
        keys = keys * np.uint64(257) + padded[k : k + n]
    order = np.sort((keys << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    sa = (order & np.uint64(MOST)).astype(np.int64)
    group = order >> np.uint64(bits)
    rank = np.zeros(n + 1, np.int64)  # a suffix's group: the last place of the group in the array, counted from 1; 0 past the end
    last = np.concatenate((group[1:] != group[:-1], [True]))
    ends = np.flatnonzero(last)
    rank[sa] = np.repeat(ends + 1, np.diff(np.concatenate(([-1], ends))))
    firsts = np.concatenate(([0], ends[:-1] + 1))
    open_places = np.flatnonzero(np.repeat(ends > firsts, ends - firsts + 1))
    while len(open_places):
        who = sa[open_places]
        after = rank[np.minimum(who + depth, n)]
        keys = (rank[who].astype(np.uint64) << np.uint64(2 * bits)) | (after.astype(np.uint64) << np.uint64(bits)) | who.astype(np.uint64)
        keys.sort()  # groups keep their places: a group's rank is its last place
        who = (keys & np.uint64(MOST)).astype(np.int64)
        sa[open_places] = who
        pair = keys >> np.uint64(bits)
        last = np.concatenate((pair[1:] != pair[:-1], [True]))
        ends = np.flatnonzero(last)
        sizes = np.diff(np.concatenate(([-1], ends)))
        rank[who] = np.repeat(open_places[ends] + 1, sizes)
        open_places = open_places[np.repeat(sizes > 1, sizes)]
        depth *= 2
    return sa


def common_prefixes(data: np.ndarray, before: np.ndarray, limit: np.ndarray, cap: int, lanes: int = 2048) -> np.ndarray:
    """Kasai's walk: for each position i the common prefix of i and ``before[i]`` (-1: none), at most ``cap`` and at most what
    ``limit`` leaves to either. Lanes of consecutive positions go in step; each starts a position with one less than the
    last one's prefix, if the successor of the other position still has ``cap`` bytes, and so stands in the order."""
    n = len(data)
    out = np.zeros(n, np.int64)
    size = -(-n // min(lanes, max(1, n)))
    at = np.arange(0, n, size)
    stop = np.minimum(at + size, n)
    have = np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        most = np.where(other >= 0, np.minimum(np.minimum(limit[at], limit[other]), cap), 0)
        have = np.minimum(have, most)
        a, b = np.minimum(at + have, n - 1), np.minimum(np.maximum(other, 0) + have, n - 1)
        grows = (have < most) & (data[a] == data[b])
        done = ~grows
        have = have + grows
        if done.any():
            i, j, h = at[done], other[done], have[done]
            out[i] = h
            have[done] = np.where((j >= 0) & (limit[np.maximum(j, 0)] > cap), np.maximum(h - 1, 0), 0)
            at[done] += 1
            alive = at < stop
            if not alive.all():
                at, stop, have = at[alive], stop[alive], have[alive]
    return out


def repeated_strings(parts: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each part, which of its strings of ``length`` bytes occur twice in all parts together, and which of them are the
    first of their kind in suffix order."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    limit = np.repeat(ends, sizes) - np.arange(len(data))  # bytes to the end of the part
    sa = suffix_array(data)
    valid = sa[limit[sa] >= length]
    before = np.full(len(data), -1, np.int64)
    before[valid[1:]] = valid[:-1]
    same = common_prefixes(data, before, limit, length) >= length
    again = np.zeros(len(data), bool)
    again[same] = True
    again[before[same]] = True
    first = np.zeros(len(data), bool)
    first[valid] = ~same[valid]
    starts = ends - sizes
    return [again[a : a + max(0, z - length + 1)] for a, z in zip(starts, sizes, strict=True)], [first[a : a + max(0, z - length + 1)] for a, z in zip(starts, sizes, strict=True)]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    starts = np.flatnonzero(edge == 1)
    return starts, np.flatnonzero(edge == -1) - starts


def _spot(start: int, width: int) -> int:
    """The spot of a run of strings that isn't followed by itself."""
    return (start << _WIDTH_BITS) | width


def _list_pieces(docs: DataFrame, length: int) -> DataFrame:
    """``(anchor, digest, k, spot)`` of every piece of ``docs(k, t)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(texts, keys, offsets):
            raw = b"".join(texts)
            data = np.frombuffer(raw, np.uint8)
            owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts]) if len(texts) > 1 else None
            anchor, start, width = pieces_of(data, owner, length)
            of = owner[start] if owner is not None else np.zeros(len(start), np.int64)
            first = np.cumsum([0, *[len(t) for t in texts]])[:-1]
            place = start - first[of] + np.array(offsets)[of]
            digest = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:z]) for a, z in zip(start.tolist(), (start + width + length - 1).tolist(), strict=True)), np.uint64, len(start))
            follows = (anchor[1:] == anchor[:-1]) & (digest[1:] == digest[:-1]) & (of[1:] == of[:-1]) & (width[1:] == width[:-1]) & (start[1:] == start[:-1] + width[:-1])
            head = np.concatenate(([True], ~follows))[: len(start)]
            since = np.arange(len(start)) - np.maximum.accumulate(np.where(head, np.arange(len(start)), 0))
            head |= since % _MOST_AGAIN == 0
            first_of = np.flatnonzero(head)
            again = np.diff(np.concatenate((first_of, [len(start)]))) - 1
            anchor, digest, of, place, width = (x[first_of] for x in (anchor, digest, of, place, width))
            spot = (again << _AGAIN_SHIFT) | (place << _WIDTH_BITS) | width
            return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(np.array(keys, np.int64)[of]), pa.array(spot)], ["anchor", "digest", "k", "spot"])

        held, size = ([], [], []), 0
        for b in batches:
            for k, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for a in range(0, max(1, len(t) - length + 1), BLOCK - length + 1):  # blocks of a long text overlap by one string less a byte
                    part = t[a : a + BLOCK]
                    if size + len(part) > BLOCK and size:
                        yield flush(*held)
                        held, size = ([], [], []), 0
                    for x, v in zip(held, (part, k, a), strict=True):
                        x.append(v)
                    size += len(part)
        if size:
            yield flush(*held)

    return docs.where(F.octet_length("t") >= length).mapInArrow(run, "anchor long, digest long, k long, spot long")


def _shards(pieces: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Suffix arrays over ``pieces(shard, deal, anchor, k, spot, bytes)``: repeated runs ``(k, spot)``, and for divided anchors
    the sorted runs of the merge ``(anchor, lane, digests, ks, spots)``, a row a range."""

    def run(table: pa.Table) -> pa.Table:
        ks, spots, anchors, deals, parts = (list(x) for x in zip(*sorted(zip(*(table[c].to_pylist() for c in ("k", "spot", "anchor", "deal", "bytes")), strict=True)), strict=True))
        out_k, out_spot = [], []
        lanes: dict[tuple[int, int, int], list[tuple[bytes, int, int]]] = {}
        a = 0
        while a < len(parts):  # a shard is planned to hold far less than MOST; what is above is done in parts, which the merge unites
            z, total = a, 0
            while z < len(parts) and (z == a or total + len(parts[z]) <= MOST):
                total += len(parts[z])
                z += 1
            again, first = repeated_strings(parts[a:z], length)
            for i in range(a, z):
                start = (spots[i] >> _WIDTH_BITS) & 0x7FFFFFFF
                for s, n in zip(*(x.tolist() for x in _runs(again[i - a])), strict=True):
                    out_k.append(ks[i])
                    out_spot.append(_spot(start + s, n))
                if deals[i] or z - a < len(parts):
                    many = LANES * max(4, deals[i])
                    for s in np.flatnonzero(first[i - a]).tolist():
                        d = xxhash.xxh3_128_digest(parts[i][s : s + length])
                        lanes.setdefault((anchors[i], int.from_bytes(d[:8], "big") * many >> 64, a), []).append((d, ks[i], _spot(start + s, 1)))
            a = z
        n = len(out_k)
        ranges = [(key, sorted(found)) for key, found in sorted(lanes.items())]
        return pa.table({
            "k": pa.array(out_k + [None] * len(ranges), pa.int64()),
            "spot": pa.array(out_spot + [None] * len(ranges), pa.int64()),
            "anchor": pa.array([None] * n + [key[0] for key, _ in ranges], pa.int64()),
            "lane": pa.array([None] * n + [key[1] for key, _ in ranges], pa.int32()),
            "digests": pa.array([None] * n + [b"".join([d for d, _, _ in x]) for _, x in ranges], pa.binary()),
            "ks": pa.array([None] * n + [[k for _, k, _ in x] for _, x in ranges], pa.list_(pa.int64())),
            "spots": pa.array([None] * n + [[s for _, _, s in x] for _, x in ranges], pa.list_(pa.int64())),
        })

    found = written(pieces.groupBy("shard").applyInArrow(run, "k long, spot long, anchor long, lane int, digests binary, ks array<long>, spots array<long>"), "suffixes-shards")
    return found.where("lane is null").select("k", "spot"), found.where("lane is not null")


def _merge(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    """Two sorted runs ``high, low, k, spot, twice`` as one. The place of each string of ``y`` in ``x`` is found by binary
    search, and strings that both have are marked."""
    left, right = np.searchsorted(x[0], y[0], "left"), np.searchsorted(x[0], y[0], "right")
    for j in np.flatnonzero(left < right).tolist():
        for i in range(left[j], right[j]):
            if x[1][i] == y[1][j]:
                x[4][i] = y[4][j] = True
    return [np.insert(p, right, q) for p, q in zip(x, y, strict=True)]


def _merged(lanes: DataFrame) -> DataFrame:
    """Strings of divided anchors that two runs have: the runs of a range are merged two by two."""

    def run(table: pa.Table) -> pa.Table:
        runs = []
        for d, k, spot in zip(*(table[c].to_pylist() for c in ("digests", "ks", "spots")), strict=True):
            key = np.frombuffer(d, ">u8").reshape(-1, 2).astype(np.uint64)
            runs.append([key[:, 0], key[:, 1], np.array(k, np.int64), np.array(spot, np.int64), np.zeros(len(key), bool)])
        while len(runs) > 1:
            runs = [_merge(*runs[a : a + 2]) if a + 1 < len(runs) else runs[a] for a in range(0, len(runs), 2)]
        _, _, ks, spots, twice = runs[0]
        return pa.table({"k": ks[twice], "spot": spots[twice]})

    return lanes.groupBy("anchor", "lane").applyInArrow(run, "k long, spot long")


def _cut(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """``(row, n_bytes, n_removed, n_spans, kept, kept_text)``, ``row`` being the whole row of ``docs``."""
    if not GRAM <= length < GRAM + (1 << _WIDTH_BITS) - 1:
        raise ValueError("length is out of range")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("k")), "suffixes-rows")
    bare = rows.select("k", F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
    pieces = written(_list_pieces(bare, length), "suffixes-pieces")
    times = F.sum(F.shiftright("spot", _AGAIN_SHIFT) + 1).alias("n")
    anchors = pieces.groupBy("anchor").agg(times, F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("n > 1")
    anchors = written(anchors, "suffixes-anchors").hint("merge")  # sorted joins are split where an anchor or a piece is hot
    shared = written(pieces.join(anchors, "anchor").select("anchor", "digest", "k", "spot", (F.col("d0") != F.col("d1")).alias("mixed")), "suffixes-shared")
    discard(pieces, anchors)
    mixed = shared.where("mixed").groupBy("anchor", "digest").agg(times, F.min(F.struct("k", "spot")).alias("one"))
    mixed = written(mixed.select("anchor", "digest", "n", "one.k", "one.spot"), "suffixes-mixed")
    copies = shared.where("not mixed").select("k", "spot").union(shared.where("mixed").join(mixed.where("n > 1").select("anchor", "digest").hint("merge"), ["anchor", "digest"]).select("k", "spot"))
    width = F.col("spot").bitwiseAND(F.lit((1 << _WIDTH_BITS) - 1).cast("long"))
    sized = mixed.withColumn("b", width + F.lit(length - 1))
    loads = sized.groupBy("anchor").agg(F.sum("b").alias("load"))
    total = loads.agg(F.sum("load")).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_BYTES))
    hot = written(loads.where(F.col("load") > HOT_BYTES).select("anchor", F.ceil(F.col("load") / HOT_BYTES).cast("int").alias("deal")), "suffixes-hot")
    dealt = sized.join(hot, "anchor", "left")
    salt = F.pmod(F.xxhash64("k", "spot"), F.coalesce("deal", F.lit(1)))
    asked = dealt.select("k", "spot", "anchor", F.coalesce("deal", F.lit(0)).alias("deal"), F.when(F.col("deal").isNull(), F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(F.xxhash64("anchor", salt)).alias("shard"))
    start = F.expr(f"cast(shiftright(spot, {_WIDTH_BITS}) & 2147483647 as int)")
    texts = bare.where(F.octet_length("t") >= length)
    wanted = asked.groupBy("k").agg(F.collect_list(F.struct("spot", "anchor", "deal", "shard")).alias("asks"))  # no more than a text has pieces
    cut = texts.join(wanted, "k").select("k", "t", F.explode("asks").alias("a")).select("k", "t", "a.*")
    cut = cut.select("shard", "deal", "anchor", "k", "spot", F.substring("t", start + 1, (width + F.lit(length - 1)).cast("int")).alias("bytes"))
    runs, lanes = _shards(cut, length)
    discard(hot)
    found = copies.union(runs).union(_merged(lanes))
    spans = found.groupBy("k").agg(F.collect_list("spot").alias("spots"))  # no more than a text has strings
    whole = rows.select("row", "k", F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
    joined = whole.join(spans, "k", "left").select("row", "t", "spots")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n, removed, count = [], [], [], []
            for t, spots in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n.append(len(t))
                if not spots:
                    kept.append(t)
                    removed.append(0)
                    count.append(0)
                    continue
                s = np.array(spots, np.int64)
                a = (s >> _WIDTH_BITS) & 0x7FFFFFFF
                edge = np.zeros(len(t) + 1, np.int64)
                np.add.at(edge, a, 1)
                np.add.at(edge, a + (s & ((1 << _WIDTH_BITS) - 1)) * ((s >> _AGAIN_SHIFT) + 1) + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept.append(np.frombuffer(t, np.uint8)[~gone].tobytes())
                removed.append(int(gone.sum()))
                count.append(len(_runs(gone)[0]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())], ["row", "n_bytes", "n_removed", "n_spans", "kept", "kept_text"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("row", whole.schema["row"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(take, schema)


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Every row of ``docs`` without the bytes of strings of ``length`` bytes that start at two places or more.

    Adds ``n_bytes``, ``n_removed``, ``n_spans`` (removed runs), ``kept`` (binary: the remaining bytes) and ``kept_text`` (the
    same as a string, without characters that a cut goes through) to the columns of ``docs``. Texts count as UTF-8 bytes, a
    null text as an empty one; strings never reach over two rows, are judged on the
    input, and may overlap. Rows are told apart by numbers that a written copy of ``docs`` gives them, whatever their ids:
    those that repeat an id, or have none, are rows of their own, and those that repeat a text repeat each other. An empty
    table gives an empty result. Columns of ``docs`` keep their names, whatever they are; the five new names replace such
    columns. ``length`` is ``GRAM`` at least.
    """
    found = _cut(docs, text_col, length)
    names = [c for c in docs.columns if c not in _ADDED]
    return found.select(*[F.col("row").getField(c).alias(c) for c in names], *_ADDED)


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` with what is left of their texts, as ``remove_repeats`` finds it, all other columns as they are,
    whatever their names. A null text becomes an empty one."""
    found = _cut(docs, text_col, length)
    return found.select(*[F.col("kept_text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def op2_suffixes(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of ``remove_repeats`` over the whole ``documents`` table."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
