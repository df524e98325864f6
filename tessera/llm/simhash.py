"""SimHash near-duplicates by anchor-point covering.

A fingerprint of 64 bits is cut into blocks of equal width. If two fingerprints differ in at most ``max_bits`` bits, one
block of theirs differs in at most ``max_bits // blocks`` bits. In each block the anchors are the words of a covering code:
a Hamming code of length 2^r - 1 (perfect, covering radius 1) with the last bit left free. A block value goes to every
anchor within covering radius plus threshold of it, and is at home at the nearest one. Any two values within the threshold
therefore meet at the home anchor of either, and fingerprints are compared only there. An anchor with very many members is
divided into cells of a bounded size.

``one_of_each`` finds texts by the similarity of their sets of shingles. At 0.8 every seventh bit differs, so blocks have to
be short, and anchors of short blocks gather texts that have nothing in common. An anchor is therefore divided by the
smallest hashes of a set's shingles, which similar sets share and others don't. What meets there and has near fingerprints
is compared by the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, connected_components, discard, free_name, written

BITS = 64
SEED = 42
#: Members of one anchor that are compared as one numpy block, and members beyond which an anchor is divided into cells.
COMPARE, MEMBERS = 256, 4096
#: Distinct fingerprints whose anchors a task works out.
TASK_FPS = 50_000
#: Sets of shingles: words of a fingerprint, bits of a block, blocks with anchors of their own, smallest hashes that divide
#: an anchor. At a similarity of 0.8 a block is within one bit of the other's with probability 0.65, and the three smallest
#: hashes are the same with 0.51; in one of 12 blocks both hold for all but 8 in 1000 pairs, and most of those that are two
#: bits apart meet as well, which leaves about 1 in 1000.
WORDS, BLOCK, TABLES, MINIMA = 2, 8, 12, 3
#: Bits of 128 that sets of that similarity may differ in: 19 on average with a deviation of 4, where unlike ones have 64.
MOST_BITS = 44
#: Bytes of sets that are compared in one cell of a divided anchor.
CELL_BYTES = 16 << 20
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values: the primes of XXH64

_NOT_SPACE = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_slices(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[starts[i]:ends[i]] for all i at once; slices of 32 bytes or more go through the library one by one."""
    lengths = ends - starts
    padded = np.frombuffer(data + bytes(16), np.uint8)
    u64 = np.ndarray((len(padded) - 8,), "<u8", padded, strides=(1,))
    u32 = np.ndarray((len(padded) - 8,), "<u4", padded, strides=(1,))
    with np.errstate(over="ignore"):
        h = np.uint64(seed) + _P5 + lengths.astype(np.uint64)
        at = starts.copy()
        left = lengths.copy()
        for _ in range(3):
            i = np.flatnonzero(left >= 8)
            if not len(i):
                break
            p = at[i]
            h[i] = _rot(h[i] ^ (_rot(u64[p] * _P2, 31) * _P1), 27) * _P1 + _P4
            at[i] += 8
            left[i] -= 8
        i = np.flatnonzero(left >= 4)
        h[i] = _rot(h[i] ^ (u32[at[i]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[i] += 4
        left[i] -= 4
        for _ in range(3):
            i = np.flatnonzero(left > 0)
            if not len(i):
                break
            h[i] = _rot(h[i] ^ (padded[at[i]].astype(np.uint64) * _P5), 11) * _P1
            at[i] += 1
            left[i] -= 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    for k in np.flatnonzero(lengths >= 32).tolist():
        h[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]], seed)
    return h


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """A hash for another word of a fingerprint, made of the first one's; word 0 is the hash itself."""
    if not word:
        return h
    with np.errstate(over="ignore"):
        h = h + np.uint64(word) * _P1
        h = (h ^ (h >> np.uint64(30))) * _P2
        h = (h ^ (h >> np.uint64(27))) * _P3
        return h ^ (h >> np.uint64(31))


def _spans(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text with A-Z in lower case, and where its words start and end."""
    data = text.lower()
    inside = np.concatenate(([False], _NOT_SPACE[np.frombuffer(data, np.uint8)], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return data, edges[::2], edges[1::2]


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the numbers have each bit set, the highest first."""
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def fingerprint(text: bytes, shingle_words: int = 3, step: int = 1 << 16) -> int:
    """SimHash of the whole text in 64 bits; zero if it has no words. Shingles are hashed ``step`` at a time."""
    found = text.lower().split()
    if not found:
        return 0
    data = b" ".join(found)
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(data)]))
    k = min(shingle_words, len(found))
    starts, ends = starts[: len(found) - k + 1], ends[k - 1 :]
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(starts), step):
        ones += _bit_counts(xxh64_slices(data, starts[a : a + step], ends[a : a + step]))
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row, fp being the signed 64-bit form; a null text has no words."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t or b"", shingle_words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def _block_columns(blocks: int) -> tuple[int, int]:
    width = BITS // blocks
    r = width.bit_length() - 1
    if blocks * width != BITS or 1 << r != width:
        raise ValueError("blocks must be a power of two")
    return width, r


def anchor_rows(fps: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """``fps`` with ``(anchor, home)``: every anchor within covering radius plus threshold of each block of ``fp``.

    With a threshold of t bits in a block the anchors lie within 1 + t; t of 0 and 1 are built here. A value of syndrome
    s is turned into the anchors by flipping sets of positions that add up to s: the set {s}, and for t = 1 also the pairs
    {a, a xor s}; with the free bit flipped, one bit less is left. All in DataFrame functions. With ``max_bits`` of twice
    ``blocks`` or more, only links with one block within 1 bit are sure to meet.
    """
    width, r = _block_columns(blocks)
    t = min(1, max_bits // blocks)
    n = width - 1  # length of the Hamming code; position p is bit p - 1, the free bit is bit n
    rows = []
    for b in range(blocks):
        value = F.shiftrightunsigned("fp", b * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        checks = [F.shiftleft(F.bit_count(value.bitwiseAND(F.lit(sum(1 << (p - 1) for p in range(1, n + 1) if p >> j & 1)).cast("long"))).bitwiseAND(F.lit(1)), j) for j in range(r)]
        syndrome = checks[0]
        for c in checks[1:]:
            syndrome = syndrome + c
        rows.append(F.struct(F.lit(b).alias("b"), value.alias("x"), syndrome.alias("s")))
    one = F.lit(1).cast("long")
    flip = lambda s: F.when(s == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, cast(s - 1 as int))"))
    kept = fps.columns
    base = fps.select(*kept, F.explode(F.array(*rows)).alias("e")).select(*kept, "e.b", "e.x", "e.s").withColumn("near", F.col("x").bitwiseXOR(flip(F.col("s"))))
    sets = f"array(struct(near as c, true as home))"
    if t:
        pairs = ",".join(f"struct(x ^ {1 << (a - 1)}L ^ shiftleft(1L, ({a} ^ s) - 1) as c, false as home, {a} < ({a} ^ s) and {a} <> s as ok)" for a in range(1, n + 1))
        free = f"array(struct(near ^ {1 << n}L as c, false as home))"
        sets = f"concat({sets}, {free}, if(s = 0, cast(array() as array<struct<c: bigint, home: boolean>>), transform(filter(array({pairs}), p -> p.ok), p -> struct(p.c as c, p.home as home))))"
    spread = base.select(*kept, "b", F.explode(F.expr(sets)).alias("a"))
    anchor = F.col("a.c").bitwiseOR(F.shiftleft(F.col("b").cast("long"), width)) if width < BITS else F.col("a.c")
    return spread.select(anchor.alias("anchor"), F.col("a.home").alias("home"), *kept)


def _forest(fps: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between the members of one anchor, one of each pair being at home there."""
    n, words = len(fps), fps.view(np.uint64)
    label = np.arange(n)
    heads, tails = [], []
    hs = np.flatnonzero(home)
    for a in range(0, len(hs), COMPARE):
        left = hs[a : a + COMPARE]
        for c in range(0, n, COMPARE):
            z = min(n, c + COMPARE)
            near = np.bitwise_count(words[left][:, None] ^ words[None, c:z]) <= max_bits
            for x in np.flatnonzero((near & (label[left][:, None] != label[None, c:z])).any(1)).tolist():
                i = left[x]
                ys = np.flatnonzero(near[x])
                roots, at = np.unique(label[c + ys], return_index=True)
                for r, y in zip(roots.tolist(), ys[at].tolist(), strict=True):
                    if r != label[i]:  # a merge: there are fewer of them than members
                        heads.append(i)
                        tails.append(c + y)
                        label[label == r] = label[i]
    return fps[np.array(heads, np.int64)], fps[np.array(tails, np.int64)]


def linked_fingerprints(fps: DataFrame, max_bits: int = 2, blocks: int = 2) -> DataFrame:
    """Edges ``(u, v)`` that join distinct fingerprints ``fp`` as the links of at most ``max_bits`` bits do: exactly so where
    ``max_bits`` is below twice the blocks, and else as far as two fingerprints have a block within one bit.

    Rows are dealt by anchor and sorted inside each partition, so that a task streams over the anchors it got; of an
    anchor's links it returns a spanning forest, fewer edges than members, never all pairs. Copies share a fingerprint and
    don't load an anchor. Where an anchor has more than ``MEMBERS`` members, those at home and all members are dealt into
    blocks by a hash, and each pair of blocks is a cell that goes to a task of its own.
    """
    rows = anchor_rows(fps.select("fp"), max_bits, blocks)
    hot = written(rows.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > MEMBERS).select("anchor", F.ceil(F.col("n") / MEMBERS).cast("int").alias("deal")), "simhash-hot")
    whole = F.lit(0).alias("i"), F.lit(0).alias("j")
    dealt = rows.select("anchor", "home", "fp", *whole)
    if hot.count():
        at = rows.join(hot, "anchor").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("deal")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("deal") - 1))
        homes = at.where("home").select("anchor", "home", "fp", F.col("own").alias("i"), every.alias("j"))
        members = at.select("anchor", F.lit(False).alias("home"), "fp", "own", every.alias("i")).select("anchor", "home", "fp", "i", F.col("own").alias("j"))
        dealt = rows.join(hot, "anchor", "left_anti").select("anchor", "home", "fp", *whole).union(homes).union(members)
    dealt = dealt.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def changes(anchor, home, fp, i, j):
            return np.flatnonzero((np.diff(anchor) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1

        def links(*columns):
            _, home, fp, _, _ = columns
            cut = changes(*columns)
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(fp)]))
            us, vs = [], []
            with_home = np.add.reduceat(home.astype(np.int64), starts)
            for a, z in zip(starts[k := (ends - starts > 1) & (with_home > 0)].tolist(), ends[k].tolist(), strict=True):
                u, v = _forest(fp[a:z], home[a:z], max_bits)
                us.append(u)
                vs.append(v)
            if us and sum(map(len, us)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

        held: list[tuple] = []
        for b in batches:
            if not b.num_rows:
                continue
            part = tuple(c.to_numpy(zero_copy_only=False).astype(bool if k == 1 else np.int64) for k, c in enumerate(b.columns))
            held.append(part)
            if not len(changes(*part)):
                continue  # one cell fills the batch: its end is still to come
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(changes(*whole)[-1])
            yield from links(*(x[:cut] for x in whole))
            held = [tuple(x[cut:] for x in whole)]
        if held:
            yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 2, blocks: int = 2) -> DataFrame:
    """Every row of ``docs`` with its fingerprint and the smallest id it is linked to, directly or through others.

    Returns ``(doc_id, fp, component_id)``, one row for each input row. Null and empty texts have fingerprint zero and are
    linked like any other; copies share a fingerprint and so a component. A null id keeps its row, and is passed over when
    the smallest id is taken. Rows that repeat an id stay apart. An empty table gives an empty result. Columns other than
    id and text are ignored. Words are cut at ASCII white space after A-Z are lower-cased; texts are read whole.
    """
    marked = written(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-classes.count() // TASK_FPS))
    edges = linked_fingerprints(classes.select("fp").repartition(tasks), max_bits, blocks)  # small rows, but many anchors each
    parts = connected_components(edges)
    named = classes.join(parts, classes.fp == parts.id, "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    smallest = named.groupBy("part").agg(F.min("least").alias("component_id"))
    owner = written(named.join(smallest, "part").select("fp", "component_id"), "simhash-classes")
    return marked.join(owner, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: bytes, shingle_words: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of the text's shingles, ascending; the whole text is one if it has fewer words. A shingle's
    hash is mixed from those of its words and their number."""
    data, starts, ends = _spans(text)
    if not len(starts):
        return np.zeros(0, np.uint64)
    words = xxh64_slices(data, starts, ends)
    k = min(shingle_words, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(words) - k + 1, np.uint64(k))
        for i in range(k):
            h = _rot(h * _P1, 29) ^ words[i : len(h) + i]
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h ^= h >> np.uint64(32)
    return np.unique(h)


def anchor_table(width: int = BLOCK) -> np.ndarray:
    """For each value of a block the anchors within covering radius plus one bit of it, as ``anchor_rows`` has them; -1 where
    there are fewer."""
    n = width - 1
    x = np.arange(1 << width)
    s = np.zeros_like(x)
    for p in range(1, n + 1):
        s ^= np.where(x >> (p - 1) & 1, p, 0)
    near = np.where(s > 0, x ^ (1 << np.maximum(s - 1, 0)), x)
    found = [near, near ^ (1 << n)]
    for a in range(1, n + 1):
        b = a ^ s
        found.append(np.where((s > 0) & (a < b), x ^ (1 << (a - 1)) ^ (1 << np.maximum(b - 1, 0)), -1))
    table = np.sort(np.array(found).T, axis=1)[:, ::-1]
    return table[:, : int((table >= 0).sum(1).max())]


def set_marks(sets: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The fingerprints of sets of shingles, a row of ``WORDS`` unsigned integers each, and the keys each set is dealt by: for
    each of ``TABLES`` blocks its anchors, divided by the ``MINIMA`` smallest hashes that are the block's own."""
    rng = np.random.default_rng(SEED)
    times, plus = rng.integers(0, 1 << 64, (2, TABLES * MINIMA, 1), np.uint64)
    times |= np.uint64(1)
    fps = np.zeros((len(sets), WORDS), np.uint64)
    least = np.full((len(sets), TABLES * MINIMA), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i, x in enumerate(sets):
            ones = np.zeros((WORDS, BITS), np.int64)
            for a in range(0, len(x), 1024):
                some = x[a : a + 1024]
                np.minimum(least[i], (some[None] * times + plus).min(1), out=least[i])
                for w in range(WORDS):
                    ones[w] += _bit_counts(_mixed(some, w))
            fps[i] = np.packbits(2 * ones > len(x), axis=1).view(">u8").ravel()
        least = least.reshape(-1, TABLES, MINIMA)
        base = np.tile(np.arange(1, TABLES + 1, dtype=np.uint64) * _P5, (len(sets), 1))
        for k in range(MINIMA):
            base = (_rot(base, 27) ^ (least[:, :, k] * _P2)) * _P1
            base ^= base >> np.uint64(29)
        per = BITS // BLOCK
        value = np.stack([fps[:, b // per] >> np.uint64(BLOCK * (b % per)) & np.uint64((1 << BLOCK) - 1) for b in range(TABLES)], 1)
        anchors = anchor_table()[value.astype(np.int64)]
        keys = (base[:, :, None] ^ (anchors.astype(np.uint64) + np.uint64(1)) * _P4) * _P3
        keys ^= keys >> np.uint64(32)
    return fps, [k[a >= 0] for k, a in zip(keys, anchors, strict=True)]


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two ascending arrays without repeats have that Jaccard similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _similar_forest(ids: list[int], parts: list[int], sides: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges that join those of ``parts`` that similar sets link. If there are two ``sides``, only sets of different sides are
    compared. All sets of other parts whose fingerprints are near are compared to one set at a time; those of the largest
    part come last."""
    label = np.unique(np.array(parts), return_inverse=True)[1]
    order = np.lexsort((label, np.bincount(label)[label]))
    label, sides, fps = label[order], sides[order], fps[order]
    n = np.array([len(sets[i]) for i in order])
    member = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    begin = np.concatenate(([0], np.cumsum(n)[:-1]))
    mixed = sides.min() != sides.max()
    place = np.arange(len(order))
    marked = np.zeros(int(member.max(initial=-1)) + 1, bool)
    out = []
    for i in range(len(order) - 1):
        ok = (place > i) & (label != label[i]) & (np.minimum(n, n[i]) >= similarity * np.maximum(n, n[i]) - 1e-9)
        ok &= np.bitwise_count(fps ^ fps[i]).sum(1) <= MOST_BITS
        js = np.flatnonzero(ok & (sides != sides[i]) if mixed else ok)
        if not len(js):
            continue
        mine = member[begin[i] : begin[i] + n[i]]
        marked[mine] = True
        stops = np.cumsum(n[js])
        hits = np.concatenate(([0], np.cumsum(marked[np.concatenate([member[begin[j] : begin[j] + n[j]] for j in js.tolist()])])))
        marked[mine] = False
        both = hits[stops] - hits[stops - n[js]]
        for j in js[both >= similarity * (n[i] + n[js] - both) - 1e-9].tolist():
            if label[j] != label[i]:
                out.append((ids[order[i]], ids[order[j]]))
                label[label == label[j]] = label[i]
    return out


def _near(x: bytes, y: bytes) -> bool:
    return (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count() <= MOST_BITS


def similar_sets(classes: DataFrame, texts: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """Edges ``(u, v)`` whose components are those of all pairs of ``classes(vid, fps, keys)`` that meet at an anchor, have
    near fingerprints and the Jaccard similarity; ``texts(vid, t)`` has their texts. Every edge is a pair whose whole sets
    were compared.

    First each member of an anchor is compared to the anchor's smallest, a number of pairs that grows with the members only.
    Anchors whose members are not all in one component by then are gone through pair by pair, in cells of a bounded size.
    """
    spread = classes.select("vid", F.explode("keys").alias("key"))
    buckets = written(spread.groupBy("key").agg(F.min("vid").alias("lead"), F.count("*").alias("m")).where("m > 1"), "simhash-buckets")
    members = written(spread.join(buckets, "key").select("key", "vid", "lead", "m"), "simhash-members")
    discard(buckets)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shingle_set(t or b"", shingle_words).tobytes() for t in b.column(2).to_pylist()], pa.binary())], ["vid", "fps", "s"])

    asked = classes.join(members.select("vid").distinct(), "vid", "left_semi").select("vid", "fps")
    sets = written(texts.join(asked, "vid").select("vid", "fps", "t").mapInArrow(sets_of, "vid long, fps binary, s binary"), "simhash-sets")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [_near(f, g) and similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for f, g, x, y in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    side = lambda name: sets.select(F.col("vid").alias(name), F.col("fps").alias(f"f{name}"), F.col("s").alias(f"s{name}"))
    pairs = members.where("vid <> lead").select(F.col("lead").alias("u"), F.col("vid").alias("v")).distinct()
    pairs = pairs.join(side("v"), "v").join(side("u"), "u")
    stars = written(pairs.select("u", "v", "fu", "fv", "su", "sv").mapInArrow(checked, "u long, v long"), "simhash-stars")
    parts = written(connected_components(stars), "simhash-parts")
    labelled = members.where("m > 2").join(parts, members.vid == parts.id, "left").select("key", "vid", F.coalesce("component", "vid").alias("part"))
    labelled = written(labelled, "simhash-labelled")
    discard(members)
    sized = labelled.join(sets.select("vid", F.octet_length("s").alias("b")), "vid")
    left = sized.groupBy("key").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.sum("b").alias("load")).where("p0 <> p1")
    left = written(left.select("key", F.ceil(F.col("load") / CELL_BYTES).cast("int").alias("deal")), "simhash-open")
    own = F.pmod(F.xxhash64("vid"), F.greatest("deal", F.lit(1))).cast("int")
    placed = labelled.join(left, "key").withColumn("side", own)
    cells = F.transform(F.sequence(F.lit(0), F.greatest("deal", F.lit(1)) - 1), lambda x: F.struct(F.least(x, "side").alias("i"), F.greatest(x, "side").alias("j")))
    placed = placed.select("key", "vid", "part", "side", F.explode(cells).alias("c")).select("key", "c.i", "c.j", "vid", "part", "side")
    dealt = placed.join(sets, "vid").select("key", "i", "j", "vid", "part", "side", "fps", "s").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: list[tuple]) -> list[tuple[int, int]]:
            ids, labels, sides, fps, data = zip(*rows, strict=True)
            return _similar_forest(list(ids), list(labels), np.array(sides), np.frombuffer(b"".join(fps), np.uint64).reshape(-1, WORDS), [np.frombuffer(x, np.uint64) for x in data], similarity)

        now, held = None, []
        for b in batches:
            found: list[tuple[int, int]] = []
            for key, i, j, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, i, j) != now:
                    found += links(held) if held else []
                    now, held = (key, i, j), []
                held.append(tuple(row))
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], ["u", "v"])
        if held:
            found = links(held)
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], ["u", "v"])

    rest = written(dealt.mapInArrow(cells_of, "u long, v long"), "simhash-rest")
    discard(sets, labelled, left)
    return stars.union(rest)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns as they are, but of each group of near-duplicates only the row with the smallest id.

    Near-duplicates are texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more. Candidates are
    those that meet at one of the anchors of their sets' SimHash fingerprints; a candidate becomes a link only if the whole
    sets have the similarity. Groups are what links reach. A null id comes after all others; among rows that repeat the id,
    one is kept. Null and empty texts are near-duplicates of each other. An empty table gives an empty result. Rows are told
    apart by numbers that a written copy of ``docs`` gives them, whatever plan they come from; columns keep their names.
    """
    bounded_batches(docs.sparkSession)
    rid = free_name(docs.columns, "rid")
    rows = written(docs.withColumn(rid, F.monotonically_increasing_id()), "simhash-docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t or b"", shingle_words) for t in b.column(2).to_pylist()]
            marks = np.array([np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64) for x in sets]).reshape(-1, 2)
            fps, keys = set_marks(sets)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            dealt = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(marks[:, k])) for k in range(2)), pa.array([f.tobytes() for f in fps], pa.binary()), dealt], ["rid", "id", "d0", "d1", "fps", "keys"])

    bare = rows.select(F.col(rid).alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    marked = written(bare.mapInArrow(run, "rid long, id long, d0 long, d1 long, fps binary, keys array<long>"), "simhash-rows")
    first = F.min(F.struct(F.col("id").isNull(), "id", "rid"))
    classes = written(marked.groupBy("d0", "d1", "fps", "keys").agg(first.alias("one")).select(F.col("one.rid").alias("vid"), "one", "fps", "keys"), "simhash-firsts")
    discard(marked)
    parts = connected_components(similar_sets(classes, bare.select(F.col("rid").alias("vid"), "t"), shingle_words, similarity))
    named = classes.join(parts, classes.vid == parts.id, "left").select("one", F.coalesce("component", "vid").alias("part"))
    keep = written(named.groupBy("part").agg(F.min("one").alias("one")).select(F.col("one.rid").alias(rid)), "simhash-kept")
    discard(classes)
    return rows.join(keep, rid, "left_semi").drop(rid)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of ``near_duplicates`` over the whole ``documents`` table."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
