import itertools
import random

import pytest
import xxhash

from tessera.llm import simhash


def brute(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(pairs_of):
    ids = sorted(pairs_of)
    up = {f: f for f in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    return up, find


def test_fingerprints_equal_brute_force():
    rng = random.Random(3)
    words = ["Über", "ab", "CDE", "word-with-many-characters-more-than-thirty-two", "x", "naïve", "0123456789"]
    for n in (0, 1, 2, 3, 4, 9, 200):
        text = " \t\n".join(rng.choice(words) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == brute(text)
    long = " ".join(str(i) for i in range(5000))
    assert simhash.fingerprint(long.encode(), step=100) == brute(long)


@pytest.mark.parametrize(("max_bits", "blocks", "members"), [(2, 2, 4096), (3, 2, 4096), (1, 2, 4096), (7, 4, 4096), (2, 2, 3), (7, 4, 5)])
def test_links_equal_brute_force(spark, monkeypatch, max_bits, blocks, members):
    rng = random.Random(max_bits)
    fps = {0, (1 << 64) - 1, 1, 3, 7, 1 << 63, 15, 31}
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, max_bits + 1)):
                x ^= 1 << b
            fps.add(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in fps], "fp long").repartition(5)
    monkeypatch.setattr(simhash, "MEMBERS", members)
    edges = [(r.u, r.v) for r in simhash.linked_fingerprints(df, max_bits, blocks).collect()]
    up, find = components(fps)
    got_up, got_find = components(fps)
    for a, b in itertools.combinations(fps, 2):
        if bin(a ^ b).count("1") <= max_bits:
            up[find(a)] = find(b)
    unsigned = lambda v: v % (1 << 64)
    for a, b in edges:
        assert bin(unsigned(a) ^ unsigned(b)).count("1") <= max_bits
        got_up[got_find(unsigned(a))] = got_find(unsigned(b))
    groups = lambda f: {frozenset(x for x in fps if f(x) == r) for r in {f(x) for x in fps}}
    assert groups(find) == groups(got_find)


def test_near_duplicates_cases(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base, "x"), (3, base, "y"), (9, base.replace("w399", "other"), "x"), (7, None, "n"), (2, "", "n"), (8, "entirely different words here", "n"), (8, "entirely different words here", "n"), (None, "alone", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fp % (1 << 64)): r.component_id for r in got}
    fps = {i: brute(t) for i, t, _ in rows if i}
    assert by[(5, fps[5])] == by[(3, fps[3])] == 3
    assert by[(9, fps[9])] == (3 if bin(fps[9] ^ fps[5]).count("1") <= 2 else 9)
    assert by[(7, 0)] == by[(2, 0)] == 2
    assert sum(r.doc_id == 8 and r.component_id == 8 for r in got) == 2
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("small", [False, True])
def test_one_of_each_equals_brute_force(spark, monkeypatch, small):
    if small:  # buckets in several cells
        monkeypatch.setattr(simhash, "CELL_BYTES", 4000)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    texts = [None, "", "two words", "Two  Words"]
    for _ in range(60):
        base = [word() for _ in range(rng.randint(40, 200))]
        texts.append(" ".join(base))
        for _ in range(5):  # similarities from 0.5 to 1, most about 0.7 to 0.9
            now = list(base)
            for i in rng.sample(range(len(now)), max(1, int(len(now) * rng.choice([0.01, 0.02, 0.03, 0.04, 0.06])))):
                now[i] = word()
            texts.append(" ".join(now))
    hot = [word() for _ in range(100)]  # many share a passage that makes them alike to a half
    texts += [" ".join(hot + [word() for _ in range(rng.randint(20, 60))]) for _ in range(40)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    up, find = components(set(range(len(texts))))
    near = 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            up[max(find(a), find(b))] = min(find(a), find(b))
            near += 1
    assert near > 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == {find(x) for x in up}


def test_anchors_of_both_kinds_are_the_same(spark):
    """The anchors of short blocks in numpy are those that the DataFrame functions find, block by block."""
    values = [(k << 56 | k << 8 | 255 - k) for k in range(256)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = simhash.anchor_rows(spark.createDataFrame([(signed(v),) for v in values], "fp long"), 8, 8).collect()
    table = simhash.anchor_table(8)
    got = {}
    for r in rows:
        got.setdefault((r.fp % (1 << 64), r.anchor >> 8), set()).add(r.anchor & 255)
    for v in values:
        for b in range(8):
            assert got[(v, b)] == {x for x in table[v >> 8 * b & 255].tolist() if x >= 0}


def test_recall_at_the_threshold():
    """Sets at a similarity of 0.8 exactly: nearly all meet at an anchor with near fingerprints."""
    import numpy as np

    rng = np.random.default_rng(3)
    met = 0
    for n in [20, 50, 200, 1000] * 150:
        x = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        both, one = n * 4 // 5, n // 10
        f, k = simhash.set_marks([np.unique(x[: both + one]), np.unique(np.concatenate((x[:both], x[both + one :])))])
        met += bool(set(k[0].tolist()) & set(k[1].tolist())) and int(np.bitwise_count(f[0] ^ f[1]).sum()) <= simhash.MOST_BITS
    assert met >= 0.99 * 600


def test_one_stays_from_any_plan(spark):
    """Rows from a shuffle whose partitions differ from plan to plan, with a column named as the row number might be."""
    from pyspark.sql import functions as F

    docs = spark.range(3000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 30), k -> concat('w', id div 3, 'x', k))) as text", "id as rid", "cast(id as string) as RID_")
    grouped = docs.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in ("text", "rid", "RID_")])
    kept = simhash.one_of_each(grouped)
    assert kept.columns == ["doc_id", "text", "rid", "RID_"]
    got = kept.collect()
    assert sorted(r.doc_id for r in got) == list(range(0, 3000, 3)) and all(r.rid == r.doc_id for r in got)
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def test_repeated_text_is_linked(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base), (2, f"{base} {base}"), (3, " ".join(f"v{i}" for i in range(40)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == {1, 3}
