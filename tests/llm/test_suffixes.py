import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffixes


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = int(gone[0]) + int((np.diff(gone.astype(int)) == 1).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 50, 700):
        for letters in (b"a", b"ab", bytes(range(256))):
            data = bytes(rng.choice(letters) for _ in range(n))
            sa = suffixes.suffix_array(np.frombuffer(data, np.uint8))
            assert sa.tolist() == sorted(range(n), key=lambda i: data[i:])
            if n:
                before = np.full(n, -1)
                before[sa[1:]] = sa[:-1]
                limit = n - np.arange(n)
                want = [0] * n
                for a, b in zip(sa[:-1], sa[1:], strict=True):
                    k = 0
                    while k < 10 and max(a, b) + k < n and data[a + k] == data[b + k]:
                        k += 1
                    want[b] = k
                # positions with fewer than the cap's bytes are left out, as the operator does
                valid = sa[limit[sa] >= 10]
                before = np.full(n, -1)
                before[valid[1:]] = valid[:-1]
                got = suffixes.common_prefixes(np.frombuffer(data, np.uint8), before, limit, 10, lanes=7)
                for a, b in zip(valid[:-1], valid[1:], strict=True):
                    k = 0
                    while k < 10 and data[a + k] == data[b + k]:
                        k += 1
                    assert got[b] == k


def corpus(rng):
    word = lambda: bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(2, 7))).decode()
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randint(9, 60)) for _ in range(6)]
    out = []
    for _ in range(150):
        parts = [text(rng.randint(0, 40))]
        while rng.random() < 0.5:
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a : a + rng.randint(20, 400)], text(rng.randint(0, 20))]
        out.append(" ".join(parts))
    out += [out[0]] * 5 + [out[1][:-3]] * 2 + ["é" * 300, "x" * 500, "", None, text(40) + shared[0] * 3, "short"]
    hot = text(40)
    out += [text(rng.randint(5, 30)) + hot + text(rng.randint(5, 30)) for _ in range(150)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # long texts in blocks, many shards, divided anchors
        monkeypatch.setattr(suffixes, "BLOCK", 300)
        monkeypatch.setattr(suffixes, "SHARD_BYTES", 2000)
        monkeypatch.setattr(suffixes, "HOT_BYTES", 1500)
    rng = random.Random(2)
    texts = corpus(rng)
    ids = [*range(len(texts) - 3), None, 4, 4]
    rows = [(i, t, b"x", 1) for i, t in zip(ids, texts, strict=True)] + [(7, texts[7], b"y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept binary, k long").repartition(5)
    for length in (60, 100, 300):
        got = suffixes.remove_repeats(df, length=length).collect()
        assert len(got) == len(rows)
        want = Counter((i, *b) for (i, *_), b in zip(rows, brute([(t or "").encode() for _, t, *_ in rows], length), strict=True))
        have = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
        assert have == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(df).collect() == []
    one = spark.createDataFrame([(1, "z" * 199), (2, None)], "doc_id long, text string")
    assert [(r.n_removed, r.n_spans) for r in suffixes.remove_repeats(one).collect()] == [(0, 0)] * 2


def test_rows_without_an_id_stay_apart(spark, monkeypatch):
    """Texts of one length whose 24 lowest hash bits are equal, so that all but the whole row would mix them up."""
    from pyspark.sql import functions as F

    found = spark.range(12000).select(F.concat(F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("-")).alias("p")).select(F.concat("p", F.repeat(F.sha2("p", 256), 2)).alias("t"))
    low = found.withColumn("h", F.xxhash64("t").bitwiseAND(F.lit((1 << 24) - 1).cast("long")))
    first, second = low.groupBy("h").agg(F.collect_list("t").alias("ts")).where("size(ts) > 1").orderBy("h").first().ts[:2]
    texts = [first, second, first]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = suffixes.remove_repeats(df, length=60).select("text", "n_removed", "n_spans").collect()
    want = [(t, b[1], b[2]) for t, b in zip(texts, brute([t.encode() for t in texts], 60), strict=True)]
    assert Counter(map(tuple, got)) == Counter(want)


def test_many_rows_without_an_id(spark):
    """40,000 different texts under one id, some of them with a passage in common."""
    docs = spark.range(40_000).selectExpr("cast(null as long) as doc_id", "concat(repeat(sha2(cast(id as string), 256), 4), if(id % 100 = 0, concat(repeat(sha2('x', 256), 3), sha2('y', 256)), '')) as text", "id")
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(docs).select("id", "n_bytes", "n_removed", "n_spans").collect()}
    assert len(got) == 40_000
    last = {i: hashlib.sha256(str(i).encode()).hexdigest() for i in range(0, 40_000, 100)}
    many = Counter(h[-j:] for h in last.values() for j in range(1, 20))  # what stands before the passage may be the same too
    want = {i: 256 + sum(many[h[-j:]] > 1 for j in range(1, 20)) for i, h in last.items()}
    assert all(v[1:] == ((want[i], 1) if i in want else (0, 0)) for i, v in got.items())


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_texts_that_repeat_themselves(spark, monkeypatch, most):
    monkeypatch.setattr(suffixes, "_MOST_AGAIN", most)
    rng = random.Random(6)
    other = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = ["x" * 1000, other(150) + ". Is onhe" * 80 + other(90), ". Is onhe" * 30 + other(300), other(400), "abc" * 21, other(100) + "q" * 130]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for length in (60, 100):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.remove_repeats(df, length=length).collect()}
        assert got == dict(enumerate(brute([t.encode() for t in texts], length)))
    long = spark.createDataFrame([(1, "x" * 600_000 + other(50))], "doc_id long, text string")
    assert [(r.n_removed, r.n_spans) for r in suffixes.remove_repeats(long).collect()] == [(600_000, 1)]


def test_many_equal_rows(spark):
    """5,000 copies of a text are removed whole, in time in proportion to their number."""
    import time

    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(800))
    took = []
    for n in (1000, 5000):
        docs = spark.range(n).selectExpr("1L as doc_id", f"'{text}' as text")
        began = time.monotonic()
        rows = suffixes.remove_repeats(docs).select("n_bytes", "n_removed", "n_spans").distinct().collect()
        took.append(time.monotonic() - began)
        assert [tuple(r) for r in rows] == [(len(text), len(text), 1)]
    assert took[1] < 8 * took[0] + 10
