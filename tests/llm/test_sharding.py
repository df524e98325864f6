import random
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import sharding


def test_difference_places_every_item_once():
    rng = random.Random(1)
    for n in (0, 1, 5, 17, 400):
        items = [rng.randint(1, 1000) for _ in range(n)]
        sums, placed = sharding.difference([[x] + [0] * 3 for x in items], 4)
        got = [0] * 4
        for x, p in zip(items, placed, strict=True):
            assert sorted(p) == [0, 1, 2, 3]
            got[p[0]] += x
        assert got == sums and sums == sorted(sums, reverse=True)
        if n == 400:
            assert sums[0] - sums[-1] <= 2


def test_textbook_two_way():
    sums, _ = sharding.difference([[x, 0] for x in (8, 7, 6, 5, 4)], 2)
    assert sums == [16, 14]


def spread(items, n):
    """The differencing rule itself, with all tuples in one list that is sorted anew at every step."""
    live = [sorted([x] + [0] * (n - 1), reverse=True) for x in items]
    while len(live) > 1:
        live.sort(key=lambda t: t[-1] - t[0])
        a, b = live.pop(0), live.pop(0)
        live.append(sorted((p + q for p, q in zip(a, reversed(b), strict=True)), reverse=True))
    return live[0][0] - live[0][-1]


def test_spread_equals_the_rule():
    rng = random.Random(4)
    for n in (2, 3, 5):
        for _ in range(20):
            items = rng.sample(range(1, 100_000), 12)
            sums, _ = sharding.difference([[x] + [0] * (n - 1) for x in items], n)
            assert sums[0] - sums[-1] == spread(items, n)


@pytest.mark.parametrize("groups", [20_000, 100])
def test_balanced_shards(spark, monkeypatch, groups):
    monkeypatch.setattr(sharding, "BLOCK_GROUPS", groups)
    rng = random.Random(2)
    texts = ["é" * rng.randint(0, 300) + str(i) for i in range(900)] + ["same text"] * 40 + [None, None, ""]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(3, texts[3], "z"), (None, "no id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(6)
    got = sharding.balanced_shards(df).collect()
    assert len(got) == len(rows)
    loads, slots, by = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        if r.doc_id is not None:
            t = texts[r.doc_id] or ""
            assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
            by[t].add(r.shard)
    assert all(len(s) == 1 for s in by.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(loads) == set(range(16)) and max(loads.values()) - min(loads.values()) <= 0.01 * sum(loads.values()) / 16 + 2
    assert sharding.balanced_shards(df.limit(0)).collect() == []
