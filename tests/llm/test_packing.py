import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import packing


def test_fullest_equals_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        cap = rng.randint(1, 40)
        counts = {rng.randint(1, 25): rng.randint(1, 3) for _ in range(4)}
        items = [x for x, n in counts.items() for _ in range(n)]
        best = max(s for k in range(len(items) + 1) for s in (sum(c) for c in itertools.combinations(items, k)) if s <= cap)
        used = packing.fullest(counts, cap)
        assert sum(x * n for x, n in used.items()) == best and all(n <= counts[x] for x, n in used.items())


def test_patterns_use_everything_up():
    rng = random.Random(5)
    counts = Counter(rng.randint(1, 1023) for _ in range(20_000))
    found = packing.patterns(dict(counts))
    used = Counter()
    for p, times in found:
        assert sum(x * n for x, n in p.items()) <= 1024
        for x, n in p.items():
            used[x] += n * times
    assert used == counts
    total = sum(x * n for x, n in counts.items())
    assert sum(t for _, t in found) <= 1.005 * total / 1024 + 2


def test_pack(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(int(rng.expovariate(1 / 500)))) for _ in range(150)] + ["same words"] * 30 + [None, "", "x " * 5000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 1), (0, texts[0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank long").repartition(5)
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(df, path).collect()
    library = Tokenizer.from_file(path)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in rows if i != 0 and i is not None}
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, ids in want.items():
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes())
        assert at == len(ids)
    assert len(by[None]) == 1 and sum(r.start == 0 for r in by[0]) == 2
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.01 * sum(r.length for r in got) / 1024 + 2
    assert packing.pack(df.limit(0), path).collect() == []
