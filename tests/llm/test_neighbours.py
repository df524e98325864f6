from collections import defaultdict

import numpy as np

from tessera.llm import neighbours


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = (x * x[ids.index(q)]).sum(1)
        order = sorted((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q)
        out[q] = [(v, -d) for d, v in order[:k]]
    return out


def recall(got, want):
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in w}) / max(1, len(w)) for q, w in want.items()])


def grouped(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_on_vectors_of_any_norm(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 32)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 16))
    x *= rng.uniform(0.5, 1.5, (3000, 1))
    x[200:700] = x[200]
    ids = [int(i) * 2 for i in range(3000)]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, rank int").repartition(4)
    queries = [i for i in ids if i % 100 == 0]
    got = grouped(neighbours.search(neighbours.build_index(df, 10), df.where("vec_id % 100 = 0").select("vec_id")).collect())
    want = brute(ids, x, queries, 10)
    assert set(got) == set(queries) and all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= 0.9
    assert [v for v, _ in got[600]] == [400, 402, 404, 406, 408, 410, 412, 414, 416, 418] or np.dot(x[300], x[300]) < want[600][0][1]
    for q, found in got.items():
        for v, s in found:
            assert np.isclose(s, x[ids.index(v)] @ x[ids.index(q)], rtol=1e-12)


def test_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (10, [1.0, 1.0]), (11, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = grouped(neighbours.search(neighbours.build_index(df), df.select("vec_id")).collect())
    assert dict(got) == {1: [(3, 1.0), (10, 1.0), (2, 0.0)], 2: [(3, 1.0), (10, 1.0), (1, 0.0)], 3: [(10, 2.0), (1, 1.0), (2, 1.0)], 10: [(3, 2.0), (1, 1.0), (2, 1.0)]}
    empty = df.limit(0)
    assert neighbours.search(neighbours.build_index(empty), empty.select("vec_id")).collect() == []
    one = df.where("vec_id = 1")
    assert neighbours.search(neighbours.build_index(one), one.select("vec_id")).collect() == []


def test_recall_on_the_whole_table(spark):
    """Every row whose id is divisible by 100 against all rows of the table, with the production parameters."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = df.collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    queries = [i for i in ids if i % 100 == 0]
    got = grouped(neighbours.search(neighbours.build_index(df, 20), df.where("vec_id % 100 = 0").select("vec_id")).collect())
    place = {i: k for k, i in enumerate(ids)}
    want = {}
    for q in queries:
        s = x @ x[place[q]]
        order = sorted((-s[k], i) for k, i in enumerate(ids) if i != q)[:20]
        want[q] = [(i, -d) for d, i in order]
    assert set(got) == set(queries) and recall(got, want) >= 0.9
