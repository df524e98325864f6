import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from tessera.llm import decontamination as dc

DIR = "/root/testdata/sf0.01"


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items, k):
    wins = {}
    for item, t in items:
        w = split(t)
        for i in range(max(1, len(w) - k + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for win, names in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found |= names
        found = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(9)
    vocab = ["a", "b", "C", "Éa", "é", "x9", "the", "THE"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    docs = [(i, text(rng.randint(0, 80))) for i in range(120)] + [(200, None), (201, ""), (None, text(50)), (5, text(40)), (5, text(40)), (300, text(3000))]
    items = [(j, text(rng.randint(1, 7))) for j in range(12)] + [(50, None), (51, "..."), (3, "b c the"), (None, "a a"), (60, "absent word"), (61, "the"), (9, docs[3][1])]
    d = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, pos int, term string").repartition(3)
    b = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, term int")
    key = lambda r: (str(r[0]), r[1:])
    for k in (3, 5):
        got = [tuple(r) for r in dc.contamination(d, b, size=k).collect()]
        assert sorted(got, key=key) == sorted(brute(docs, items, k), key=key)
    clean = dc.contamination(d, b.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.contaminated for r in clean)
    assert dc.contamination(d.limit(0), b).collect() == []


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    docs = [(1, "one two three four five"), (2, "nothing here")]
    items = [(7, "two three four")]
    got = [tuple(r) for r in dc.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), size=2).collect()]
    assert sorted(got) == sorted(brute(docs, items, 2))


def test_proximity_equals_brute_force(spark):
    rng = random.Random(4)
    vocab = [chr(97 + i) for i in range(12)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))) for i in range(80)]
    items = [(j, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 5)))) for j in range(10)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    wins = dc.windows(b, size=4)
    terms, n_terms = dc.benchmark_terms(wins)
    index = dc.build_index(d, terms, n_terms, keep=("doc_id",))
    ranked, named, n = dc.rarest_first(wins, terms, index, n_terms)
    ids = {r.rid: r.doc_id for r in index.where(index.tid == dc.END).collect()}
    patterns = {}
    for j, t in items:
        w = t.split()
        for i in range(max(1, len(w) - 3)):
            patterns.setdefault(j, []).append(w[i : i + 4])
    for slop in (0, 2):
        found = dc.proximity_matches(index, ranked, n, n_terms, slop).join(named, "pattern").select("rid", "item").distinct().collect()
        want = set()
        for i, t in docs:
            w = t.split()
            for j, wanted in patterns.items():
                if any(set(p) <= set(w[s : s + len(p) + slop]) for p in wanted for s in range(len(w))):
                    want.add((i, str(j)))
        assert {(ids[r.rid], r.item) for r in found} == want and want


def test_contaminated_rows_go_from_any_plan(spark):
    """Rows from a shuffle whose partitions differ from plan to plan, with a column named as the row number might be."""
    item = "a b c d e f g h i j"
    docs = spark.range(4000).selectExpr("id as doc_id", f"if(id % 5 = 0, concat('x ', '{item}', ' y'), concat('clean text ', id)) as text", "id as rid", "cast(id as string) as RID_")
    grouped = docs.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in ("text", "rid", "RID_")])
    kept = dc.without_contaminated(grouped, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "rid", "RID_"]
    got = kept.collect()
    assert sorted(r.doc_id for r in got) == [i for i in range(4000) if i % 5] and all(r.rid == r.doc_id for r in got)
    rows = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, f"{item}"), (3, "k"), (3, "k")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (None, "...")], "item_id long, text string")
    assert sorted(map(str, (tuple(r) for r in dc.without_contaminated(rows, bench).collect()))) == sorted(map(str, [(1, None), (1, None), (2, ""), (3, "k"), (3, "k")]))
    assert len(dc.without_contaminated(rows, bench.limit(0)).collect()) == 6 and dc.without_contaminated(rows.limit(0), bench).collect() == []


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = sorted(tuple(r) for r in dc.op7_decontamination(spark, DIR).collect())
    want = sorted(con.sql(dc.ORACLE).select("doc_id, n_words, n_hit, n_items, items_sha256, contaminated").fetchall())
    assert got == want and sum(r[-1] for r in got) > 5
