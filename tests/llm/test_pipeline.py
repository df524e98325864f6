import random

import corpus_pipeline as cp

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs = {i: text(rng.randint(60, 300)) for i in range(300)}
    toxic = list(range(0, 300, 6))
    for i in toxic:
        docs[i] += " zagblim " + text(5) + " zagblim gruntfob"
    docs[401] = docs[1]  # an exact copy
    words = docs[2].split()
    docs[402] = " ".join([*words[:30], "changed", *words[31:]])  # a near copy
    passage = text(60)
    for i in (3, 4, 5):
        docs[i] = docs[i] + " " + passage
    item = text(30)
    docs[7] = docs[7][:100] + " " + item.upper() + " " + docs[7][100:]
    docs[403], docs[404] = None, ""
    rows = [(i, t, "en", "s", len(t) if t else 0) for i, t in docs.items()]
    d = str(tmp_path)
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    want = now.columns
    seen = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        got = stage(spark, now, d)
        if k < len(cp.STAGES) - 1:
            assert got.columns == want
        got.write.parquet(f"{d}/out{k}")
        now = spark.read.parquet(f"{d}/out{k}")
        seen[name] = {r.doc_id: r for r in now.collect()} if k < len(cp.STAGES) - 1 else now.collect()
    ids = set(docs)
    assert set(seen["toxicity"]) == ids - set(toxic)
    assert ids - set(toxic) - set(seen["near_dedup"]) == {401, 402, 404}
    cut = seen["suffix_dedup"]
    assert set(cut) == set(seen["near_dedup"])
    inner = " ".join(passage.split()[2:-2])
    for i in (3, 4, 5):
        assert inner not in cut[i].text and cut[i].n_chars == len(cut[i].text) < len(docs[i])
    assert all(cut[i].text == (docs[i] or "") for i in cut if i not in (3, 4, 5))
    assert set(cut) - set(seen["decontamination"]) == {7}
    assert {r.doc_id for r in seen["packing"]} == set(seen["decontamination"])
    assert len(cp.run(spark, d).collect()) == len(seen["packing"])
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, d).collect() == []


def test_stages_keep_other_columns_and_repeated_rows(spark, tmp_path):
    """Null ids, repeated rows and columns with the names that operators use; every stage but the last keeps them."""
    d = str(tmp_path)
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, long, 1, "a", 5), (None, "other words here", 2, "b", 6), (4, None, 3, "c", 7), (4, None, 3, "c", 7), (5, "just one", 4, "d", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid long, k string, n_removed long")
    spark.createDataFrame([(5, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "not in any document at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    key = lambda r: (r.rid, r.k)
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, d)
        want = [(1, "a"), (2, "b"), (3, "c"), (3, "c"), (4, "d")]
        if name == "near_dedup":
            want.remove((3, "c"))
        assert got.columns == docs.columns and sorted(map(key, got.collect())) == want
        assert all(r.n_removed == 4 + r.rid for r in got.collect())


def test_order_of_the_stages():
    assert [name for name, _ in cp.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "packing"]
