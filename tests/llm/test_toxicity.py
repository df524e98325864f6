import math
import random
import re

import numpy as np

from tessera.llm import toxicity

DIR = "/root/testdata/sf0.01"


def test_fit_recovers_an_ordered_scale():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(4000):
        x = sorted(rng.choice(4, rng.integers(0, 4), replace=False).tolist())
        z = sum((-1.5, 1.0, 2.0, 3.0)[i] for i in x) + rng.logistic()
        rows.append((x, [1.0] * len(x), int(z > 1) + int(z > 3)))
    w, thetas = toxicity._fit(rows, 4, 2)
    assert np.allclose(w, (-1.5, 1, 2, 3), atol=0.4) and np.allclose(thetas, (1, 3), atol=0.4)


def made(rng):
    clean = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]

    def text(bad, n=120):
        words = [rng.choice(clean) for _ in range(n)]
        for _ in range(bad):
            words[rng.randrange(n)] = rng.choice(["zaplugh", "Zaplest", "BRUGGEN"])
        return " ".join(words)

    return text


def test_severity(spark):
    rng = random.Random(8)
    text = made(rng)
    rows = [(i, text(0 if i % 8 else rng.choice((3, 4, 12))), i % 8 == 0) for i in range(800)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(900, None, 0.1), (901, "", 0.1), (902, text(300, 9000), 0.1), (None, text(9), 0.1), (5, text(0), 0.1)], "doc_id long, text string, severity double")
    labels = spark.createDataFrame([(i, int(y), 1) for i, _, y in rows if i % 2 == 0] + [(0, 0, 1), (None, 1, 1), (7777, 1, 0), (2, None, None)], "doc_id long, toxic int, quality int")
    model = toxicity.fit_severity(docs, labels)
    assert list(model.thetas) == sorted(model.thetas)
    got = toxicity.severity(docs, model).collect()
    assert len(got) == 805
    want = {i: y for i, _, y in rows} | {900: False, 901: False, 902: True, None: True}
    assert [r for r in got if r.toxic != want[r.doc_id]] == []
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.severity <= 2 and (r.p_toxic >= 0.5) == (r.grade >= 1) for r in got) and by[900].severity == by[901].severity
    assert toxicity.severity(docs.limit(0), model).collect() == []
    assert toxicity.fit_severity(docs, labels.limit(0)).weights == {} == toxicity.fit_severity(docs.limit(0), labels).weights
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted([i for i, y in want.items() if not y] + [5])


def test_grades_of_their_own(spark):
    """Three grades that each have a word; the expected severity follows them."""
    rng = random.Random(9)
    text = made(rng)
    grades = [i % 4 for i in range(1200)]
    docs = spark.createDataFrame([(i, text(0) + ("", " rude", " rude nasty", " nasty vile vile")[g]) for i, g in enumerate(grades)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i % 3], "doc_id long, g int")
    model = toxicity.fit_severity(docs, labels, labels.g, levels=3)
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    assert sum(got[i].grade == g for i, g in enumerate(grades) if i % 3 == 0) >= 0.95 * 400
    means = [np.mean([got[i].severity for i, g in enumerate(grades) if g == k]) for k in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 2


def test_repeated_documents_count_once(spark):
    text = made(random.Random(3))
    rows = [(i, text(4 if i % 2 else 0)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(60)], "doc_id long, toxic int, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    many = spark.createDataFrame(rows + rows[:1] * 500, "doc_id long, text string")
    assert toxicity.fit_severity(many, labels) == toxicity.fit_severity(docs, labels)


def test_query_equals_a_plain_reckoning(spark):
    """The scores of the query, worked out again from the fitted weights; and how well it does on its table."""
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_severity(docs, labels)
    got = {r.doc_id: r for r in toxicity.op1_toxicity(spark, DIR).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        z = 0.0
        for f, (one, dense) in model.weights.items():
            n = sum(w == f[1:] if f[0] == "=" else w[:4] == f[1:] or w[:5] == f[1:] for w in words) if any(w.startswith(f[1:]) for w in set(words)) else 0
            z += n > 0 and one + dense * math.log(1 + 1000 * n / len(words))
        ps = [1 / (1 + math.exp(th - z)) for th in model.thetas]
        assert math.isclose(got[i].severity, sum(ps), abs_tol=1e-9) and got[i].toxic == (ps[0] >= 0.5)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(got[i].toxic == bool(y) for i, y in toxic.items() if i in got) >= 0.95 * len(toxic)
