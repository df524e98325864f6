"""Toxicity severity by a cumulative-link (proportional-odds) ordinal model over sparse text features.

Features are the lower-cased words of a text and their 4- and 5-letter beginnings, each with two values: that it occurs, and
the log of how often it does in a thousand words. One weight vector is shared by all thresholds: P(grade <= k) =
sigmoid(theta_k - w.x), with ordered thetas. The expected severity is the sum of P(grade >= k) over k. Grades come from the
labels alone. The model is fitted on a bounded sample of labelled rows (``MAX_LABELS``); scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, written

#: Labelled rows the fit sees at most, chosen by a hash of the id; features the model keeps at most.
MAX_LABELS = 12_000
MAX_FEATURES = 4096
#: Grades above 0; labels beyond count as the highest.
LEVELS = 2
#: Words whose features a worker remembers.
REMEMBERED = 300_000
#: A row is rejected if P(grade >= 1) reaches this.
REJECT = 0.5
WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """``=word`` and, for longer words, ``^`` with its first 4 and 5 letters."""
    return [f"={word}", *(f"^{word[:k]}" for k in (4, 5) if len(word) >= k)]


@dataclass(frozen=True)
class SeverityModel:
    """For each feature the weights of its presence and of the log of its density; and ordered thresholds."""

    weights: dict[str, tuple[float, float]]
    thetas: tuple[float, ...]

    def at_least(self, z: float) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        return [1 / (1 + math.exp(min(700, max(-700, t - z)))) for t in self.thetas]


class Reader:
    """Finds the kept features of texts; remembers those of words."""

    def __init__(self, keep):
        self.keep, self.known = keep, {}

    def features(self, text: str | None) -> dict[str, float]:
        """The log of each kept feature's occurrences in a thousand words."""
        words = WORD.findall((text or "").lower())
        found: dict[str, int] = {}
        for w, n in Counter(words).items():
            f = self.known.get(w)
            if f is None:
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                f = self.known[w] = tuple(x for x in word_features(w) if x in self.keep)
            for x in f:
                found[x] = found.get(x, 0) + n
        return {x: math.log1p(1000 * n / len(words)) for x, n in found.items()}

    def link(self, text: str | None, model: SeverityModel) -> float:
        """w.x of a text."""
        return math.fsum(model.weights[x][0] + model.weights[x][1] * v for x, v in self.features(text).items())


def _fit(rows: list[tuple[list[int], list[float], int]], size: int, levels: int, steps: int = 400, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds for rows ``(places, values, grade)`` by full-batch Adam on the mean negative log-likelihood;
    thresholds stay ordered as sums of exponentials."""
    n = len(rows)
    of = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    at, x = np.array([i for r in rows for i in r[0]], np.int64), np.array([v for r in rows for v in r[1]], float)
    y = np.array([r[2] for r in rows])
    p = np.zeros(size + levels)
    p[size] = 1.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, theta = p[:size], np.cumsum(np.concatenate(([p[size]], np.exp(p[size + 1 :]))))
        z = np.bincount(of, w[at] * x, n)
        edge = np.concatenate(([-np.inf], theta, [np.inf]))
        hi, lo = (1 / (1 + np.exp(-np.clip(e - z, -500, 500))) for e in (edge[y + 1], edge[y]))
        prob = np.maximum(hi - lo, 1e-12)
        gh, gl = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        gz = (gh - gl) / n  # of the negative log-likelihood by z
        gt = np.array([(gl[y == k + 1].sum() - gh[y == k].sum()) / n for k in range(levels)])
        tail = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate((np.bincount(at, gz[of] * x, size) + l2 * w, [tail[0]], tail[1:] * np.exp(p[size + 1 :])))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:size], np.cumsum(np.concatenate(([p[size]], np.exp(p[size + 1 :]))))


def label_grade() -> Column:
    """The grade that the columns ``toxic`` and ``quality`` of a label stand for: 0 not toxic, 1 toxic, 2 toxic and of low
    quality as well. A missing quality doesn't count as low, and without ``toxic`` there is no grade."""
    return F.when(F.col("toxic") > 0, F.when(F.col("quality") <= 0, 2).otherwise(1)).when(F.col("toxic").isNotNull(), 0)


def fit_severity(docs: DataFrame, labels: DataFrame, grade: Column | None = None, id_col: str = "doc_id", text_col: str = "text", max_labels: int = MAX_LABELS, levels: int = LEVELS) -> SeverityModel:
    """Fits the model on the documents of at most ``max_labels`` labels, chosen by a hash of the id.

    ``grade`` is a whole number from 0 over the columns of ``labels``, by default ``label_grade``; null grades and labels
    without a document are passed over; of labels that repeat an id the highest grade counts, and of documents that repeat
    one a single text, the one with the smallest hash. A feature is kept if at least three rows have it and it goes with
    grades above 0, or with grade 0, by a log-likelihood ratio above twice the log of the number of features tried; the
    ``MAX_FEATURES`` strongest stay. Weights may have either sign. Without two classes (empty tables included), or without
    a feature that tells them apart, the model gives severity near 0 for all.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    graded = labels.select(F.col(id_col).cast("long").alias("doc_id"), (label_grade() if grade is None else grade).cast("int").alias("y"))
    marks = graded.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.greatest(F.lit(0), F.least(F.lit(levels), F.max("y"))).alias("y"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)  # bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    sample = written(one.select("y", F.col("t.text").alias("text")).repartition(12), "toxicity-sample")
    totals = {r.y: r.n for r in sample.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    none = SeverityModel({}, tuple(20.0 + k for k in range(levels)))
    if not pos or not neg:
        return none

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[y > 0].update({f for w in set(WORD.findall((t or "").lower())) for f in word_features(w)})
        names = list(counts[0] | counts[1])
        for a in range(0, len(names), 50_000):
            some = names[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([c[f] for f in some], pa.int64()) for c in counts)], ["f", "n0", "n1"])

    seen = sample.mapInArrow(tally, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 3")
    seen = written(seen, "toxicity-features")
    tried = max(2, seen.count())
    part = lambda n, total: F.when(n > 0, n * F.log(n / total)).otherwise(F.lit(0.0))
    n, every = F.col("n0") + F.col("n1"), pos + neg
    ratio = 2 * (part(F.col("n1"), n * pos / every) + part(F.col("n0"), n * neg / every) + part(pos - F.col("n1"), (every - n) * pos / every) + part(neg - F.col("n0"), (every - n) * neg / every))
    names = [r.f for r in seen.withColumn("g", ratio).where(F.col("g") > 2 * math.log(tried)).orderBy(F.desc("g"), "f").limit(MAX_FEATURES).collect()]
    if not names:
        return none
    index = {f: i for i, f in enumerate(names)}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(index)
        for b in batches:
            rows = [sorted((index[f], v) for f, v in reader.features(t).items()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[i for i, _ in r] for r in rows], pa.list_(pa.int32())), pa.array([[v for _, v in r] for r in rows], pa.list_(pa.float64()))], ["y", "at", "x"])

    rows = sorted((list(r["at"]), list(r.x), r.y) for r in sample.mapInArrow(describe, "y int, at array<int>, x array<double>").collect())  # at most max_labels rows of kept features
    size = len(names)
    w, thetas = _fit([(at + [size + i for i in at], [1.0] * len(at) + x, y) for at, x, y in rows], 2 * size, levels)
    return SeverityModel({f: (float(w[i]), float(w[size + i])) for i, f in enumerate(names)}, tuple(thetas.tolist()))


def severity(docs: DataFrame, model: SeverityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, severity, grade, p_toxic, toxic)`` of every row.

    Severity is the expected grade, grade the number of thresholds that are passed with probability one half or more. A
    null or wordless text has no features and the severity of the intercepts alone; null and repeated ids keep their
    rows; an empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_FEATURES weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, reader = shared.value, Reader(shared.value.weights)
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                at_least = m.at_least(reader.link(t, m))
                out.append((sum(at_least), sum(p >= 0.5 for p in at_least), at_least[0]))
            s, g, p = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(g, pa.int32()), pa.array(p, pa.float64()), pa.array([x >= REJECT for x in p], pa.bool_())], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def without_toxic(docs: DataFrame, model: SeverityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the model doesn't reject.

    Each row is judged by its own text, repeated rows alike; a null or wordless text is judged by the thresholds alone, and
    so stays unless most labels are toxic. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, reader = shared.value, Reader(shared.value.weights)
        for b in batches:
            clean = [m.at_least(reader.link(t, m))[0] < REJECT for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Severity of the whole ``documents`` table under a model fitted on ``labels``, graded by ``label_grade``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return severity(docs, fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
