"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes
log-count ratios.

The features of a text are its distinct character n-grams (lower case, hashed
into ``buckets``). From the training rows every n-gram gets the log ratio of its
smoothed document frequencies in the two classes; the n-grams with the largest
evidence are kept, and a logistic regression is trained on presence times ratio
(Wang & Manning's NB-SVM with a logistic loss). The model is one table of
weights over the buckets, a fixed size, which is broadcast; scoring is one pass
without a shuffle.

Training uses at most ``max_rows`` labelled rows of each class, those whose ids
hash lowest (a bounded sample, the same at every partitioning). Their distinct
n-grams are found in parallel; document frequencies are added up by Spark; only
the chosen n-grams' rows meet in the fitting task.

Defined results: a null text counts as empty; a text without n-grams is scored
by the intercept; a null label is no training row; repeated rows and ties are
scored alike; without training rows of both classes every score is the share of
label 1 (0.5 without any); an empty table gives an empty table; labels,
languages, sources and ids are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinestat.llm.common import arrow_map, held_out, named, prepare, written

BUCKETS = 1 << 20
SIZES = (3, 4, 5, 6)
MAX_ROWS = 2500
FEATURES = 8_000
MIN_DOCS = 3
L2 = 0.02
_CHUNK = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # 2^64 / golden ratio: Fibonacci hashing


def ngram_buckets(text: str, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Bucket numbers of the text's n-grams, in blocks; a blank is put at
    either end and white space counts as a blank."""
    t = f" {' '.join(text.lower().split())} "
    if len(t) < 3:
        return
    codes = np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.uint64)
    shift = np.uint64(64 - buckets.bit_length() + 1)
    for a in range(0, len(codes), _CHUNK):
        c = codes[a:a + _CHUNK + max(sizes) - 1]
        for n in sizes:
            if len(c) < n:
                continue
            m = min(len(c) - n + 1, _CHUNK)
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = (h + c[k:k + m]) * _MULTIPLIER
                h ^= h >> np.uint64(29)
            yield ((h * _MULTIPLIER) >> shift).astype(np.int64)


@dataclass
class Ratios:
    """feature: bucket -> feature number or -1; weight: per feature."""

    feature: np.ndarray
    weight: np.ndarray
    intercept: float
    sizes: tuple[int, ...] = SIZES

    def score(self, text: str) -> float:
        found = [f[f >= 0] for f in (self.feature[h] for h in ngram_buckets(text, self.sizes, len(self.feature)))]
        total = float(self.weight[np.unique(np.concatenate(found))].sum()) if found else 0.0
        return float(1 / (1 + np.exp(-np.clip(total + self.intercept, -30, 30))))


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, l2: float = L2,
                 steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights over presence of features times ``scale``, and an intercept:
    accelerated gradient steps on the mean loss, classes weighted alike."""
    index = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = labels.mean()
    c = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / len(labels)
    x = scale[index]
    longest = np.bincount(of, x * x, minlength=len(rows)).max(initial=0.0) + 1
    rate = 4 / longest
    w, b = np.zeros(len(scale)), 0.0
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        z = np.bincount(of, x * vw[index], minlength=len(rows)) + vb
        e = c * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        nw = vw - rate * (np.bincount(index, x * e[of], minlength=len(scale)) + l2 / len(labels) * vw)
        nb = vb - rate * e.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w * scale, float(b)


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, label, text): at most ``max_rows`` rows of each class, never of
    the held-out fold."""
    marked = (labels.select(named(id_col).cast("long").alias("doc_id"), named(label_col).cast("int").alias("label"))
              .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct())
    pick = None
    for c in (0, 1):
        top = marked.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        pick = top if pick is None else pick.unionByName(top)
    texts = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    # two ids and labels per class and row of the sample: 2 * max_rows rows. Of several texts or labels of an id always the same
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "label", "text")).alias("s")
    return texts.join(F.broadcast(pick), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "s.label", "s.text")


def _distinct_ngrams(sizes: tuple[int, ...], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, label, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "label", "text")), strict=True):
                parts = [np.unique(h) for h in ngram_buckets(t or "", sizes, buckets)]
                h = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "label": pa.array([label], pa.int32()),
                                                  "grams": pa.array([h], pa.list_(pa.int32()))})
    return run


def _class_counts(buckets: int):
    """Document frequencies of a task's rows, as sparse rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, buckets), np.int32)
        for b in batches:
            for label, grams in zip(b.column("label").to_pylist(), b.column("grams"), strict=True):
                n[label][grams.values.to_numpy()] += 1
        at = np.flatnonzero(n.any(0))
        for a in range(0, len(at), 1 << 16):
            g = at[a:a + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"gram": pa.array(g, pa.int64()), "n0": pa.array(n[0][g], pa.int32()),
                                              "n1": pa.array(n[1][g], pa.int32())})
    return run


def fit(sample: DataFrame, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS, features: int = FEATURES,
        l2: float = L2) -> Ratios | float:
    """The model of a bounded sample (doc_id, label, text); the share of label
    1 if a class is missing."""
    rows = written(arrow_map(sample, _distinct_ngrams(sizes, buckets), "doc_id long, label int, grams array<int>"),
                   "toxicity-sample")
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return n1 / (n0 + n1) if n0 + n1 else 0.5
    counts = arrow_map(rows.select("label", "grams"), _class_counts(buckets), "gram long, n0 int, n1 int").groupBy("gram").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ratio = F.log((F.col("n1") + 1) / F.lit(n1 + 2)) - F.log((F.col("n0") + 1) / F.lit(n0 + 2))
    # evidence of an n-gram: its ratio over the ratio's standard error
    error = F.sqrt(1 / (F.col("n1") + 1) + 1 / (F.col("n0") + 1))
    chosen = (counts.where(F.col("n0") + F.col("n1") >= MIN_DOCS).withColumn("ratio", ratio)
              .orderBy((F.abs("ratio") / error).desc(), "gram").limit(features))
    table = chosen.select("gram", "ratio").collect()  # at most `features` rows
    grams = np.array([r["gram"] for r in table], np.int64)
    feature = np.full(buckets, -1, np.int32)
    feature[grams] = np.arange(len(grams))
    scale = np.array([r["ratio"] for r in table])
    known = rows.sparkSession.sparkContext.broadcast(feature)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [], []
        for b in batches:
            for label, kept in zip(b.column("label").to_pylist(), b.column("kept"), strict=True):
                y.append(label)
                x.append(kept.values.to_numpy().astype(np.int64))
        w, b0 = fit_logistic(x, np.array(y), scale, l2)
        yield pa.RecordBatch.from_pydict({"w": pa.array([w.tolist()], pa.list_(pa.float64())), "b": pa.array([b0], pa.float64())})

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [known.value[g.values.to_numpy()] for g in b.column("grams")]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([k[k >= 0] for k in kept], pa.list_(pa.int32()))],
                                             names=["label", "kept"])

    # the sample's chosen features: 2 * max_rows rows of at most `features` numbers, fitted in one task
    small = arrow_map(rows.select("label", "grams"), choose, "label int, kept array<int>")
    got = arrow_map(small.repartition(1), train, "w array<double>, b double").first()
    return Ratios(feature, np.array(got["w"]), got["b"], sizes)


def score(docs: DataFrame, model: Ratios | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = [m if isinstance(m, float) else m.score(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return arrow_map(docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")), run,
                     "doc_id long, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    prepare(docs.sparkSession)
    return score(docs, fit(sample_rows(docs, labels, id_col, text_col, label_col, max_rows)), id_col, text_col)
