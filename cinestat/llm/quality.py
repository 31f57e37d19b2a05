"""Quality classifier: regularised quadratic discriminant analysis.

Every document becomes a short vector of transformed statistics (lengths by
logarithms, shares by a square root, so that rare marks keep their resolution).
For each class the mean and the covariance are estimated from sums over all
training rows; a class covariance is shrunk first towards the pooled one and
then towards its own diagonal. The score comes from the difference of the two
log densities, each a Mahalanobis distance through the class's Cholesky factor
(computed once and kept with the model) plus its log determinant. A logistic
link on the difference, fitted on the training rows, turns it into a
probability, because Gaussian densities of many statistics are overconfident.

Training needs one pass: sums and outer products of D statistics per class, D by
D numbers, whatever the number of rows. Only these reach the driver.

Defined results: a null text counts as empty and has the statistics of an empty
text; a null label is no training row; repeated rows and ties are scored alike;
without training rows of both classes every score is the share of label 1 (0.5
without any); an empty table gives an empty table; labels, languages, sources
and ids are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinestat.llm.common import arrow_map, fresh, held_out, named, prepare, written

POOL_SHRINKAGE = 0.5
DIAGONAL_SHRINKAGE = 0.1
RIDGE = 1e-3
# of the link's slope, per training row: keeps it finite when the classes are separable
LINK_PENALTY = 1e-5
SYMBOLS = "#*$%&|<>{}[]=+~^\\_@/"
STATS = ("log_words", "word_length", "word_length_dev", "log_distinct", "distinct_share", "top_word_share", "again_share",
         "window_repeat_share", "upper_share", "shout_share", "symbol_share", "bang_share", "digit_share", "punct_share",
         "end_share", "odd_share", "line_repeat_share", "log_line_words")
_DROP_SYMBOLS = str.maketrans("", "", SYMBOLS)
_WORD_END = re.compile(r"[.?!](?=\s|$)")


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text, in the order of STATS."""
    words = text.split()
    n, chars = len(words), max(len(text), 1)
    if not n:
        return [0.0] * len(STATS)
    root = lambda a, b: math.sqrt(a / b) if b else 0.0
    sizes = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    raw = text.encode()
    b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper = int(b[65:91].sum())
    letters = upper + int(b[97:123].sum()) + int(b[195])
    symbols = sum(int(b[ord(c)]) for c in SYMBOLS)
    return [
        math.log1p(n), float(np.log(sizes.mean())), float(np.log1p(sizes.std())), math.log1p(len(counts)),
        len(counts) / n, root(max(counts.values()), n),
        root(sum(x == y for x, y in zip(words, words[1:], strict=False)), n),
        root(sum(v for v in windows.values() if v > 1), max(n - 2, 1)),
        root(upper, letters), root(sum(map(str.isupper, words)), n), root(symbols, chars), root(int(b[33]), chars),
        root(int(b[48:58].sum()), chars), root(int(b[44] + b[59] + b[58]), n), root(len(_WORD_END.findall(text)), n),
        root(int(b[:32].sum()) - int(b[10]), chars), root(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / max(len(lines), 1)),
    ]


@dataclass
class Discriminant:
    """Per class: mean, Cholesky factor, log determinant; and the link."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    prior: float
    slope: float = 1.0
    offset: float = 0.0

    def __post_init__(self):
        # of the triangular factors, once: a distance is then one product
        self.inverses = [np.linalg.inv(f) for f in self.factors]

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, outer: np.ndarray, pool: float = POOL_SHRINKAGE,
            diagonal: float = DIAGONAL_SHRINKAGE) -> Discriminant | None:
        if (counts < 2).any():
            return None
        means = sums / counts[:, None]
        scatter = outer - counts[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = scatter.sum(0) / (counts.sum() - len(counts))
        factors = []
        for s, n in zip(scatter, counts, strict=True):
            c = (1 - pool) * s / (n - 1) + pool * pooled
            c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c))
            factors.append(np.linalg.cholesky(c + RIDGE * np.diag(np.diag(pooled) + RIDGE)))
        f = np.array(factors)
        return cls(means, f, 2 * np.log(np.diagonal(f, axis1=1, axis2=2)).sum(1), math.log(counts[1] / counts[0]))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log p(x | 1) - log p(x | 0), a column of squared Mahalanobis
        distances per class."""
        d = [((g @ (x - m).T) ** 2).sum(0) + det for m, g, det in zip(self.means, self.inverses, self.log_dets, strict=True)]
        return 0.5 * (d[0] - d[1])

    def feature(self, x: np.ndarray) -> np.ndarray:
        """The difference, its tails drawn in by a signed root."""
        d = self.difference(x) + self.prior
        return np.sign(d) * np.sqrt(np.abs(d))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.feature(x) + self.offset, -30, 30)))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) with one array of statistics per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return arrow_map(docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")), run,
                     "doc_id long, x array<double>")


def training_rows(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """(label, x): each document with a label, outside the held-out fold."""
    marked = (labels.select(named(id_col).cast("long").alias("doc_id"), named(label_col).cast("int").alias("label"))
              .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct())
    return stats.join(marked, "doc_id").select("label", "x")


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, o = np.zeros(2), np.zeros((2, dim)), np.zeros((2, dim, dim))
        for b in batches:
            label = b.column("label").to_numpy()
            x = b.column("x").flatten().to_numpy().reshape(-1, dim)
            for c in (0, 1):
                part = x[label == c]
                n[c] += len(part)
                s[c] += part.sum(0)
                o[c] += part.T @ part
        yield pa.RecordBatch.from_pydict({"label": pa.array([0, 1], pa.int32()), "v": [[float(n[c]), *s[c], *o[c].ravel()] for c in (0, 1)]})
    return run


def _link_sums(model: Discriminant, dim: int):
    """Gradient and Hessian of the logistic link at the model's slope and
    offset, and the number of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(6)
        for b in batches:
            y = b.column("label").to_numpy()
            x = b.column("x").flatten().to_numpy().reshape(-1, dim)
            f, p = model.feature(x), model.score(x)
            w, e = p * (1 - p), y - p
            total += [(e * f).sum(), e.sum(), (w * f * f).sum(), (w * f).sum(), w.sum(), len(y)]
        yield pa.RecordBatch.from_pydict({"label": pa.array([0], pa.int32()), "v": [total.tolist()]})
    return run


def _added(rows: DataFrame, fn) -> dict[int, np.ndarray]:
    """The tasks' vectors of fixed length, added up by class."""
    found = arrow_map(rows, fn, "label int, v array<double>").select("label", F.posexplode("v").alias("i", "v"))
    out: dict[int, dict[int, float]] = {}
    for r in found.groupBy("label", "i").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["label"], {})[r["i"]] = r["v"]
    return {c: np.array([v[i] for i in range(len(v))]) for c, v in out.items()}


def fit(rows: DataFrame, pool: float = POOL_SHRINKAGE, diagonal: float = DIAGONAL_SHRINKAGE,
        steps: int = 6) -> Discriminant | float:
    """The model of all training rows (label, x); a share of label 1 if a
    class is missing."""
    dim = len(STATS)
    v = _added(rows, _sums(dim))
    if not v:
        return 0.5
    a = np.array([v[0], v[1]])
    model = Discriminant.fit(a[:, 0], a[:, 1:dim + 1], a[:, dim + 1:].reshape(2, dim, dim), pool, diagonal)
    if model is None:
        n = a[:, 0]
        return float(n[1] / n.sum()) if n.sum() else 0.5
    model.slope = 0.5
    for _ in range(steps):  # Newton steps, each one pass over the short vectors
        g0, g1, h00, h01, h11, n = _added(rows, _link_sums(model, dim))[0]
        hold = LINK_PENALTY * n
        step = np.linalg.solve([[h00 + hold, h01], [h01, h11 + hold]], [g0 - hold * model.slope, g1 - hold * model.offset])
        model.slope, model.offset = max(model.slope + step[0], 1e-3), model.offset + step[1]
    return model


def score(stats: DataFrame, model: Discriminant | float) -> DataFrame:
    """(doc_id, score)."""
    dim = len(STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, dim)
            s = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return arrow_map(stats, run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality") -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    prepare(docs.sparkSession)
    stats = written(document_statistics(docs, id_col, text_col), "quality-stats")
    rows = written(training_rows(stats, labels, label_col), "quality-training")
    return score(stats, fit(rows))


def keep_good(docs: DataFrame, labels: DataFrame, limit: float, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality") -> DataFrame:
    """``docs`` without documents that score below ``limit``, all columns as
    they are. Every row is judged by its own text: the statistics are written as
    a column beside it, and the model filters on that column."""
    prepare(docs.sparkSession)
    (x,) = fresh(docs, "x")

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t or "") for t in texts])

    rows = written(docs.withColumn(x, measured(named(text_col))), "quality-stats")
    stats = rows.select(named(id_col).cast("long").alias("doc_id"), named(x).alias("x"))
    model = fit(written(training_rows(stats, labels, label_col), "quality-training"))
    dim = len(STATS)

    @F.pandas_udf("boolean")
    def good(values: pd.Series) -> pd.Series:
        v = np.concatenate(values.to_list()).reshape(-1, dim) if len(values) else np.zeros((0, dim))
        return pd.Series(np.full(len(v), model) if isinstance(model, float) else model.score(v)) >= limit

    return rows.where(good(named(x))).drop(x)
