"""Quality classifier: regularised quadratic discriminant over text statistics.

Each whole text becomes ``D`` transformed statistics (logs, roots and ratios of
letter classes, words, repeated words, word pairs and lines).  One pass over
the labelled rows gathers, per class, the count, the sum and the sum of outer
products; from these come the class means and the shrinkage covariances

    S_c = (1 - a) * cov_c + a * cov_pooled,   then   (1 - g) * S_c + g * mean(diag S_c) * I

over standardised statistics.  A score is the logistic of the difference of the
two Mahalanobis log-densities (cached Cholesky factors) and the prior, divided
by ``TEMPERATURE``, as the statistics depend on one another.

Defined results: a null text is an empty one and is scored too; a null doc_id
is not held out; labels other than 0 and 1, null labels and repeated label
rows are ignored; if a class has no labelled row, every score is the smoothed
share of label 1 among the labelled rows (0.5 without any).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import id_text, settle

ALPHA, GAMMA, TEMPERATURE = 0.1, 0.01, 4.0
THRESHOLD = 0.7
HELD_OUT = (4, 2)            # crc32(doc_id) mod 4 = 2 is never learned from

# letter classes of code points below TOP; all others count as class 7
TOP = 0x250
UPPER, LOWER, DIGIT, SPACE, LINE, STOP, SYMBOL, OTHER = range(8)


def _classes() -> np.ndarray:
    out = np.full(TOP + 1, OTHER, dtype=np.uint8)
    for c in range(TOP):
        s = chr(c)
        out[c] = (LINE if s == "\n" else SPACE if s.isspace() else DIGIT if s.isdigit() else UPPER if s.isupper()
                  else LOWER if s.isalpha() else STOP if s in ".,;:'\"?()-" else SYMBOL)
    return out


CLASSES = _classes()
NAMES = ("log_chars", "log_words", "word_length", "upper", "digits", "lines", "stops", "symbols", "other",
         "word_variety", "pair_variety", "line_variety", "marked_words", "sentence_words")
D = len(NAMES)


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text."""
    n = len(text)
    kinds = np.zeros(8, dtype=np.int64)
    if n:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = np.bincount(CLASSES[np.minimum(codes, TOP)], minlength=8)
    words, lines = text.split(), text.split("\n")
    w = len(words)
    pairs = len(set(zip(words, words[1:])))
    visible = max(1, n - kinds[SPACE] - kinds[LINE])
    letters = max(1, kinds[UPPER] + kinds[LOWER] + kinds[OTHER])
    # ratios are drawn towards a usual text by a few pseudo-counts, so that
    # those of very short texts don't scatter
    return [
        math.log1p(n), math.log1p(w), math.log1p((visible + 100) / (w + 20)), math.sqrt((kinds[UPPER] + 2) / (letters + 60)),
        math.sqrt(kinds[DIGIT] / (n + 60)), math.sqrt((kinds[LINE] + 1) / (n + 100)), math.sqrt((kinds[STOP] + 2) / (visible + 60)),
        math.sqrt(kinds[SYMBOL] / (visible + 60)), math.sqrt(kinds[OTHER] / (n + 60)),
        math.log1p(len(set(words)) + 20) / math.log1p(w + 20), (pairs + 20) / (w + 20), (len(set(lines)) + 3) / (len(lines) + 3),
        math.sqrt(min(1.0, kinds[SYMBOL] / (w + 5))), math.log1p((w + 10) / (1 + text.count("."))),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, th, x)`` for every row; ``th``, the hash of the text, tells
    different texts under one doc_id apart."""
    df = id_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))

    def run(batches):
        for b in batches:
            x = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, type=pa.list_(pa.float64()))], ["doc_id", "th", "x"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, th bigint, x array<double>")


def held_out(doc_id) -> F.Column:
    mod, rest = HELD_OUT
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), D)


def moments(train: DataFrame) -> DataFrame:
    """``(y, pos, total)``: count, sums and outer products of each class; one
    short row per class and partition is shuffled."""
    def run(batches):
        acc = {0: np.zeros(1 + D + D * D), 1: np.zeros(1 + D + D * D)}
        for b in batches:
            x, y = _matrix(b.column(0)), np.asarray(b.column(1))
            for c in acc:
                xc = x[y == c]
                acc[c] += np.concatenate([[len(xc)], xc.sum(0), (xc.T @ xc).ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(acc), type=pa.int32()), pa.array([a.tolist() for a in acc.values()], type=pa.list_(pa.float64()))], ["y", "m"])

    parts = train.select("x", "y").mapInArrow(run, "y int, m array<double>")
    return parts.select("y", F.posexplode("m").alias("pos", "v")).groupBy("y", "pos").agg(F.sum("v").alias("total"))


class Model:
    """Means, inverse Cholesky factors and log-determinants of both classes."""

    def __init__(self, sums: dict[int, np.ndarray], alpha: float = ALPHA, gamma: float = GAMMA):
        n = {c: m[0] for c, m in sums.items()}
        total = sum(n.values())
        self.share = (n[1] + 1) / (total + 2)
        self.fitted = min(n.values()) >= 1
        if not self.fitted:
            return
        mean = {c: m[1:1 + D] / n[c] for c, m in sums.items()}
        cov = {c: m[1 + D:].reshape(D, D) / n[c] - np.outer(mean[c], mean[c]) for c, m in sums.items()}
        pooled = sum(n[c] * cov[c] for c in cov) / total
        every = sum(n[c] * mean[c] for c in mean) / total
        spread = np.sqrt(np.diag(pooled) + sum(n[c] * (mean[c] - every) ** 2 for c in mean) / total)
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        self.mean = {c: mean[c] / self.scale for c in mean}
        self.root, self.logdet = {}, {}
        for c in cov:
            s = ((1 - alpha) * cov[c] + alpha * pooled) / np.outer(self.scale, self.scale)
            s = (1 - gamma) * s + (gamma * max(np.trace(s) / D, 1e-3)) * np.eye(D)
            chol = np.linalg.cholesky(s)
            self.root[c] = np.linalg.inv(chol)
            self.logdet[c] = 2 * np.log(np.diag(chol)).sum()
        self.prior = math.log(n[1] / n[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        z, dens = x / self.scale, {}
        for c in (0, 1):
            dens[c] = -0.5 * ((((z - self.mean[c]) @ self.root[c].T) ** 2).sum(1) + self.logdet[c])
        gap = (dens[1] - dens[0] + self.prior) / TEMPERATURE
        return 0.5 * (1 + np.tanh(gap / 2))


def fit(feats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Learn from the labelled rows that are not held out."""
    y = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("y IN (0, 1)").distinct()
    train = feats.filter(~held_out(F.col("doc_id"))).join(y, "doc_id")
    sums = {c: np.zeros(1 + D + D * D) for c in (0, 1)}
    for r in moments(train).collect():          # 2 * (1 + D + D * D) numbers
        sums[r.y][r.pos] = r.total
    return Model(sums)


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, th, score)`` for every row of ``docs``."""
    feats = settle(features(docs, id_col, text_col))   # read twice: to learn and to score
    model = fit(feats, labels)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(model.score(_matrix(b.column(2))), type=pa.float64())], ["doc_id", "th", "score"])

    return feats.mapInArrow(run, f"doc_id {feats.schema['doc_id'].dataType.simpleString()}, th bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    return _scored(docs, labels, id_col, text_col).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, all columns as they were.  Rows of
    one doc_id, also a null one, are judged by their own texts."""
    bad = _scored(docs, labels, id_col, text_col).filter(~(F.col("score") >= threshold)).select(
        F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    th = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__id")) & (th == F.col("__th")), "left_anti")
