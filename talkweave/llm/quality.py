"""A quality classifier: kernel ridge regression by random Fourier features, calibrated by isotonic regression.

A text becomes ``FEATURES`` statistics (lengths, shares of character kinds, repetition).  They are standardised and mapped to
``COMPONENTS`` random cosines, whose inner products approximate a Gaussian kernel.  Every partition of the training rows sums its part of the
normal equations; the sums are added and solved once.  The scores of a calibration fold are made probabilities by pooling adjacent violators.

The model learns from a bounded sample of labelled rows (``MAX_TRAIN``, a parameter); scoring reads every row and whole
texts, in one pass without a shuffle.

Defined cases: null and empty texts have all-zero statistics and get a score; rows without a usable label teach nothing; with
repeated labels each counts; without any training row every score is 0.5; equal texts have equal scores.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import stage

MAX_TRAIN = 40_000       # labelled rows that the fit and the calibration may see
COMPONENTS = 256
WIDTH = 4.0              # of the kernel, in standardised units
RIDGE = 1e-3             # per training row
THRESHOLD = 0.3
FOLDS = 5                # crc32(id) mod 5: 0 is held out, 4 calibrates, the others fit
PARTS = 16               # partitions that sum the normal equations
SEED = 20

_KINDS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?",
                             b"|", b"#$%&*@^~", b"()[]{}<>", b"\"'`", b":;-_/\\=+"), start=1):
    for _c in _chars:
        _KINDS[_c] = _i
_KINDS[0x80:] = 14
N_KINDS = 15
FEATURES = N_KINDS + 11


def features(text: str | None) -> np.ndarray:
    """The statistics of a text."""
    x = np.zeros(FEATURES)
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    if not raw:
        return x
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    x[:N_KINDS] = np.bincount(_KINDS, weights=count, minlength=N_KINDS) / len(raw)
    w = raw.lower().split()
    if not w:
        return x
    n = len(w)
    kinds = Counter(w)
    lines = raw.split(b"\n")
    top = kinds.most_common(10)
    x[N_KINDS:] = (np.log1p(len(raw)), np.log1p(n), len(raw) / n, len(kinds) / n, sum(map(eq, w, w[1:])) / n, top[0][1] / n,
                   sum(c for _, c in top) / n, len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)),
                   sum(1 for k in w if len(k) == 1) / n, sum(c for k, c in kinds.items() if len(k) <= 3) / n)
    return x


class Model:
    """Standardisation, random cosines, ridge weights and calibration; small enough to travel with a task."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, spread
        self.turn = rng.normal(size=(FEATURES, COMPONENTS)) / WIDTH
        self.phase = rng.uniform(0, 2 * np.pi, COMPONENTS)
        self.weights = np.zeros(COMPONENTS + 1)
        self.knots, self.levels = np.array([0.5]), np.array([0.5])

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([np.sqrt(2 / COMPONENTS) * np.cos(z @ self.turn + self.phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots (mean score of a pool) and levels (its mean label), not decreasing."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []                        # sum of scores, sum of labels, rows
    for s, t in zip(score[order].tolist(), y[order].tolist()):
        pools.append([s, t, 1])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][2] == pools[-1][0] / pools[-1][2]
                                  or pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fold_of(doc_id) -> int:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % FOLDS


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t.as_py()) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["y", "fold", "x"])


def _matrix(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(b.column(b.schema.get_field_index("x")).flatten()).reshape(-1, FEATURES)
    return x, np.asarray(b.column(b.schema.get_field_index("y")), float)


def _summed(rows: DataFrame, size: int, part) -> np.ndarray:
    """The sum over all rows of what ``part`` gives for a batch; each partition sends one vector."""
    def run(batches):
        total = np.zeros(size)
        for b in batches:
            total += part(*_matrix(b))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["s"])
    return np.sum([r["s"] for r in rows.select("x", "y").mapInArrow(run, "s array<double>").collect()] or [np.zeros(size)], axis=0)


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(y, fold, x) of a bounded sample of the labelled rows that may be learnt from."""
    usable = (labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("of"), F.col("quality").cast("double").alias("y"), fold(F.col("doc_id")).alias("fold"))
              .filter("fold <> 0"))
    n = max(1, usable.count())
    sample = usable.filter(F.pmod(F.xxhash64("of", F.lit(SEED)), F.lit(1_000_000)) < int(1_000_000 * max_train / n))
    named = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(sample), F.col("id") == F.col("of"))   # at most max_train small rows
    return stage(named.select("text", "y", "fold").mapInArrow(_feature_rows, "y double, fold long, x array<double>"), "quality").coalesce(PARTS)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    rows = training_rows(docs, labels, max_train)
    d = COMPONENTS + 1
    moments = _summed(rows, 2 * FEATURES + 1, lambda x, y: np.r_[len(x), x.sum(0), (x * x).sum(0)])
    n = moments[0]
    if not n:
        return Model(np.zeros(FEATURES), np.ones(FEATURES))
    mean = moments[1:FEATURES + 1] / n
    spread = np.sqrt(np.maximum(moments[FEATURES + 1:] / n - mean * mean, 0))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0))

    def equations(x, y):
        z = model.cosines(x)
        return np.r_[(z.T @ z).ravel(), z.T @ y, len(x)]
    inner = rows.filter(F.col("fold") != FOLDS - 1)
    sums = _summed(inner, d * d + d + 1, equations)
    penalty = RIDGE * max(1.0, sums[-1]) * np.eye(d)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(sums[:d * d].reshape(d, d) + penalty, sums[d * d:-1])
    held = rows.filter(F.col("fold") == FOLDS - 1).select("x", "y").collect()               # part of the bounded sample
    if not held:
        held = rows.select("x", "y").collect()
    model.knots, model.levels = isotonic(model.raw(np.array([r["x"] for r in held])), np.array([r["y"] for r in held]))
    return model


def score_of(model: Model, text: Column) -> Column:
    """The score of a text column as an expression."""
    @F.pandas_udf(DoubleType())
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(model.score(np.array([features(x) for x in t])) if len(t) else [], dtype="float64")
    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(docs, labels, max_train)
    return (docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score_of(model, F.col("text")).alias("score"))
            .withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)))


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows that the classifier doesn't reject."""
    model = fit(docs, labels, max_train)
    return docs.filter(score_of(model, F.col("text")) >= THRESHOLD)
