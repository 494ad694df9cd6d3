"""Regularised quadratic discriminant analysis on document statistics.

Each text gives a vector of transformed counts (logarithms of smoothed rates, so that short texts lie near the middle). For
each class: mean and shrunken covariance ``(1 - a) S_class + a S_pooled`` plus a small ridge, kept as its Cholesky factor. The
share ``a`` of the pooled covariance is estimated for each class, as the sampling variance of ``S_class`` over its squared
distance from the pooled one (at most 1). A score is the logistic of the difference of the two log densities (Mahalanobis
distance by a triangular solve with the cached factor, and the log determinant), scaled by two numbers fitted on the same rows.

The model is fitted on the rows of at most ``max_labelled`` labelled ids, those with the least hash of their id; everything else
reads all documents. Those rows' vectors are a written table; Spark gathers from it, for each class, the sums of vectors and
of their products, then the fourth powers of the distances, then how many rows have each density difference (in steps of 0.01),
so the driver gets a fixed number of sums however often an id is repeated.

Defined results: a null or empty text has the vector of no counts and a score like any other; labels that are null or of a
null id are ignored and several labels of one id count as their majority; if a class has no labelled rows all scores are the
share of label 1 (one half without labels). Repeated rows and extra columns are kept; columns named like the results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import crc_fold, staged, table

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#*$%&|<>{}[]@\\^~_="
_MARK = b".,;:?'\"-()"
N_FEATURES = 14


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), sum(map(len, words))
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    rate = lambda c, of, c0, n0: math.log((c + c0) / (of + n0))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower = count(_UPPER), count(_LOWER)
    return [
        math.log1p(n),
        math.log((size + 60) / (n + 10)),
        rate(count(_SYMBOL), n, 0.5, 20),
        rate(upper, upper + lower, 2, 100),
        rate(count(_DIGIT), size, 2, 200),
        rate(count(_MARK), n, 2, 20),
        rate(raw.count(b"!"), n, 0.5, 20),
        rate(words.count(b"|"), n, 0.5, 20),
        rate(sum(map(bytes.__eq__, words, words[1:])), n, 0.5, 20),
        math.log1p(len(set(words))) - math.log1p(n),
        rate(len(lines) - len(set(lines)), len(lines), 0.5, 5),
        rate(size - len(raw.translate(None, bytes(range(128)))), size, 2, 100),
        rate(sum(w.endswith((b".", b"!", b"?")) for w in words), n, 1, 20),
        rate(sum(len(w) > 25 for w in words), n, 0.5, 20),
    ]


def _squash(d: np.ndarray) -> np.ndarray:
    return np.arcsinh(d / 2)


class Model:
    """Means, Cholesky factors and log determinants of the classes, and the scale of the scores."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, products: np.ndarray, ridge: float = 1e-3) -> None:
        """Counts, sums of vectors and sums of their outer products by class."""
        self.n, self.share = n, (n[1] + 1) / (n.sum() + 2)
        self.factors: list[tuple[np.ndarray, float]] = []
        self.a, self.b = 1.0, math.log(self.share / (1 - self.share))
        self.ready = n.min() >= 2
        if self.ready:
            self.means = sums / n[:, None]
            self.own = products / n[:, None, None] - self.means[:, :, None] * self.means[:, None, :]
            self.pooled = (n[:, None, None] * self.own).sum(axis=0) / n.sum()
            self.ridge = (ridge * np.trace(self.pooled) / sums.shape[1] + 1e-9) * np.eye(sums.shape[1])

    def shrink(self, fourth: np.ndarray) -> None:
        """fourth: by class, the sum of the fourth powers of the rows' distances from the class's mean."""
        for c in (0, 1):
            square = (self.own[c] ** 2).sum()
            spread = max(0.0, fourth[c] / self.n[c] - square) / self.n[c]  # the sampling variance of the covariance
            apart = ((self.own[c] - self.pooled) ** 2).sum()
            share = min(1.0, spread / apart) if apart > 0 else 1.0
            factor = np.linalg.cholesky((1 - share) * self.own[c] + share * self.pooled + self.ridge)
            self.factors.append((factor, float(np.log(np.diag(factor)).sum())))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density under label 1 less that under label 0."""
        told = []
        for mean, (factor, half_det) in zip(self.means, self.factors):
            z = x - mean
            for k in range(z.shape[1]):  # solved in place, for all rows at once
                z[:, k] = (z[:, k] - z[:, :k] @ factor[k, :k]) / factor[k, k]
            told.append(-0.5 * (z * z).sum(axis=1) - half_det)
        return told[1] - told[0]

    def fit_scale(self, x: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> None:
        """Logistic fit by Newton steps: so many rows of each label at squashed differences x."""
        x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
        for _ in range(25):
            p = 1 / (1 + np.exp(-(x @ w)))
            at = (x * ((ones + zeros) * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            w += np.linalg.solve(at, x.T @ (ones - (ones + zeros) * p) - 1e-3 * w)
        self.a, self.b = float(max(w[0], 1e-3)), float(w[1])

    def score(self, texts: pd.Series) -> np.ndarray:
        if not self.ready:
            return np.full(len(texts), self.share)
        x = np.array([statistics(t) for t in texts]).reshape(-1, N_FEATURES)
        return 1 / (1 + np.exp(-(self.a * _squash(self.difference(x)) + self.b)))


STEP = 0.01  # of the squashed differences that the scale is fitted on


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = 40_000) -> Model:
    told = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    told = told.orderBy(F.xxhash64("_key"), "_key").limit(max_labelled)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(told), "_key")  # max_labelled ids at most

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["_y"].to_numpy(), "x": [statistics(t) for t in pdf["_text"]]})

    known = staged(rows.select("_text", "_y").mapInPandas(vectors, "y int, x array<double>"), "labelled-vectors")

    def sums(of, size: int) -> np.ndarray:
        """By class: the sum over its rows of what ``of`` makes of their vectors (a row of ``size`` numbers each)."""

        def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((2, size))
            for pdf in batches:
                y, x = pdf["y"].to_numpy(), np.array(pdf["x"].tolist()).reshape(-1, N_FEATURES)
                for c in (0, 1):
                    if (y == c).any():
                        total[c] += of(c, x[y == c])
            yield pd.DataFrame({"y": np.repeat([0, 1], size), "k": np.tile(np.arange(size), 2), "v": total.ravel()})

        out = np.zeros((2, size))
        got = known.mapInPandas(gather, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).toPandas()  # 2 * size rows
        out[got["y"], got["k"]] = got["v"]
        return out

    d = N_FEATURES
    moments = sums(lambda c, x: np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()]), 1 + d + d * d)
    model = Model(moments[:, 0], moments[:, 1 : 1 + d], moments[:, 1 + d :].reshape(2, d, d))
    if not model.ready:
        return model
    means = model.means
    model.shrink(sums(lambda c, x: (((x - means[c]) ** 2).sum(axis=1) ** 2).sum(keepdims=True), 1)[:, 0])

    def differences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["x"].tolist()).reshape(-1, N_FEATURES)
            yield pd.DataFrame({"y": pdf["y"], "at": np.round(_squash(model.difference(x)) / STEP).astype(np.int64)})

    counts = known.mapInPandas(differences, "y long, at long").groupBy("at").agg(F.sum("y").alias("ones"), F.count("*").alias("n")).orderBy("at").toPandas()  # some thousands of steps at most
    model.fit_scale(counts["at"].to_numpy() * STEP, counts["ones"].to_numpy(float), (counts["n"] - counts["ones"]).to_numpy(float))
    return model


def score(model: Model, text: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts))

    return of(text)


def classify(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """Adds held_out (the fold of the id is 0: its label is not learnt), score and predicted."""
    fold = F.coalesce(crc_fold(key, folds) == 0, F.lit(False))
    model = fit(docs, labels.where(~fold), key=key, text=text)
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    out = docs.select(*rest, fold.alias("held_out"), score(model, F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")
