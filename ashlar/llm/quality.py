"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a short vector of transformed statistics (shares by logit,
counts by logarithm). Of every class the sums of the vectors and of their outer
products are enough, and they are added up over all labelled training rows on
the executors, so the fit sees every row and the driver a fixed few numbers.
Class covariances shrink towards the pooled diagonal; their Cholesky factors are
kept with the model, and a score is the logistic of the difference of the
Mahalanobis log-densities.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, holdout, table

SHRINKAGE = 0.1
FEATURES = ("words", "word_length", "word_length_spread", "distinct", "top_word", "repeats", "upper", "digits", "spaces", "stops", "commas", "marks", "symbols", "high_bytes", "lines", "line_repeats", "packing", "capitals", "ends")
_BYTES = np.arange(256)
_IS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digits": (_BYTES >= 48) & (_BYTES <= 57),
    "spaces": (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)),
    "high": _BYTES >= 128,
}
_IS["symbols"] = ~(_IS["upper"] | _IS["lower"] | _IS["digits"] | _IS["spaces"] | _IS["high"])


def _logit(k: float, n: float) -> float:
    return math.log((k + 0.5) / (max(n - k, 0.0) + 0.5))


def features(text: str | None) -> list[float]:
    """The statistics of one whole text; a null text is an empty one."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words = text.split()
    w = len(words)
    lengths = np.fromiter(map(len, words), np.int64, w) if w else np.zeros(1)
    tally = Counter(words)
    lines = text.split("\n")
    share = {k: int(counts[v].sum()) for k, v in _IS.items()}
    stops, commas, marks = int(counts[46]), int(counts[44]), int(counts[33] + counts[63])
    letters = share["upper"] + share["lower"] + share["high"]
    return [
        math.log1p(w),
        math.log1p(float(lengths.mean())),
        math.log1p(float(lengths.std())),
        _logit(len(tally), w) - 0.5 * math.log1p(w),
        _logit(max(tally.values(), default=0), w),
        _logit(sum(map(operator.eq, words, words[1:])), w),
        _logit(share["upper"], letters),
        _logit(share["digits"], n),
        _logit(share["spaces"], n),
        _logit(stops, w),
        _logit(commas, w),
        _logit(marks, w),
        _logit(share["symbols"] - stops - commas, n),
        _logit(share["high"], n),
        math.log1p(len(lines)),
        _logit(len(lines) - len(set(lines)), len(lines)),
        math.log((len(zlib.compress(raw, 1)) + 20.0) / (n + 20.0)),
        _logit(sum(map(str.istitle, words)), w),
        _logit(sum(1 for x in words if x[-1] in ".,;:"), w),
    ]


@dataclass
class Model:
    means: np.ndarray
    #: Inverse Cholesky factors of the class covariances, and the logarithms of their determinants.
    whiten: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        density = []
        for c in range(2):
            z = (x - self.means[c]) @ self.whiten[c].T
            density.append(-0.5 * (z * z).sum(1) - self.log_dets[c] + self.log_priors[c])
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "x": [features(t) for t in b["text"]]})


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of every row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_vectors, "doc_id long, x array<double>")


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for c, part in b.groupby("quality"):
            x = np.array(part["x"].tolist())
            flat = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
            yield pd.DataFrame({"quality": int(c), "i": range(len(flat)), "v": flat})


def fit(vecs: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """The model of all rows of ``vecs`` (doc_id, x) whose id has a label.

    ``labels`` has doc_id and quality; ids with both labels teach nothing, and
    a class without rows takes the mean and covariance of all.
    """
    agreed = labels.filter("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("q")).filter("quality = q").select("doc_id", "quality")
    sums = vecs.join(agreed, "doc_id").select("quality", "x").mapInPandas(_sums, "quality int, i int, v double")
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for r in sums.groupBy("quality", "i").agg(F.sum("v").alias("v")).collect():  # 2 * (1 + d + d * d) numbers
        total[r["quality"], r["i"]] = r["v"]
    n = total[:, 0]
    everything = total.sum(0)

    def moments(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = max(t[0], 1.0)
        mean = t[1 : 1 + d] / k
        return mean, t[1 + d :].reshape(d, d) / k - np.outer(mean, mean)

    pooled = np.diag(np.maximum(np.diag(moments(everything)[1]), 0.0) + 1e-6) if everything[0] else np.eye(d)
    means, factors = [], []
    for c in range(2):
        mean, cov = moments(total[c] if n[c] else everything)
        means.append(mean)
        factors.append(np.linalg.cholesky((1.0 - shrinkage) * cov + shrinkage * pooled + 1e-9 * np.eye(d)))
    eye = np.eye(d)
    return Model(np.array(means), np.array([np.linalg.solve(f, eye) for f in factors]), np.array([np.log(np.diag(f)).sum() for f in factors]), np.log((n + 1.0) / (n.sum() + 2.0)))


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """Model from the training fold of ``docs``, and the vectors of all its rows."""
    vecs = durable(vectors(docs), "quality-vectors")
    return fit(vecs.filter(holdout(F.col("doc_id"), 3) != 1), labels), vecs


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Only texts enter a score. Null and empty texts are scored as empty ones;
    rows that repeat score alike; without labels every score is 0.5.
    """
    model, vecs = train(docs, labels)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = model.scores(np.array(b["x"].tolist()).reshape(len(b), len(FEATURES)))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": s})

    out = vecs.mapInPandas(scored, "doc_id long, score double")
    return out.select("doc_id", (holdout(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score below ``least``, all columns kept."""
    model, _ = train(docs, labels)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))))

    return docs.filter(of(F.col("text")) >= least)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
