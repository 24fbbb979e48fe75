"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics (``FEATURES``). Per class, the mean and the
covariance are estimated from labelled documents; the covariance is shrunk toward the pooled diagonal.
A document's score is the logistic of the difference of the two Mahalanobis log-densities plus the log
prior odds, with each class's Cholesky factor computed once.

Spark computes the statistics in the tasks and sums counts, vectors and outer products; the driver gets
one row per class of the label, 1 + d + d (d + 1) / 2 numbers, whatever the corpus holds. Nothing else
is shuffled but ids and vectors of labelled rows.

Defined results: a null text counts as empty; an empty text has a vector and a score like any other;
repeated rows are scored one by one, and a repeated label counts as often as it stands. With fewer than
``MIN_ROWS`` labelled rows in a class there is nothing to learn: the score is the share of label 1
among the labels (0.5 without any). Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import keep

FEATURES = (
    "log_words", "mean_word", "spread_word", "upper", "digit", "symbol", "punctuation", "shout",
    "repeat_words", "adjacent_repeats", "common_words", "line_repeats", "bars", "capital_words",
)
#: Share of the pooled diagonal in each class covariance, at least; grows when rows are few.
SHRINKAGE = 0.1
MIN_ROWS = 5
THRESHOLD = 0.7
#: Log-odds are divided by this and bounded before the logistic; the order of documents is the same.
TEMPERATURE = 4.0

#: Frequent short words of the corpus languages. Fixed values.
COMMON = frozenset(
    b"the of and to in is that for it with was this on by from are or be as at an a "
    b"der die und das von zu den mit ist ein auf im eine nicht dem des sich als auch "
    b"de la le et les des un une que en du dans est pour qui sur par pas au avec "
    b"el y los del se las por para con no lo su al una".split()
)
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,;:!?'\"()-"


def _share_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars, np.uint8)] = True
    return table


_UPPER, _DIGIT = _share_table(bytes(range(65, 91))), _share_table(b"0123456789")
_SYMBOL, _PUNCT = _share_table(SYMBOLS), _share_table(PUNCTUATION)


def statistics(data: bytes) -> list[float]:
    """The vector of one text in UTF-8."""
    words = data.split()
    n = len(words)
    if n == 0:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = sum(map(len, words))
    lengths = np.fromiter(map(len, words), np.float64, n)
    lower = [w.strip(PUNCTUATION).lower() for w in words]
    lines = [x for x in data.split(b"\n") if x.strip()]
    shares = [
        counts[_UPPER].sum() / chars,
        counts[_DIGIT].sum() / chars,
        counts[_SYMBOL].sum() / chars,
        counts[_PUNCT].sum() / chars,
        sum(map(bytes.isupper, words)) / n,
        1 - len(set(lower)) / n,
        sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / n,
        sum(w in COMMON for w in lower) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        words.count(b"|") / n,
        sum(w[:1].isupper() for w in words) / n,
    ]
    # shares are spread out near 0, where documents differ
    return [float(np.log1p(n)), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std()))] + [
        float(np.sqrt(x)) for x in shares
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t or b"") for t in texts])


def features_of(text: str) -> Column:
    """The vector of a text column: array<double> in the order of ``FEATURES``."""
    return _features(F.col(text).cast("binary"))


def document_vectors(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, features."""
    return docs.select(F.col(id_col), features_of(text).alias("features"))


@dataclass(frozen=True)
class Discriminant:
    """Per class (0, 1): log prior, mean, inverse Cholesky factor, log-determinant."""

    prior: tuple[float, ...]
    mean: tuple[np.ndarray, ...]
    whitener: tuple[np.ndarray, ...]
    log_det: tuple[float, ...]
    constant: float | None = None  # the score, if nothing could be learnt

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        side = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.whitener[k].T
            side.append(self.prior[k] - 0.5 * (self.log_det[k] + np.einsum("ij,ij->i", z, z)))
        return side[1] - side[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / TEMPERATURE, -50, 50)))


def fit(vectors: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", shrinkage: float = SHRINKAGE) -> Discriminant:
    """Learns from every labelled row of ``labels`` (id, label 0 or 1) that has a vector."""
    d = len(FEATURES)
    rows = vectors.join(labels.where(F.col(label).isin(0, 1)).select(id_col, F.col(label).alias("_y")), id_col)
    f = [F.get("features", F.lit(i)) for i in range(d)]
    sums = [F.sum(x) for x in f]
    products = [F.sum(f[i] * f[j]) for i in range(d) for j in range(i + 1)]
    got = {
        r["_y"]: (r["n"], np.array(r["s"]), np.array(r["p"]))
        for r in rows.groupBy("_y").agg(F.count("*").alias("n"), F.array(*sums).alias("s"), F.array(*products).alias("p")).collect()
    }
    n = {k: got[k][0] if k in got else 0 for k in (0, 1)}
    if min(n.values()) < MIN_ROWS:
        share = n[1] / max(1, n[0] + n[1]) if n[0] + n[1] else 0.5
        return Discriminant((), (), (), (), share)
    means, covs = [], []
    for k in (0, 1):
        count, s, p = got[k]
        square = np.zeros((d, d))
        square[np.tril_indices(d)] = p
        square += np.tril(square, -1).T
        mean = s / count
        means.append(mean)
        covs.append(square / count - np.outer(mean, mean))
    whole = n[0] + n[1]
    pooled = np.diag((n[0] * np.diag(covs[0]) + n[1] * np.diag(covs[1])) / whole + 1e-6)
    whiteners, dets = [], []
    for k in (0, 1):
        a = max(shrinkage, d / (d + n[k]))
        factor = np.linalg.cholesky((1 - a) * covs[k] + a * pooled)
        whiteners.append(np.linalg.inv(factor))
        dets.append(2 * float(np.log(np.diag(factor)).sum()))
    prior = tuple(float(np.log(n[k] / whole)) for k in (0, 1))
    return Discriminant(prior, tuple(means), tuple(whiteners), tuple(dets))


def score(vectors: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """``vectors`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""

    @F.pandas_udf("double")
    def scores(features: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(features.tolist(), np.float64).reshape(len(features), -1)))

    return vectors.withColumn("score", scores("features")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score, predicted, for every document; learnt from all of ``labels``."""
    vectors = keep(document_vectors(docs, id_col, text), "vectors")
    return score(vectors, fit(vectors, labels, id_col=id_col)).drop("features")
