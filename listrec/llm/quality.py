"""Quality classifier: quadratic discriminant with shrunken class covariances.

Each text gives a vector of transformed statistics.  Per class, Spark sums the
vectors and their products over all labelled rows; the covariances are shrunk
towards the pooled one and its mean variance, and a text's score compares the two
Gaussian log densities through cached Cholesky factors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

NAMES = ("chars", "words", "word_length", "upper", "digits", "marks", "symbols", "variety", "repeats", "line_repeats", "foreign", "sentence", "short", "lines", "commonest", "word_spread")
PUNCTUATION = np.frombuffer(b".,;:'?-()\"", np.uint8)
SYMBOLS = np.frombuffer(b"|*#$%&!<>{}[]=+_~^\\/@", np.uint8)


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    bins = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    k = len(words)
    share = lambda c, of: math.sqrt(c / of) if of else 0.0
    if k:
        sizes = np.fromiter(map(len, words), np.int64, k)
        kinds: dict[bytes, int] = {}
        for w in words:
            kinds[w] = kinds.get(w, 0) + 1
        top, distinct = max(kinds.values()), len(kinds)
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        mean, spread, short = sizes.mean(), sizes.std(), int((sizes <= 3).sum())
    else:
        top = distinct = again = short = 0
        mean = spread = 0.0
    lines = [x for x in raw.split(b"\n") if x]
    return [
        math.log1p(n), math.log1p(k), math.log1p(float(mean)), share(int(bins[65:91].sum()), n), share(int(bins[48:58].sum()), n),
        share(int(bins[PUNCTUATION].sum()), n), share(int(bins[SYMBOLS].sum()), n), math.log1p(distinct) / math.log1p(k) if k else 1.0,
        share(again, k), share(len(lines) - len(set(lines)), len(lines)), share(int(bins[128:].sum()), n),
        math.log1p(k / (1 + int(bins[46]))), share(short, k), math.log1p(k / (1 + len(lines))), share(top, k), math.log1p(float(spread)),
    ]


def document_statistics(documents: DataFrame) -> DataFrame:
    """Per row: doc_id and ``x``, the statistics of the whole text."""
    return map_texts(documents, lambda texts: {"x": [statistics(t) for t in texts]}, "x array<double>")


@dataclass
class Discriminant:
    """Centre and scale, and per class the mean, inverse Cholesky factor, log determinant and log prior."""

    centre: np.ndarray
    scale: np.ndarray
    classes: list[tuple[np.ndarray, np.ndarray, float, float]]
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; 0.5 where nothing was learned."""
        if len(self.classes) < 2:
            return np.full(len(x), self.classes[0][0][0] if self.classes else 0.5)
        z, log = (x - self.centre) / self.scale, []
        for mean, inverse, det, prior in self.classes:
            log.append(prior - det / 2 - (((z - mean) @ inverse.T) ** 2).sum(1) / 2)
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) * self.temper, -500, 500)))


def fit(rows: DataFrame, to_pooled: float = 0.15, to_identity: float = 0.02, temper: float = 0.5) -> Discriminant:
    """Fit on all rows with ``x`` and ``label`` (0 or 1); Spark sums, the driver gets two rows.

    The class covariance is (1 - a - b) own + a pooled + b mean variance.
    ``temper`` flattens the log-density difference, whose tails are too sure.  With
    one class only, every score is that label; without rows it is 0.5.
    """
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]
    found = {r["label"]: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), *sums).collect()}
    if len(found) < 2:
        return Discriminant(np.zeros(d), np.ones(d), [(np.array([float(k)]), np.eye(1), 0.0, 0.0) for k in found], temper)
    n = {k: r["n"] for k, r in found.items()}
    means, covs = {}, {}
    for k, r in found.items():
        means[k] = np.array([r[f"s{i}"] for i in range(d)]) / n[k]
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"] / n[k]
        covs[k] = second - np.outer(means[k], means[k])
    total = n[0] + n[1]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / total
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    centre = (n[0] * means[0] + n[1] * means[1]) / total
    pooled = pooled / np.outer(scale, scale)
    classes = []
    for k in (0, 1):
        own = covs[k] / np.outer(scale, scale)
        mixed = (1 - to_pooled - to_identity) * own + to_pooled * pooled + to_identity * max(np.trace(own) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(mixed + 1e-9 * np.eye(d))
        classes.append(((means[k] - centre) / scale, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()), math.log(n[k] / total)))
    return Discriminant(centre, scale, classes, temper)


def score(statistics_rows: DataFrame, model: Discriminant) -> DataFrame:
    """Per row: doc_id, ``score`` from 0 to 1 and ``predicted`` (1 from 0.5 on).

    Null and empty texts have the statistics of an empty text.  Rows are
    independent; an empty table gives an empty result.
    """

    @F.pandas_udf("double")
    def probability(x):
        import pandas as pd

        return pd.Series(model.score(np.stack(x.to_list())) if len(x) else [], dtype=float)

    scored = statistics_rows.select("doc_id", probability("x").alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
