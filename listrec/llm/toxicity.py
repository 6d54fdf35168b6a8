"""Toxicity: a linear classifier regularised by counterfactual identity swaps.

Features are the presence of words and of word beginnings, hashed.  Labelled
texts that mention a group are also seen with every identity term replaced by
another of its list; besides the logistic loss and the ridge, the squared change
of score between a text and its swapped form is penalised, so that a neutral
mention of a group carries no weight of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts

# Identity terms; a term is swapped for the next of its list.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male", "transgender", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"), ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("mexican", "american", "chinese", "german", "french", "spanish"), ("immigrants", "refugees", "natives", "foreigners"),
    ("deaf", "blind", "disabled", "autistic"), ("old", "young", "elderly"),
    ("mujeres", "hombres", "chicas", "chicos"), ("mujer", "hombre", "chica", "chico"), ("musulmanes", "cristianos", "judíos"),
    ("femmes", "hommes", "filles", "garçons"), ("femme", "homme", "fille", "garçon"), ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer", "mädchen", "jungen"), ("frau", "mann"), ("muslime", "christen", "juden"),
)
SWAP = {t: terms[(i + 1) % len(terms)] for terms in IDENTITY for i, t in enumerate(terms)}
WORD = re.compile(r"[^\W\d_]+")
BITS = 20
STEMS = range(3, 9)
CACHE = 200_000


class Hasher:
    """Feature ids of words, remembered for the words seen last."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, w: str) -> tuple[int, ...]:
        ids = self.known.get(w)
        if ids is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            names = {w, *(w[:k] + "*" for k in STEMS if len(w) >= k)}
            ids = self.known[w] = tuple(xxhash.xxh64_intdigest(x) & ((1 << BITS) - 1) for x in names)
        return ids

    def ids(self, words: set[str]) -> np.ndarray:
        """Sorted distinct feature ids."""
        return np.array(sorted({i for w in words for i in self.word(w)}), np.int32)


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def swapped(words: set[str]) -> set[str] | None:
    """The words with every identity term swapped; None without any."""
    return {SWAP.get(w, w) for w in words} if not words.isdisjoint(SWAP) else None


@dataclass
class Linear:
    """Weights of the selected features (sorted ids) and the bias."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        at = np.searchsorted(self.ids, found)
        at[at == len(self.ids)] = 0
        z = self.bias + (float(self.weights[at][self.ids[at] == found].sum()) if len(self.ids) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def sample(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """The labelled texts to learn from, one an id: at most ``rows``, the first by hash of the id.

    Of texts that share an id the least is taken.
    """
    chosen = labels.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def chosen_features(found: DataFrame, n: int, pos: int, features: int) -> np.ndarray:
    """(id, texts with it, toxic texts with it) of the features with the largest chi-square, by id.

    The counts are summed on the executors; only the chosen rows reach the driver.
    """
    counts = found.select("label", F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").cast("double").alias("df"), F.sum("label").cast("double").alias("hit"))
    expect = F.col("df") * F.lit(pos / n)
    off = (F.col("hit") - expect) ** 2
    chi = off / F.greatest(expect, F.lit(1e-9)) + off / F.greatest(F.col("df") - expect, F.lit(1e-9))
    best = counts.filter("df >= 3").withColumn("chi", chi).filter("chi > 3.8").orderBy(F.desc("chi"), "id").limit(features)
    return np.array(sorted(map(tuple, best.select("id", "df", "hit").collect())), float).reshape(-1, 3)


def fit(documents: DataFrame, labels: DataFrame, rows: int = 8_000, features: int = 20_000, ridge: float = 0.02, swap: float = 1.0, steps: int = 300) -> Linear:
    """Fit on at most ``rows`` labelled texts (``labels``: doc_id, label).

    Executors turn the texts to feature ids and count them; the driver gets the
    ids of chosen features only.  The ``features`` with the largest chi-square among
    those in three texts or more are kept, scaled by their smoothed log-odds, and
    accelerated gradient steps minimise the loss.  An id counts once, with its highest
    label.  Without labels of both kinds every score is the smoothed share of label
    1, 0.5 without any.
    """
    hasher = Hasher()

    def work(texts: list[str | None]) -> dict[str, list]:
        words = [words_of(t) for t in texts]
        other = [swapped(w) for w in words]
        return {"ids": [hasher.ids(w).tolist() for w in words], "other": [hasher.ids(w).tolist() if w is not None else None for w in other]}

    found = cut(map_texts(sample(documents, labels, rows), work, "ids array<int>, other array<int>", keep=("doc_id", "label")), "labelled")
    size = found.agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    n, pos = size["n"], size["pos"] or 0
    prior = float(np.log((pos + 0.5) / (n - pos + 0.5)))
    if pos in (0, n):
        return Linear(np.empty(0, np.int32), np.empty(0), prior)
    best, df, hit = chosen_features(found, n, pos, features).T
    best = best.astype(np.int32)
    odds = np.log((hit + 0.5) / (pos + 1)) - np.log((df - hit + 0.5) / (n - pos + 1))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [[None if x is None else np.nonzero(np.isin(best, x))[0].astype(np.int32).tobytes() for x in b.column(c).to_pylist()] for c in ("ids", "other")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), *(pa.array(c, pa.binary()) for c in columns)], ["doc_id", "label", "ids", "other"])

    taken = found.mapInArrow(known, "doc_id long, label int, ids binary, other binary").collect()
    taken.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in taken], float)
    ids = [np.frombuffer(r["ids"], np.int32) for r in taken]

    def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        c = np.concatenate(rows) if rows else np.empty(0, np.int32)
        return np.repeat(np.arange(len(rows), dtype=np.int32), [len(i) for i in rows]), c

    row, col = sparse(ids)
    pairs = [k for k, r in enumerate(taken) if r["other"] is not None]
    minus = sparse([np.frombuffer(taken[k]["other"], np.int32) for k in pairs])
    plus = sparse([ids[k] for k in pairs])
    d, m = len(best), len(pairs)
    dot = lambda w, r, c, k: np.bincount(r, w[c] * odds[c], k)
    back = lambda v, r, c: np.bincount(c, v[r] * odds[c], d)
    w, b = np.zeros(d), prior
    ahead_w, ahead_b, t = w, b, 1.0
    lipschitz = np.bincount(row, odds[col] ** 2, n).max() / 4 + ridge + 0.25 + (2 * swap * (np.bincount(plus[0], odds[plus[1]] ** 2, m).max() + np.bincount(minus[0], odds[minus[1]] ** 2, m).max()) if m else 0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(dot(ahead_w, row, col, n) + ahead_b, -500, 500)))
        g = back((p - y) / n, row, col) + ridge / n * ahead_w
        if m:
            change = (dot(ahead_w, *plus, m) - dot(ahead_w, *minus, m)) * 2 * swap / m
            g += back(change, *plus) - back(change, *minus)
        step = 1 / lipschitz
        new_w, new_b = ahead_w - step * g, ahead_b - step * float((p - y).mean())
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead_w, ahead_b = new_w + (t - 1) / s * (new_w - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new_w, new_b, s
    return Linear(best, w * odds, float(b))


def score(documents: DataFrame, model: Linear, keep: tuple[str, ...] = ("doc_id",), text: bool = False) -> DataFrame:
    """Per row: the ``keep`` columns, ``score`` from 0 to 1 and ``predicted`` (1 from 0.5 on).

    With ``text`` the texts come along.
    Null and empty texts have no features and get the bias alone.  Rows are
    independent; an empty table gives an empty result.
    """
    hasher = Hasher()
    scored = map_texts(documents, lambda texts: {"score": [model.score(hasher.ids(words_of(t))) for t in texts]}, "score double", keep=(*keep, "text") if text else keep)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
