"""Language identification by rank-order profiles of character n-grams.

Each language's profile lists its most frequent n-grams (1 to 3 letters, words
bounded by a blank) in order of frequency.  A document's own most frequent
n-grams are compared with each profile by out-of-place distance: the sum over
its n-grams of the difference in rank, or the profile's size for an n-gram that
the profile lacks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts

PROFILE = 300
SALTS = 8
BLANK = 32
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a whole text; no letter gives none.

    A code packs up to three code points of 21 bits.  Everything that is not a
    letter counts as one blank; n-grams do not run across words.
    """
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    a = np.concatenate(([BLANK], np.where(letters()[a], a, BLANK), [BLANK]))
    blank = a == BLANK
    a = a[np.concatenate(([True], ~(blank[1:] & blank[:-1])))]
    if len(a) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    blank = a == BLANK
    two = (a[:-1] << 21) | a[1:]
    three = ((two[:-1] << 21) | a[2:])[~blank[1:-1]]
    codes, counts = np.unique(np.concatenate((a[~blank], two, three)), return_counts=True)
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, ties by smaller code."""
    return codes[np.lexsort((codes, -counts))[:size]]


def learn_profiles(documents: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Profile of each non-null ``lang``, from all the given rows.

    Counts are summed per (language, n-gram) after each task has added up its own.
    The driver receives at most SALTS x ``size`` n-grams a language.  Repeated rows
    count again; null and empty texts have no n-grams; an empty table gives no profile.
    """

    def count(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            parts: dict[str, list] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                parts.setdefault(lang, []).append(ngrams(text))
            for lang, grams in parts.items():
                grams += [total[lang]] if lang in total else []
                codes, back = np.unique(np.concatenate([g[0] for g in grams]), return_inverse=True)
                total[lang] = codes, np.bincount(back, np.concatenate([g[1] for g in grams]), len(codes)).astype(np.int64)
                if len(codes) > 1_000_000:  # hand on what has been added up, keep memory bounded
                    yield rows(lang, *total.pop(lang))
        for lang, (codes, counts) in total.items():
            yield rows(lang, codes, counts)

    def rows(lang, codes, counts):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])

    source = documents.filter(F.col("lang").isNotNull()).select("lang", "text")
    grams = source.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(SALTS))).orderBy(F.desc("n"), "gram")
    best = grams.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= size).select("lang", "gram", "n").collect()
    by: dict[str, list] = {}
    for lang, gram, n in best:
        by.setdefault(lang, []).append((-n, gram))
    return {lang: [g for _, g in sorted(found)[:size]] for lang, found in sorted(by.items())}


def distances(grams: np.ndarray, profiles: list[tuple[np.ndarray, np.ndarray]], size: int) -> list[int]:
    """Out-of-place distance of a document's ranked n-grams to each profile (sorted codes, their ranks)."""
    own, out = np.arange(len(grams)), []
    for codes, ranks in profiles:
        at = np.minimum(np.searchsorted(codes, grams), len(codes) - 1)
        out.append(int(np.where(codes[at] == grams, np.minimum(np.abs(ranks[at] - own), size), size).sum()))
    return out


def identify(documents: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """Per row: doc_id, ``lang_pred`` and ``score`` (1 less the distance as a share of the greatest).

    Null texts, texts without a letter, and any text when no language was learned
    give ``und`` and 0.  Ties go to the language that sorts first.  Very long
    texts are counted whole; repeated rows give repeated results.
    """
    names = list(profiles)
    kept = []
    for n in names:
        codes = np.array(profiles[n], np.int64)
        order = np.argsort(codes)
        kept.append((codes[order], order))

    def work(texts: list[str | None]) -> dict[str, list]:
        langs, scores = [], []
        for t in texts:
            grams = ranked(*ngrams(t), size)
            if not len(grams) or not names:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            d = distances(grams, kept, size)
            best = int(np.argmin(d))
            langs.append(names[best])
            scores.append(1 - d[best] / (size * len(grams)))
        return {"lang_pred": langs, "score": scores}

    return map_texts(documents, work, "lang_pred string, score double")
