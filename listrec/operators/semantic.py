"""Semantic ids: items as series of codes, and candidates that share the first codes with a user's items.

A residual quantiser gives an item one code a level: the nearest centre of the level to
what the levels before left of its vector.  Items with a common prefix are alike, so
items that nobody has visited together with others can be found by their prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import io


def _quantised(x: np.ndarray, books: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of each row, ties to the lesser, and what is left of it after the last level."""
    x, codes = x.copy(), np.empty((len(x), len(books)), np.int32)
    for level, centres in enumerate(books):
        far = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
        codes[:, level] = far.argmin(axis=1)
        x -= centres[codes[:, level]]
    return codes, x


def _mapped(vectors: DataFrame, books: Sequence[np.ndarray], column: str, kind: str, rest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                x = part.column("features").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
                out = _quantised(x, books)[rest]
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * out.shape[1])
                yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["item_id", column])

    return vectors.select(F.col("item_id").cast("long").alias("item_id"), "features").mapInArrow(run, f"item_id long, {column} {kind}")


def fit_codebooks(vectors: DataFrame, levels: int = 4, codes: int = 16, seed: int = 42) -> list[np.ndarray]:
    """The centres of each level, by Spark's k-means over what the levels before left of all vectors (item_id, features)."""
    books: list[np.ndarray] = []
    rest = vectors.select("item_id", F.transform("features", lambda v: v.cast("double")).alias("features"))
    for level in range(levels):
        rest = io.staged(_mapped(rest, books[-1:], "features", "array<double>", True), "residuals")
        model = KMeans(k=codes, seed=seed + level, featuresCol="x").fit(rest.select(array_to_vector("features").alias("x")))
        books.append(np.array(model.clusterCenters()))
    return books


def encode(vectors: DataFrame, books: Sequence[np.ndarray]) -> DataFrame:
    """(item_id, sid_0, sid_1, ...) of vectors (item_id, features), given the centres of each level."""
    found = _mapped(vectors, books, "sid", "array<int>", False)
    return found.select("item_id", *[F.col("sid")[k].alias(f"sid_{k}") for k in range(len(books))])


def _prefix(levels: int) -> Column:
    return F.concat_ws(".", *[F.col(f"sid_{k}").cast("string") for k in range(levels)])


def prefix_candidates(history: DataFrame, sids: DataFrame, popularity: DataFrame, allowed: DataFrame, levels: int = 4, least: int = 2, n: int = 400) -> DataFrame:
    """(user_id, item_id, sid_score, sid_rank): the best ``n`` allowed items that share ``least`` codes or more with a user's items.

    An item's score is the weight of the user's items with the same prefix, summed over
    the lengths of prefixes from ``least`` on.  Ties go to the more popular, then the
    smaller item.  All items of a full code have one score, so users are joined to
    codes first, and only as many codes are opened as fill a list, each with its ``n``
    most popular items: nothing of a list is lost.
    """
    known = sids.select("item_id", *[_prefix(k).alias(f"p{k}") for k in range(least, levels + 1)])
    full, lengths = f"p{levels}", range(least, levels + 1)
    own = history.join(known, "item_id").groupBy("user_id", full).agg(F.sum("weight").alias("w"), *[F.first(f"p{k}").alias(f"p{k}") for k in lengths if k != levels])
    prefixes = own.select("user_id", "w", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("p")) for k in lengths])).alias("x"))
    weights = prefixes.groupBy("user_id", "x.k", "x.p").agg(F.sum("w").alias("w"))
    items = known.join(allowed.select("item_id"), "item_id", "left_semi").join(popularity.select("item_id", "item_popularity"), "item_id", "left")
    order = Window.partitionBy(full).orderBy(F.desc_nulls_last("item_popularity"), "item_id")
    items = io.staged(items.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n), "codes")
    codes = items.groupBy(full).agg(F.count("*").alias("size"), *[F.first(f"p{k}").alias(f"p{k}") for k in lengths if k != levels])
    opened = codes.select(F.col(full).alias("code"), "size", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("p")) for k in lengths])).alias("x"))
    scores = weights.join(opened.select("code", "size", "x.k", "x.p"), ["k", "p"]).groupBy("user_id", "code").agg(F.sum("w").cast("double").alias("sid_score"), F.first("size").alias("size"))
    # codes of equal score are opened together, as their items are ranked among each other
    best = Window.partitionBy("user_id").orderBy(F.desc("sid_score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    scores = scores.withColumn("before", F.sum("size").over(best) - F.sum("size").over(Window.partitionBy("user_id", "sid_score"))).filter(F.col("before") < n)
    found = scores.select("user_id", "sid_score", F.col("code").alias(full)).join(items.select(full, "item_id", "item_popularity"), full)
    rank = Window.partitionBy("user_id").orderBy(F.desc("sid_score"), F.desc_nulls_last("item_popularity"), "item_id")
    return found.withColumn("sid_rank", F.row_number().over(rank) - 1).filter(F.col("sid_rank") < n).select("user_id", "item_id", "sid_score", "sid_rank")


def uncovered(found: DataFrame, matrix: DataFrame) -> DataFrame:
    """Candidates whose item is nobody's neighbour in the co-visitation matrix."""
    return found.join(matrix.select(F.col("neighbor_id").alias("item_id")).distinct(), "item_id", "left_anti")
