"""Splitting by user, the ranker on the feature table, and balancing of its lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import boosting

CATEGORIES = ("vertical_id", "category_ext_y", "region_id_y", "loc_id_y")
NUMBERS = ("als_score", "als_rank", "covisit_score", "covisit_rank", "in_als", "in_covisit", "item_popularity", "item_n_users", "user_top_vertical_match", "user_n_items", "user_weight", "vertical_share", "category_share", "region_share")
BUCKETS = 64


def _in_validation(fraction: float, seed: int) -> Column:
    limit = f"{int(fraction * 2**32):08x}"
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("user_id").cast("string")).cast("binary")), 1, 8) < limit


def split_by_user(df: DataFrame, fraction: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, validation): a user is whole on one side, by a hash of the id; no shuffle."""
    inside = _in_validation(fraction, seed)
    return df.filter(~inside), df.filter(inside)


def fit(train: DataFrame, validation: DataFrame | None = None, rounds: int = 500, depth: int = 6, rate: float = 0.05, k: int = 160, **more) -> boosting.Ranker:
    """The listwise ranker on the feature table's columns; ``validation`` chooses the number of trees.

    Categories enter by their target statistics, with all their values.
    """
    numbers = [c for c in NUMBERS if c in train.columns]
    return boosting.fit(train, validation, numbers, CATEGORIES, rounds=rounds, depth=depth, rate=rate, k=k, **more)


def score(model: boosting.Ranker, df: DataFrame) -> DataFrame:
    """(user_id, item_id[, target], rank_score)."""
    return boosting.score(model, df)


def importances(model: boosting.Ranker, spark: SparkSession) -> DataFrame:
    """(feature, importance) in percent of the change of the prediction, greatest first."""
    return boosting.importances(boosting.trees_table(model, spark)).withColumn("feature", F.regexp_replace("feature", "^ts_", ""))


def _prepared(df: DataFrame, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """The pair, numbers without gaps, categories as text, and the label if there is a target."""
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"n_{c}") for c in numbers if c in df.columns]
    cols += [F.col(c).cast("string").alias(f"s_{c}") for c in categories]
    label = ["target", F.col("target").cast("double").alias("label")] if "target" in df.columns else []
    return df.select("user_id", "item_id", *cols, *label)


def _frequent(data: DataFrame, categories: Sequence[str]) -> list[list[str]]:
    """The ``BUCKETS`` - 1 most frequent values of each category; all others and gaps share one."""
    out = []
    for c in categories:
        counts = data.filter(F.col(f"s_{c}").isNotNull()).groupBy(F.col(f"s_{c}").alias("v")).agg(F.count("*").alias("n"))
        out.append([r["v"] for r in counts.orderBy(F.desc("n"), "v").limit(BUCKETS - 1).collect()])
    return out


@dataclass
class Pointwise:
    """Spark's pipeline and the columns that it takes."""

    pipeline: PipelineModel
    numbers: Sequence[str]
    categories: Sequence[str]


def fit_pointwise(train: DataFrame, rounds: int = 20, depth: int = 5, seed: int = 42, numbers: Sequence[str] = NUMBERS, categories: Sequence[str] = CATEGORIES) -> Pointwise:
    """Spark's boosted trees for the probability of a contact, to compare with; positives weigh as much as negatives.

    It orders a user's candidates but does not look at lists, and knows the
    ``BUCKETS`` - 1 most frequent values of a category.
    """
    numbers = [c for c in numbers if c in train.columns]
    data = _prepared(train, numbers, categories)
    counts = data.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    up = max(1.0, (counts["n"] - (counts["p"] or 0)) / max(counts["p"] or 0, 1.0))
    data = data.withColumn("w", F.when(F.col("label") == 1, up).otherwise(1.0))
    indexed, stages = [f"c_{c}" for c in categories], []
    if categories:
        values = [v or ["none"] for v in _frequent(data, categories)]
        stages.append(StringIndexerModel.from_arrays_of_labels(values, inputCols=[f"s_{c}" for c in categories], outputCols=indexed, handleInvalid="keep"))
    gbt = GBTClassifier(featuresCol="x", labelCol="label", weightCol="w", maxIter=rounds, maxDepth=depth, maxBins=BUCKETS, seed=seed)
    stages += [VectorAssembler(inputCols=[f"n_{c}" for c in numbers] + indexed, outputCol="x"), gbt]
    return Pointwise(Pipeline(stages=stages).fit(data), numbers, categories)


def score_pointwise(model: Pointwise, df: DataFrame) -> DataFrame:
    """(user_id, item_id[, target], rank_score)."""
    out = model.pipeline.transform(_prepared(df, model.numbers, model.categories)).withColumn("rank_score", vector_to_array("probability")[1])
    target = [F.col("target").cast("int").alias("target")] if "target" in df.columns else []
    return out.select("user_id", "item_id", *target, "rank_score")


def balance_by_vertical(scored: DataFrame, items: DataFrame, k: int = 160, quota: int = 40, depth: int = 500, score_col: str = "rank_score") -> DataFrame:
    """The best ``k`` a user with at most ``quota`` of a vertical, over-quota rows filling up to ``k``.

    Looks at the ``depth`` best rows of a user.
    """
    best = Window.partitionBy("user_id").orderBy(F.desc_nulls_last(score_col), "item_id")
    rows = scored.select("user_id", "item_id", score_col).withColumn("_d", F.row_number().over(best)).filter(F.col("_d") <= depth)
    rows = rows.join(items.select("item_id", "vertical_id"), "item_id", "left")
    within = Window.partitionBy("user_id", "vertical_id").orderBy("_d")
    rows = rows.withColumn("over", (F.row_number().over(within) > quota).cast("int"))
    final = Window.partitionBy("user_id").orderBy("over", "_d")
    rows = rows.withColumn("pos", F.row_number().over(final) - 1).filter(F.col("pos") < k)
    return rows.select("user_id", "item_id", "vertical_id", score_col, "pos")
