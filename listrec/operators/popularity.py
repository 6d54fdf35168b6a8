"""Item popularity."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pool import VERTICALS, restrict_to


def item_popularity(interactions: DataFrame) -> DataFrame:
    """Weight and number of users of each item."""
    return interactions.groupBy("item_id").agg(F.sum("weight").cast("long").alias("item_popularity"), F.count("*").alias("item_n_users"))


def top_by_weight(interactions: DataFrame, pool: DataFrame, n: int = 400) -> DataFrame:
    """The ``n`` heaviest items of the pool, ties by item."""
    weights = restrict_to(item_popularity(interactions), pool, "item_id")
    return weights.orderBy(F.desc("item_popularity"), "item_id").limit(n).select("item_id", "item_popularity")


def top_by_users(interactions: DataFrame, items: DataFrame, verticals: tuple[int, ...] = VERTICALS, k: int = 160) -> DataFrame:
    """The ``k`` items of the verticals with most users, ties by item."""
    allowed = items.filter(F.col("vertical_id").isin(*verticals))
    counts = restrict_to(interactions, allowed, "item_id").groupBy("item_id").agg(F.count("*").alias("n_users"))
    return counts.orderBy(F.desc("n_users"), "item_id").limit(k)
