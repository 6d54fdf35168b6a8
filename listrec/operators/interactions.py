"""User-item interactions."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.events import IMPRESSION


def aggregate(weighted_events: DataFrame) -> DataFrame:
    """Sum of weights and latest time of each (user, item); partial sums go into the shuffle."""
    return weighted_events.groupBy("user_id", "item_id").agg(F.sum("weight").cast("int").alias("weight"), F.max("timestamp").alias("last_timestamp"))


def keep_recent(pairs: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` latest items of each user, ties by item; rows are limited before the shuffle."""
    latest = Window.partitionBy("user_id").orderBy(F.desc("last_timestamp"), "item_id")
    return pairs.withColumn("_r", F.row_number().over(latest)).filter(F.col("_r") <= n).drop("_r")


def touched(events: DataFrame, cutoff_ms: int, drop_eids: tuple[int, ...] = (IMPRESSION,)) -> DataFrame:
    """Distinct (user_id, item_id) of the whole log before the cutoff, however long ago; impressions alone do not count."""
    rows = events.filter((F.col("timestamp") < cutoff_ms) & ~F.col("eid").isin(*drop_eids))
    return rows.select("user_id", "item_id").distinct()
