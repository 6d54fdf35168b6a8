"""The pool of items that may be recommended."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERTICALS = (0, 2, 3, 4, 5, 7)


def restrict_to(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(keys.select(on), on, "left_semi")


def allowed_items(items: DataFrame, interactions: DataFrame, verticals: tuple[int, ...] = VERTICALS, min_users: int = 2) -> DataFrame:
    """Items of the verticals that at least ``min_users`` distinct users touched."""
    users = interactions.groupBy("item_id").agg(F.count_distinct("user_id").alias("n")).filter(F.col("n") >= min_users)
    return items.filter(F.col("vertical_id").isin(*verticals)).select("item_id").join(users.select("item_id"), "item_id")
