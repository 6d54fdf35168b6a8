"""Feature tables of the ranker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ATTRIBUTES = ("vertical_id", "category_ext_y", "region_id_y", "loc_id_y")


def user_top_vertical(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """The heaviest vertical of each user, ties by vertical (``interactions``: all histories in one)."""
    sums = interactions.join(items.select("item_id", "vertical_id"), "item_id").groupBy("user_id", "vertical_id").agg(F.sum("weight").alias("w"))
    order = Window.partitionBy("user_id").orderBy(F.desc("w"), "vertical_id")
    return sums.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == 1).select("user_id", F.col("vertical_id").alias("top_vertical"))


#: What a user's profile says of a candidate: the share of the user's weight in its vertical, category and region.
SHARES = {"vertical_share": "vertical_id", "category_share": "category_ext_y", "region_share": "region_id_y"}


def user_profile(history: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, user_n_items, user_weight, shares): a user's items, their weight, and its share by attribute and value.

    ``shares`` maps "attribute=value" to a share of the weight; histories are capped
    upstream, so the map is short.  Items without a value count in the weight only.
    """
    totals = history.groupBy("user_id").agg(F.count("*").alias("user_n_items"), F.sum("weight").alias("user_weight"))
    each = [F.struct(F.concat(F.lit(f"{a}="), F.col(a).cast("string")).alias("k")) for a in SHARES.values()]
    rows = history.join(items.select("item_id", *SHARES.values()), "item_id").select("user_id", "weight", F.explode(F.array(*each)).alias("x")).filter("x.k is not null")
    sums = rows.groupBy("user_id", "x.k").agg(F.sum("weight").alias("w")).join(totals, "user_id")
    maps = sums.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("k", (F.col("w") / F.col("user_weight")).alias("share")))).alias("shares"))
    return totals.join(maps, "user_id", "left")


def with_profile(candidates: DataFrame, profile: DataFrame, items: DataFrame) -> DataFrame:
    """Adds user_n_items, user_weight (0 for users without history) and the shares (0 where the user has nothing alike)."""
    rows = candidates.join(items.select("item_id", *[F.col(a).alias(f"_{a}") for a in SHARES.values()]), "item_id", "left").join(profile, "user_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    shares = {name: F.coalesce(F.try_element_at("shares", F.concat(F.lit(f"{a}="), F.col(f"_{a}").cast("string"))), F.lit(0.0)) for name, a in SHARES.items()}
    rows = rows.withColumns({"user_n_items": zero("user_n_items"), "user_weight": zero("user_weight"), **shares})
    return rows.select(*candidates.columns, "user_n_items", "user_weight", *SHARES)


def with_target(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Add boolean ``target``: the pair is a positive."""
    marks = targets.select("user_id", "item_id").distinct().withColumn("_t", F.lit(True))
    return df.join(marks, ["user_id", "item_id"], "left").withColumn("target", F.coalesce("_t", F.lit(False))).drop("_t")


def _with_items(candidates: DataFrame, items: DataFrame, popularity: DataFrame, user_vertical: DataFrame) -> DataFrame:
    """Join both item tables to each other first, then once to the candidates."""
    both = items.select("item_id", *ATTRIBUTES).join(popularity, "item_id", "full")
    rows = candidates.join(both, "item_id", "left").join(user_vertical, "user_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return rows.withColumns({"item_popularity": zero("item_popularity"), "item_n_users": zero("item_n_users"), "user_top_vertical_match": (F.col("vertical_id") == F.col("top_vertical")).cast("int")})


def build_single(candidates: DataFrame, items: DataFrame, popularity: DataFrame, user_vertical: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Features of one source's candidates; ``is_cold`` comes from ``source``."""
    rows = _with_items(candidates, items, popularity, user_vertical)
    rows = rows.withColumn("is_cold", (F.col("source") == "popular_fallback").cast("int"))
    columns = ["user_id", "item_id", "als_score", "als_rank", "is_cold", *ATTRIBUTES, "item_popularity", "item_n_users", "user_top_vertical_match"]
    return with_target(rows, targets).select(*columns, "target") if targets is not None else rows.select(*columns)


def build_merged(candidates: DataFrame, items: DataFrame, popularity: DataFrame, user_vertical: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Features of merged candidates, flags as integers."""
    rows = _with_items(candidates, items, popularity, user_vertical)
    rows = rows.withColumns({c: F.col(c).cast("int") for c in ("in_als", "in_covisit")})
    columns = ["user_id", "item_id", "als_score", "als_rank", "covisit_score", "covisit_rank", "in_als", "in_covisit", *ATTRIBUTES, "item_popularity", "item_n_users", "user_top_vertical_match"]
    return with_target(rows, targets).select(*columns, "target") if targets is not None else rows.select(*columns)
