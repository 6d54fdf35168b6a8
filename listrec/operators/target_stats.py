"""Target statistics of categories: for each row the share of positives among the rows before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the order that name a block; a value's rows fall in 16**DIGITS blocks.
DIGITS = 3
MISSING = "none"


def place(seed: int = 42) -> Column:
    """The order of the rows: a hash of user and item as hexadecimal text, the same in every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("user_id").cast("string"), F.col("item_id").cast("string")).cast("binary"))


def _values(df: DataFrame, columns: Sequence[str], *more: Column) -> DataFrame:
    """One row for each row and category: ``name`` and ``v``, the value as text."""
    each = [F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("v")) for c in columns]
    return df.select("user_id", "item_id", *more, F.explode(F.array(*each)).alias("x")).select("*", "x.name", "x.v").drop("x")


def ordered(df: DataFrame, columns: Sequence[str], prior: float, weight: float = 1.0, seed: int = 42) -> DataFrame:
    """(user_id, item_id, ts_...) for distinct pairs with a boolean ``target``.

    ``ts_c`` is (positives + ``weight`` x ``prior``) / (rows + ``weight``) over the rows
    of the same value of ``c`` that come before in the order of ``place``, so a row never
    sees its own target.  Rows are summed by value and block of the order, the sums of
    the earlier blocks are added up (at most 4,096 a value), and only within a block a
    window goes over rows: a frequent value is spread over all blocks.
    """
    order = F.col("at")
    rows = _values(df, columns, F.col("target").cast("int").alias("t"), place(seed).alias("at")).withColumn("block", F.substring(order, 1, DIGITS))
    keys = ["name", "v", "block"]
    sums = rows.groupBy(*keys).agg(F.sum("t").alias("t_block"), F.count("*").alias("n_block"))
    earlier = Window.partitionBy("name", "v").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("t_block").over(earlier), F.lit(0)).alias("t0"), F.coalesce(F.sum("n_block").over(earlier), F.lit(0)).alias("n0"))
    before = Window.partitionBy(*keys).orderBy("at", "user_id", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"t1": F.coalesce(F.sum("t").over(before), F.lit(0)), "n1": F.count("*").over(before)}).join(sums, keys)
    value = (F.col("t0") + F.col("t1") + weight * prior) / (F.col("n0") + F.col("n1") + weight)
    rows = rows.select("user_id", "item_id", "name", value.alias("value"))
    return rows.groupBy("user_id", "item_id").agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(f"ts_{c}") for c in columns])


def whole(df: DataFrame, columns: Sequence[str], prior: float, weight: float = 1.0) -> DataFrame:
    """(name, v, value) over all rows, for rows that took no part in the training."""
    sums = _values(df, columns, F.col("target").cast("int").alias("t")).groupBy("name", "v").agg(F.sum("t").alias("t"), F.count("*").alias("n"))
    return sums.select("name", "v", ((F.col("t") + weight * prior) / (F.col("n") + weight)).alias("value"))


def with_whole(df: DataFrame, stats: DataFrame, columns: Sequence[str], prior: float) -> DataFrame:
    """Adds ``ts_c`` of each category from ``whole``; values not seen there get ``prior``."""
    for c in columns:
        own = stats.filter(F.col("name") == c).select(F.col("v").alias(f"_v_{c}"), F.col("value").alias(f"ts_{c}"))
        df = df.withColumn(f"_v_{c}", F.coalesce(F.col(c).cast("string"), F.lit(MISSING))).join(own, f"_v_{c}", "left").drop(f"_v_{c}")
        df = df.withColumn(f"ts_{c}", F.coalesce(f"ts_{c}", F.lit(prior)))
    return df
