"""Dense indices of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import io

ROW_BITS = 33  # of monotonically_increasing_id


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """The rows and ``idx``, 0, 1, ... in a total ``order``.

    Rows are dealt by ranges and sorted in place; the driver gets one count a
    partition and hands back the offsets.  No window over all rows.  The places are
    written before they are counted: dealt again, ranges could lie elsewhere.
    """
    placed = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = io.staged(placed.withColumn("_m", F.monotonically_increasing_id()), "places")
    part, row = F.shiftright("_m", ROW_BITS), F.col("_m").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    counts = sorted(placed.groupBy(part.cast("int").alias("p")).count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets += [F.lit(p), F.lit(total)]
        total += n
    if not counts:
        return placed.select(*df.columns, F.lit(0).cast("int").alias("idx"))
    return placed.select(*df.columns, (F.element_at(F.create_map(*offsets), part.cast("int")) + row).cast("int").alias("idx"))


def dense_index(df: DataFrame, col: str) -> DataFrame:
    """``col`` and ``idx``, 0, 1, ... by ascending id."""
    return numbered(df.select(col).filter(F.col(col).isNotNull()).distinct(), col)


def encode(interactions: DataFrame, user_index: DataFrame, item_index: DataFrame) -> DataFrame:
    """(user_idx, item_idx, weight) of interactions whose ids are known."""
    users = user_index.withColumnRenamed("idx", "user_idx")
    items = item_index.withColumnRenamed("idx", "item_idx")
    return interactions.join(users, "user_id").join(items, "item_id").select("user_idx", "item_idx", "weight")


def lookup(df: DataFrame, index: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a known id plus ``idx``; one row with the number of rows dropped."""
    dropped = df.join(index.select(col), col, "left_anti").agg(F.count("*").alias("n_dropped"))
    return df.join(index, col), dropped
