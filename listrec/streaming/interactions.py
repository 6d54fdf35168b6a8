"""Interactions kept up to date from a stream of events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.events import IMPRESSION, with_weight


def daily_interactions(events: DataFrame, contact_eids: DataFrame, late: str = "1 day") -> DataFrame:
    """Weight and latest time of each (day, user, item) of a streaming log.

    A day closes once the watermark has passed it; its rows then add up to the
    batch aggregate of the same days.
    """
    rows = with_weight(events.filter(F.col("eid") != IMPRESSION), contact_eids).withColumn("at", F.timestamp_millis("timestamp"))
    grouped = rows.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("day"), "user_id", "item_id")
    return grouped.agg(F.sum("weight").cast("int").alias("weight"), F.max("timestamp").alias("last_timestamp")).select(F.col("day.start").alias("day"), "user_id", "item_id", "weight", "last_timestamp")
