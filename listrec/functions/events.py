"""Filters and expressions on the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000
CUTOFF_MS = 1_776_211_200_000  # 2026-04-15
IMPRESSION = 7


def in_window(events: DataFrame, cutoff_ms: int = CUTOFF_MS, days: int = 28, drop_eids: tuple[int, ...] = (IMPRESSION,)) -> DataFrame:
    """Events of ``[cutoff - days, cutoff)`` without the dropped types; reaches the scan."""
    t = F.col("timestamp")
    kept = events.filter((t >= cutoff_ms - days * DAY_MS) & (t < cutoff_ms))
    return kept.filter(~F.col("eid").isin(*drop_eids)) if drop_eids else kept


def is_contact(events: DataFrame, contact_eids: DataFrame) -> DataFrame:
    """Add boolean ``is_contact``; the list of types is broadcast (a dozen rows, one per event type)."""
    marks = contact_eids.select(F.col("mapped_eid").alias("eid")).distinct().withColumn("_c", F.lit(True))
    return events.join(F.broadcast(marks), "eid", "left").withColumn("is_contact", F.coalesce("_c", F.lit(False))).drop("_c")


def with_weight(events: DataFrame, contact_eids: DataFrame, contact: int = 5, other: int = 1) -> DataFrame:
    """Add ``weight``: ``contact`` for contact types, else ``other``."""
    marked = is_contact(events, contact_eids)
    return marked.withColumn("weight", F.when(F.col("is_contact"), contact).otherwise(other)).drop("is_contact")


def utc_date(timestamp: Column) -> Column:
    """UTC date of epoch milliseconds, whatever the session's zone."""
    return F.date_from_unix_date(F.floor(timestamp / F.lit(DAY_MS)).cast("int"))
