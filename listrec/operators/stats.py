"""Counts, coverage and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.events import IMPRESSION, is_contact, utc_date

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def event_counts(**splits: DataFrame) -> DataFrame:
    """Events of each split and of all ('total')."""
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("split")) for n, d in splits.items()])
    return rows.rollup("split").agg(F.count("*").alias("n_events")).select(F.coalesce("split", F.lit("total")).alias("split"), "n_events")


def covisit_coverage(matrix: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Edges and items with neighbours; their share of the catalogue (its distinct item_id) if that is given."""
    out = matrix.agg(F.count("*").alias("n_edges"), F.count_distinct("item_id").alias("n_items"))
    if catalogue is None:
        return out
    size = catalogue.agg(F.count_distinct("item_id").alias("_size")).withColumn("_k", F.lit(0))  # one row
    return out.withColumn("_k", F.lit(0)).join(F.broadcast(size), "_k").select("n_edges", "n_items", (F.col("n_items") / F.col("_size")).alias("share"))


def matrix_stats(interactions: DataFrame) -> DataFrame:
    """Users, items, filled cells and their share in percent."""
    out = interactions.agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("item_id").alias("n_items"), F.count("*").alias("nnz"))
    return out.withColumn("density_pct", 100.0 * F.col("nnz") / (F.col("n_users") * F.col("n_items")))


def source_overlap(merged: DataFrame) -> DataFrame:
    """Rows of ALS only, co-visitation only and both; all rows and users."""
    a, c = F.col("in_als"), F.col("in_covisit")
    return merged.agg(F.count_if(a & ~c).alias("als_only"), F.count_if(c & ~a).alias("covisit_only"), F.count_if(a & c).alias("both"), F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_users"))


def positive_rate(features: DataFrame) -> DataFrame:
    t = F.col("target").cast("int")
    return features.agg(F.sum(t).alias("n_positive"), F.avg(t).alias("rate"))


def event_type_funnel(events: DataFrame, contact_eids: DataFrame) -> DataFrame:
    """Count and percent of each event type, most frequent first."""
    counts = events.groupBy("eid").agg(F.count("*").alias("n_events"))
    total = counts.agg(F.sum("n_events").alias("total")).withColumn("_k", F.lit(0))
    marked = is_contact(counts, contact_eids).withColumn("_k", F.lit(0)).join(F.broadcast(total), "_k")  # one row
    return marked.select("eid", "n_events", F.round(100.0 * F.col("n_events") / F.col("total"), 2).alias("pct"), "is_contact").orderBy(F.desc("n_events"), "eid")


def daily_activity(events: DataFrame, contact_eids: DataFrame) -> DataFrame:
    """Events and contacts of each UTC day."""
    marked = is_contact(events, contact_eids)
    return marked.groupBy(utc_date(F.col("timestamp")).alias("day")).agg(F.count("*").alias("n_events"), F.count_if("is_contact").alias("n_contacts"))


def cold_user_share(events: DataFrame) -> DataFrame:
    """Users that only have impressions."""
    per = events.groupBy("user_id").agg(F.count_if(F.col("eid") != IMPRESSION).alias("n"))
    return per.agg(F.count("*").alias("n_users"), F.count_if(F.col("n") == 0).alias("n_cold")).withColumn("cold_pct", 100.0 * F.col("n_cold") / F.col("n_users"))


def _lengths(events: DataFrame) -> DataFrame:
    """How many users have a history of each length (a short table)."""
    return events.groupBy("user_id").agg(F.count("*").alias("length")).groupBy("length").agg(F.count("*").alias("n"))


def history_quantiles(events: DataFrame, qs: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Exact quantiles of history lengths: the element at round((n - 1) q) of the sorted ones.

    The running sum goes over the distinct lengths only.
    """
    rows = _lengths(events).withColumn("upto", F.sum("n").over(Window.orderBy("length"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    wanted = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.floor((F.col("total") - 1) * F.lit(q) + 0.5).alias("at")) for q in qs])).alias("w")
    return rows.select("length", "upto", wanted).filter(F.col("upto") > F.col("w.at")).groupBy(F.col("w.q").alias("q")).agg(F.min("length").alias("length"))


def history_histogram(events: DataFrame, bins: int = 50, upper_q: float = 0.95) -> DataFrame:
    """Equal bins of the history lengths up to a quantile; the maximum falls in the last one."""
    top = history_quantiles(events, (upper_q,)).select(F.col("length").alias("hi"), F.lit(0).alias("_k"))
    rows = _lengths(events).withColumn("_k", F.lit(0)).join(F.broadcast(top), "_k").filter("length <= hi")  # one row
    ends = rows.agg(F.min("length").alias("lo"), F.max("length").alias("top")).withColumn("_k", F.lit(0))
    width = (F.col("top") - F.col("lo")) / F.lit(float(bins))
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("length") - F.col("lo")) / width), F.lit(bins - 1)))
    return rows.join(F.broadcast(ends), "_k").groupBy(at.cast("int").alias("bin")).agg(F.sum("n").alias("n_users"))
