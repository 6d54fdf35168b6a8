"""The given tables in the shapes of the model (kept out of the library's core).

Mapping A makes a click log of ``events`` and item attributes of ``part``; mapping
B a larger log of ``orders`` and ``lineitem``; mapping C takes ``embeddings`` as factors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000
CUTOFF_MS = 1_706_659_200_000  # 2024-01-31
THRESHOLD_MS = CUTOFF_MS - 7 * DAY_MS
CUTOFF_B_MS = 1_009_843_200_000  # 2002-01-01
EIDS = {"view": 7, "click": 1, "signup": 10, "error": 11, "purchase": 20}
CONTACTS = (20,)
VERTICALS = {"ECONOMY": 0, "LARGE": 1, "MEDIUM": 2, "PROMO": 3, "SMALL": 4, "STANDARD": 6}


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a time without zone, whatever the session's zone."""
    day = F.unix_date(ts.cast("date")).cast("long") * DAY_MS
    millis = F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")
    return day + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + millis


def _choose(col: Column, values: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, value in values.items():
        out = F.when(col == name, value).otherwise(out)
    return out


def click_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    item = F.get_json_object("props", "$.k").cast("long")
    return e.select("user_id", item.alias("item_id"), epoch_ms(F.col("ts")).alias("timestamp"), _choose(F.col("event_type"), EIDS).alias("eid"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_returnflag")
    eid = _choose(F.col("l_returnflag"), {"N": 7, "A": 1, "R": 20})
    both = i.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), epoch_ms(F.col("o_orderdate")).alias("timestamp"), eid.alias("eid"))


def contacts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e,) for e in CONTACTS], "mapped_eid int")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(
        F.col("p_partkey").alias("item_id"), _choose(F.col("p_type"), VERTICALS).alias("vertical_id"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("category_ext_y"),
        F.col("p_size").cast("int").alias("region_id_y"), (F.col("p_partkey") % 10).cast("int").alias("loc_id_y"),
    )


def factors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """User factors (the query set: ids divisible by 50) and item factors (all)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return e.filter("id % 50 = 0"), e
