"""Reading the model tables with fixed schemas, and writing stages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

#: Temporary folders of local applications without spark.checkpoint.dir.
LOCAL: dict[str, str] = {}


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The click log, from one file or a folder of parts; later filters reach the scan."""
    return spark.read.schema(schemas.EVENTS).parquet(path)


def read_ids(spark: SparkSession, path: str, col: str) -> DataFrame:
    """A CSV list of ids with a header."""
    kind = "int" if col == "mapped_eid" else "long"
    return spark.read.schema(f"{col} {kind}").option("header", True).csv(path)


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Positive (user, item) pairs from CSV with a header."""
    return spark.read.schema(schemas.TARGETS).option("header", True).csv(path)


def read_items(spark: SparkSession, path: str, columns: tuple[str, ...] = tuple(schemas.ITEMS.names)) -> DataFrame:
    """Item attributes, only the columns asked for."""
    return spark.read.schema(schemas.ITEMS).parquet(path).select(*columns)


#: Whether Spark deletes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_stage(df: DataFrame, path: str) -> None:
    """Write ``df``; the shuffle files of the write go when it is done."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    In local mode a temporary folder, one an application, will do where the setting is missing.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        if app not in LOCAL:
            LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
        base = LOCAL[app]
    return f"{base}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stage that is not read any more, on whatever file system it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: The stages written within ``passing``.
PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Of the stages written in here only the last is kept: at the end nothing may read the others any more."""
    before, paths = PASSING.get(), []
    PASSING.set(paths)
    try:
        yield
    finally:
        PASSING.set(before)
        for path in paths[:-1]:
            remove(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there."""
    path = shared_path(df.sparkSession, name)
    write_stage(df, path)
    if (paths := PASSING.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int | None = None, by: str = "user_id", within: tuple[str, ...] = ("timestamp", "item_id")) -> DataFrame:
    """``df`` written once as a table in buckets of ``by``, each sorted; what reads it needs no exchange on ``by``.

    The table lies in the shared folder; ``buckets`` default to the session's shuffle partitions.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(count, by).write.bucketBy(count, by).sortBy(by, *within).option("path", path).saveAsTable(table)
    return spark.table(table)


def write_submission(ranked: DataFrame, path: str, k: int = 160, score_col: str = "rank_score") -> None:
    """At most ``k`` distinct items a user as a two-column CSV with a header."""
    one = ranked.groupBy("user_id", "item_id").agg(F.max(score_col).alias(score_col))
    order = Window.partitionBy("user_id").orderBy(F.desc_nulls_last(score_col), "item_id")
    top = one.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    top.select("user_id", "item_id").write.mode("overwrite").option("header", True).csv(path)
