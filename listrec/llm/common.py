"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
#: Folders chosen for applications without spark.checkpoint.dir.
LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``.  Only in local mode (tests) may
    that be unset: then a temporary folder is chosen and remembered.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    app = spark.sparkContext.applicationId
    if app not in LOCAL:
        LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
    return LOCAL[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A lost executor then costs a reread, never a recomputation of the plan above.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str]) -> DataFrame:
    """Read one table with only the columns that are needed."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """One row per id with a 0/1 ``label``; rows without id or label are left out.

    An id listed more than once takes its highest label.
    """
    rows = labels.select("doc_id", F.col(column).cast("int").alias("label"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def span_key(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then kind as listed, comma-joined.

    Each span is ``(start, index of its kind, end)``.
    """
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def map_texts(documents: DataFrame, work: Callable[[list[str | None]], dict[str, list]], schema: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Apply ``work`` to the whole texts of each Arrow batch.

    ``work`` gets a list of texts and returns the columns named in ``schema``, one
    value a row.  The columns in ``keep`` pass through as they are (ids with nulls
    keep all their digits); the task holds one batch at a time.
    """
    out = T._parse_datatype_string(schema)
    types = [(f.name, ARROW[f.dataType.simpleString()]) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = work(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(cols[n], t) for n, t in types)], [*keep, *(n for n, _ in types)])

    source = documents.select(*dict.fromkeys((*keep, "text")))
    return source.mapInArrow(run, T.StructType([*(source.schema[k] for k in keep), *out.fields]))
