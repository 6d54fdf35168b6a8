"""Filtering pipeline over ``documents``: five stages, each one operator.

Every stage takes all its predecessor kept; each but the last returns the columns
of ``documents``.  Stages are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listrec.llm import decontam, pieces, secret_scan, simhash, toxicity
from listrec.llm.common import cut, labelled, table


def _columns(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs``, packed in ``row``, in their order; some with a new value."""
    return [changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents scored 0.5 or more by a classifier fitted on the labelled ones.

    Null and empty texts get the score of the bias alone.  Other columns are packed
    while the texts are scored, so none can clash with the score.  Repeated rows stay
    or go together; without labels, or with an empty table, nothing goes.
    """
    labels = labelled(table(spark, sf_dir, "labels", ["doc_id", "toxic"]), "toxic")
    model = toxicity.fit(docs, labels)
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row"), "text")
    return toxicity.score(packed, model, keep=("row",), text=True).filter("predicted = 0").select(_columns(docs, text=F.col("text")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the least id, of each group of near copies.

    Texts without words are copies of each other; rows without an id stay; rows that
    repeat an id stay or go together.
    """
    return simhash.without_near_duplicates(docs).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a window of a benchmark item; null and empty texts have none and stay."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"])).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; n_chars follows the text where it changed.

    All rows stay, null texts stay null.
    """
    clean = docs.select(F.struct(*docs.columns).alias("row"), secret_scan.redacted(F.col("text")).alias("clean"))
    size, before = F.length("clean"), F.length(F.col("row")["text"])
    return clean.select(_columns(docs, text=F.col("clean"), n_chars=F.when(size != before, size.cast("long")).otherwise(F.col("row")["n_chars"])))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with sampled segmentations; every row stays, a null text has no ids."""
    return pieces.encode_documents(docs, keep=("doc_id", "lang", "source", "n_chars"), together=500_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded documents that pass all stages; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
