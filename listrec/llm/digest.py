"""Document fingerprints: a canonical exact digest.

A text is canonical after Unicode compatibility normalisation, case folding and
folding of white space.  Its fingerprint is the 128-bit xxhash of those bytes.
Documents that share a digest form a bucket, within which the canonical bytes
themselves are compared; should two contents ever meet in a bucket, each gets a
number of its own behind the digest.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts

MARGIN = "own int, k int, doc_id long, z binary"


def canonical(text: str | None) -> bytes:
    """Canonical bytes; null counts as empty."""
    if not text:
        return b""
    if text.isascii():
        folded = text.lower()
    else:
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "replace")


def digest(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def fingerprints(documents: DataFrame) -> DataFrame:
    """Per row: doc_id and ``digest`` of the whole text."""
    return map_texts(documents, lambda texts: {"digest": [digest(t) for t in texts]}, "digest string")


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def in_order(documents: DataFrame, flagged: DataFrame, work, schema: str) -> DataFrame:
    """Run ``work(text, next text, flag)`` on each row and the next in descending doc_id.

    One range shuffle of compressed texts: partitions are ranges of ids, and the
    first row of the range below goes along at the end of each (the very first row
    at the end of the last).  ``flagged`` holds ids; their rows get a true flag.
    Rows that share an id follow each other in descending order of their compressed
    texts; null ids come last.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = documents.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"))
    cuts = np.unique(np.array(ids.approxQuantile("o", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else [], dtype=float).astype(np.int64)) if parts > 1 else np.empty(0, np.int64)

    @F.pandas_udf("int")
    def part_of(o):
        import pandas as pd

        return pd.Series(np.searchsorted(cuts, o.to_numpy(), side="right").astype(np.int32))

    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    tops = {r["k"]: r["top"] for r in ids.select("o", part_of("o").alias("k")).groupBy("k").agg(F.max("o").alias("top")).collect()}
    held = sorted(tops)
    # the top of each range is also wanted by the range above, the highest by the lowest
    above = {tops[k]: held[(i + 1) % len(held)] for i, k in enumerate(held)}
    wanted = np.array(sorted(above), np.int64)
    goes_to = np.array([above[o] for o in sorted(above)], np.int32)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            o = np.array([i if i is not None else -(1 << 63) for i in b.column("doc_id").to_pylist()], np.int64)
            k = np.searchsorted(cuts, o, side="right").astype(np.int32)
            z = pa.array([pack(t.as_py().encode("utf-8", "replace")) if t.is_valid else None for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(o), np.int32)), pa.array(k), b.column("doc_id"), z], ["own", "k", "doc_id", "z"])
            at = np.minimum(np.searchsorted(wanted, o), max(len(wanted) - 1, 0))
            also = np.nonzero(wanted[at] == o)[0] if len(wanted) else np.empty(0, np.int64)
            if len(also):
                take = pa.array(also)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(also), np.int32)), pa.array(goes_to[at[also]]), b.column("doc_id").take(take), z.take(take)], ["own", "k", "doc_id", "z"])

    texts = documents.select("doc_id", "text").mapInArrow(spread, MARGIN)
    marks = flagged.select(F.lit(2).alias("own"), part_of(order).alias("k"), "doc_id", F.lit(None).cast("binary").alias("z"))
    rows = texts.unionByName(marks).repartitionById(parts, F.col("k"))
    rows = rows.sortWithinPartitions("k", F.least("own", F.lit(1)).desc(), F.desc_nulls_last("doc_id"), F.desc("own"), F.desc_nulls_last("z"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names, out, size = [f.split()[0] for f in schema.split(",")], [], 0
        types = {"doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64(), "body": pa.binary()}
        waiting, part, flag = None, None, set()

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(list(c), types.get(n, pa.string())) for n, c in zip(names, zip(*out, strict=True), strict=True)], names)

        for b in batches:
            for own, k, doc, z in zip(*(b.column(c) for c in ("own", "k", "doc_id", "z")), strict=True):
                own, k, doc = own.as_py(), k.as_py(), doc.as_py()
                if k != part:
                    waiting, part, flag = None, k, set()
                if own == 2:
                    flag = {doc}
                    continue
                text = unpack(z.as_py()).decode("utf-8") if z.is_valid else ""
                if waiting is not None:
                    out.append((waiting[0], *work(waiting[1], text, waiting[2])))
                    size += len(waiting[1])
                    waiting = None
                if own:
                    waiting = doc, text, doc in flag
                if size > 8_000_000:
                    yield emit()
                    out, size = [], 0
        if out:
            yield emit()

    return rows.mapInArrow(run, schema)


def compare_with_edits(documents: DataFrame) -> DataFrame:
    """Per row: n_chars, digest of the text and of its edited form, and two likenesses.

    A likeness of exact digests is 1.0 when the canonical bytes are equal, else 0.0.
    Null texts count as empty.  A single document is its own next one.  Rows that
    repeat an id follow each other in descending order of their compressed texts; an
    empty table gives an empty result.  A number behind a digest that two contents
    share goes to the texts' fingerprints, not to those of edited forms.
    """
    prints = cut(fingerprints(documents), "digests")
    # written before the join, so that the skew join can split a hot digest
    twice = cut(prints.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "twice")
    flagged = prints.join(twice, "digest").select("doc_id").distinct()

    def work(text: str, following: str, shared: bool) -> tuple:
        pack = zstandard.ZstdCompressor(level=3).compress
        new = edited(text, following)
        own, other, after = canonical(text), canonical(new), canonical(following)
        name = xxhash.xxh3_128_hexdigest
        return len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), name(own), name(other), float(own == other), float(own == after), pack(own) if shared else None

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, body binary"
    found = cut(in_order(documents, flagged, work, schema), "fingerprints")
    # Within a bucket the canonical bytes are compared (their compressed form is a function of them).
    mixed = found.filter("body is not null").groupBy("fingerprint").agg(F.min("body").alias("low"), F.max("body").alias("high")).filter("low <> high").select("fingerprint")
    if mixed.isEmpty():
        return found.drop("body")
    several = found.filter("body is not null").join(mixed, "fingerprint", "left_semi").groupBy("fingerprint", "body").count().groupBy("fingerprint").agg(F.array_sort(F.collect_list("body")).alias("bodies"))
    named = found.join(several, "fingerprint", "left")
    number = F.array_position("bodies", F.col("body"))
    return named.withColumn("fingerprint", F.when(F.col("bodies").isNull(), F.col("fingerprint")).otherwise(F.concat_ws("-", "fingerprint", number.cast("string")))).select(*[c for c in found.columns if c != "body"])
