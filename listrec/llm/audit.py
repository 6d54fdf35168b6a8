"""Audit of five document filters: what each removes in every order, and how they overlap.

Duplicates are found by refining a partition: texts are split by their number of code
points, then by the hash of one block after the other, and whatever stands alone is
dropped between the steps.  Only the texts left at the end are compared, each with the
least id of its class.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, labelled

FILTERS = "ABCDE"
BITS = {f: 1 << i for i, f in enumerate(FILTERS)}
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: First bytes of the blocks that are hashed; the last block reaches to the end.
BLOCKS = (0, 256, 8192)
#: Most ids that are broadcast to fetch the texts of possible copies; more are joined by a shuffle.
FEW = 1_000_000

CAPITALS, SIGNS = bytes(range(ord("A"), ord("Z") + 1)), b"#$%&*|"


def own_failures(text: bytes, size: int) -> int:
    """The filters A to D that a text of ``size`` code points fails, as bits."""
    words = text.split()
    few = len(words) < 50
    repeats = 100 * len(set(words)) < 65 * len(words)
    loud = 100 * (len(text) - len(text.translate(None, CAPITALS))) > 5 * size
    signs = len(text.translate(None, SIGNS)) < len(text)
    return few * BITS["A"] | repeats * BITS["B"] | loud * BITS["C"] | signs * BITS["D"]


def block_hashes(text: bytes, blocks: tuple[int, ...] = BLOCKS) -> list[int]:
    """Signed 64-bit hashes of the blocks."""
    ends = [*blocks[1:], len(text)]
    return [xxhash.xxh3_64_intdigest(text[s:e]) - (1 << 63) for s, e in zip(blocks, ends, strict=True)]


def examined(documents: DataFrame, keep: tuple[str, ...], blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """``keep`` with ``size`` in code points, block ``hashes`` and the ``mask`` of A to D; null texts are empty."""

    def run(batches):
        for b in batches:
            text = b.column("text").cast(pa.binary())
            texts = [t or b"" for t in text.to_pylist()]
            sizes = [len(t) - int(np.count_nonzero(np.frombuffer(t, np.uint8) & 0xC0 == 0x80)) for t in texts]
            cols = {
                "size": pa.array(sizes, pa.int64()),
                "hashes": pa.array([block_hashes(t, blocks) for t in texts], pa.list_(pa.int64())),
                "mask": pa.array([own_failures(t, n) for t, n in zip(texts, sizes, strict=True)], pa.int32()),
            }
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *cols.values()], [*keep, *cols])

    source = documents.select(*dict.fromkeys((*keep, "text")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)
    return source.mapInArrow(run, f"{fields}, size long, hashes array<long>, mask int")


def classes(blocks: tuple[int, ...] = BLOCKS) -> list:
    """The classes of a row, from coarse to fine: by size, then by one more block each."""
    out = [F.col("size")]
    for k in range(len(blocks)):
        out.append(F.xxhash64(out[-1], F.get("hashes", F.lit(k))))
    return out


def copies(documents: DataFrame, rows: DataFrame, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """Distinct (doc_id, cls) of the rows whose text is that of a smaller doc_id.

    ``rows`` has doc_id, size and hashes of every document, ``cls`` is the last of
    ``classes``.  A class of one id is dropped at each step.  Texts of a class that
    differ (equal hashes) are compared again among themselves, until none is left.
    Rows without an id take no part.
    """
    steps = classes(blocks)
    alive = rows.filter("doc_id is not null").select("doc_id", *[c.alias(f"c{k}") for k, c in enumerate(steps)])
    for k in range(len(steps)):
        # sums are written before the join, so that the skew join can split a large class
        shared = alive.groupBy(f"c{k}").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z").select(f"c{k}")
        alive = alive.join(cut(shared, "shared"), f"c{k}", "left_semi")
    alive = cut(alive.select("doc_id").distinct(), "alive")
    few = alive.count() <= FEW
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(alive) if few else alive, "doc_id", "left_semi")
    rest = cut(examined(texts, ("doc_id", "text"), blocks).select("doc_id", "text", steps[-1].alias("cls")), "texts")
    found = []
    while True:
        first = cut(rest.groupBy("cls").agg(F.min(F.struct("doc_id", "text")).alias("first")), "first")
        same = rest.join(first, "cls").select("doc_id", "cls", "text", (F.col("text") == F.col("first.text")).alias("same"), (F.col("doc_id") > F.col("first.doc_id")).alias("later"))
        found.append(cut(same.filter("not same or later").withColumn("text", F.when(~F.col("same"), F.col("text"))), "compared"))
        rest = found[-1].filter("not same").select("doc_id", "text", "cls")
        if rest.isEmpty():
            break
    marks = found[0]
    for more in found[1:]:
        marks = marks.unionByName(more)
    return marks.filter("same").select("doc_id", "cls").distinct()


def failures(documents: DataFrame, part: str = "source", blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """Per row: doc_id, ``part`` (null: empty) and ``mask``, a bit for each filter that the text fails."""
    rows = documents.select("doc_id", "text", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = cut(examined(rows, ("doc_id", "part"), blocks), "examined")
    marks = copies(documents, rows, blocks).withColumn("copy", F.lit(BITS["E"]))
    rows = rows.withColumn("cls", classes(blocks)[-1]).join(marks, ["doc_id", "cls"], "left")
    return rows.select("doc_id", "part", F.col("mask").bitwiseOR(F.coalesce("copy", F.lit(0))).alias("mask"))


def interactions(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, filter order and step; see ``COUNTS`` below for the columns.

    ``documents`` needs doc_id, text and ``part``, ``labels`` doc_id, quality and
    toxic.  Null texts are empty, null parts too; rows that repeat an id count each,
    and are no copies of one another; rows without an id are copies of none and have
    no labels.  An id labelled more than once takes its highest label.  Documents are
    reduced to counts by part and set of failed filters (at most 32 a part) before
    the orders are laid out.  An empty table has no parts and no rows.
    """
    rows = failures(documents, part)
    marks = labelled(labels, "quality").withColumnRenamed("label", "good").join(labelled(labels, "toxic").withColumnRenamed("label", "toxic"), "doc_id", "full")
    rows = rows.join(marks, "doc_id", "left")
    sets = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    laid = sets.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = {f: F.locate(f, F.col("filter_order")) for f in FILTERS}
    own = sum((F.when(place[f] == F.col("step"), BITS[f]).otherwise(0) for f in FILTERS), F.lit(0))
    prior = sum((F.when(place[f] < F.col("step"), BITS[f]).otherwise(0) for f in FILTERS), F.lit(0))
    laid = laid.withColumns({"own": own, "prior": prior})
    hit, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("prior")) != 0
    total = lambda where, what: F.sum(F.when(where, F.col(what) if isinstance(what, str) else what).otherwise(0)).cast("long")
    share = F.floor(F.lit(len(ORDERS)) / F.greatest(F.bit_count("mask"), F.lit(1))) * F.col("n")
    return laid.groupBy("part", "filter_order", "step").agg(
        total(~hit & ~gone, "n").alias("kept"), total(hit & ~gone, "n").alias("removed"), total(hit & gone, "n").alias("redundant"), total(F.col("mask") == F.col("own"), "n").alias("unique_fails"),
        total(hit & ~gone, "good").alias("good_lost"), total(hit & ~gone, "toxic").alias("toxic_lost"), total(hit, share).alias("shapley"),
    )


#: What the counts of a step mean, within its part.
COUNTS = {
    "kept": "documents that pass this and all earlier filters",
    "removed": "documents removed here",
    "redundant": "documents that fail here and were removed earlier",
    "unique_fails": "documents that fail this filter only",
    "good_lost": "removed here with quality 1",
    "toxic_lost": "removed here with toxic 1",
    "shapley": "removed by this filter, summed over all orders",
}
