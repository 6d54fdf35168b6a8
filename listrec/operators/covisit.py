"""Item co-visitation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_MS = 86_400_000


#: A user with more events than this has their log split by time.
HEAVY = 1_000_000


def _next_pairs(rows: DataFrame, keys: list[str], own: Column, depth: int, max_gap_ms: int) -> DataFrame:
    """Distinct pairs of the ``own`` rows with the rows that follow in their partition."""
    order = Window.partitionBy(*keys).orderBy("timestamp", "item_id")
    after = [F.struct(F.lead("item_id", k).over(order).alias("item"), F.lead("timestamp", k).over(order).alias("time")) for k in range(1, depth + 1)]
    rows = rows.select(*keys, "item_id", "timestamp", F.array(*after).alias("next")).filter(own)
    rows = rows.select("user_id", "item_id", "timestamp", F.explode("next").alias("n"))
    rows = rows.filter((F.col("n.item") != F.col("item_id")) & (F.col("n.time") - F.col("timestamp") <= max_gap_ms))
    return rows.select("user_id", F.least("item_id", "n.item").alias("item_a"), F.greatest("item_id", "n.item").alias("item_b")).distinct()


def user_pairs(events: DataFrame, depth: int = 3, max_gap_ms: int = GAP_MS, heavy: int = HEAVY) -> DataFrame:
    """Distinct (user_id, item_a, item_b), a < b, of events at most ``depth`` events and ``max_gap_ms`` apart.

    One window node serves all leads, and the distinct stays in its partitions.
    The depth counts events, repeats of an item included; rows stay linear in the
    events.  A user's log is ordered in one task, but that of a user with over
    ``heavy`` events is cut into stretches as long as the gap: each row also comes
    at the end of the stretch before its own, where the rows it may follow are.
    Such users are fewer than events / ``heavy``, so they are broadcast; mostly there
    are none, and then nothing is joined.
    """
    log = events.select("user_id", "item_id", "timestamp")
    counts = log.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") > heavy).select("user_id")
    found = [r["user_id"] for r in counts.toLocalIterator()]
    if not found:
        return _next_pairs(log, ["user_id"], F.lit(True), depth, max_gap_ms)
    many = F.broadcast(log.sparkSession.createDataFrame([(u,) for u in found], log.select("user_id").schema))
    few = _next_pairs(log.join(many, "user_id", "left_anti"), ["user_id"], F.lit(True), depth, max_gap_ms)
    stretch = F.floor(F.col("timestamp") / F.lit(max_gap_ms + 1))
    split = log.join(many, "user_id", "left_semi").select("*", F.explode(F.array(stretch, stretch - 1)).alias("stretch"))
    return few.unionByName(_next_pairs(split, ["user_id", "stretch"], F.col("stretch") == stretch, depth, max_gap_ms))


def pair_counts(pairs: DataFrame, min_users: int = 3) -> DataFrame:
    """Users of each pair, those with at least ``min_users``."""
    return pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("weight")).filter(F.col("weight") >= min_users)


#: Cells of a row of the sketch, its rows, and the cells that are summed up in one go.
WIDTH, ROWS, CHUNK = 1 << 22, 2, 1 << 18


def _cells(a: np.ndarray, b: np.ndarray, width: int, row: int) -> np.ndarray:
    """A cell of one row of the sketch for each pair."""
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) + np.uint64(row * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
    return ((h ^ (h >> np.uint64(33))) % np.uint64(width)).astype(np.int64)


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("item_a", "item_b"))


def sketch(pairs: DataFrame, width: int = WIDTH, rows: int = ROWS) -> np.ndarray:
    """Upper bounds of the number of rows of each pair, as ``rows`` arrays of counts that stop at 255.

    Each task counts its pairs in arrays of its own; arrays are added up on the
    executors chunk by chunk, and the driver gets the sum of them, ``rows`` x
    ``width`` bytes whatever the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width), np.uint32)
        for batch in batches:
            a, b = _numbers(batch)
            for r in range(rows):
                np.add.at(total[r], _cells(a, b, width, r), 1)
        flat = np.minimum(total, 255).astype(np.uint8).ravel()
        chunks = [(k, flat[k : k + CHUNK]) for k in range(0, len(flat), CHUNK)]
        used = [(k, c.tobytes()) for k, c in chunks if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in used], pa.int64()), pa.array([c for _, c in used], pa.binary())], ["at", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column("at").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = np.frombuffer(c, np.uint8).astype(np.int64)
                sums[k] = sums[k] + own if k in sums else own
        out = [(k, np.minimum(v, 255).astype(np.uint8).tobytes()) for k, v in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([c for _, c in out], pa.binary())], ["at", "counts"])

    kind = "at long, counts binary"
    parts = pairs.select("item_a", "item_b").mapInArrow(count, kind).repartition("at").mapInArrow(add, kind)
    total = np.zeros(rows * width, np.uint8)
    for r in parts.toLocalIterator():
        total[r["at"] : r["at"] + len(r["counts"])] = np.frombuffer(r["counts"], np.uint8)
    return total.reshape(rows, width)


def frequent(pairs: DataFrame, bounds: np.ndarray, least: int) -> DataFrame:
    """The rows of pairs that may have ``least`` rows or more; no pair that has is lost."""
    if least > 255:
        raise ValueError("counts of the sketch stop at 255")
    width, held = bounds.shape[1], pairs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _numbers(batch)
            stays = np.ones(len(a), bool)
            for r, row in enumerate(held.value):
                stays &= row[_cells(a, b, width, r)] >= least
            yield batch.filter(pa.array(stays))

    rows = pairs.select("item_a", "item_b")
    return rows.mapInArrow(run, rows.schema)


def pair_counts_sketched(pairs: DataFrame, min_users: int = 3, width: int = WIDTH, rows: int = ROWS) -> DataFrame:
    """The rows of ``pair_counts``, with pairs of too few users kept out of the shuffle.

    Goes over ``pairs`` twice, so these should come from a written or bucketed table.
    Most pairs of a large log belong to one or two users; a sketch of bounded size
    tells nearly all of them before they are sent, and the rest is counted exactly.
    """
    return pair_counts(frequent(pairs, sketch(pairs, width, rows), min_users), min_users)


def symmetrize(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair, in one pass."""
    both = F.array(F.struct(F.col("item_a").alias("item_id"), F.col("item_b").alias("neighbor_id")), F.struct(F.col("item_b").alias("item_id"), F.col("item_a").alias("neighbor_id")))
    return pairs.select(F.explode(both).alias("e"), "weight").select("e.item_id", "e.neighbor_id", "weight")


def top_neighbors(edges: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` heaviest neighbours of each item, ranked from 1, ties by neighbour."""
    order = Window.partitionBy("item_id").orderBy(F.desc("weight"), "neighbor_id")
    return edges.withColumn("neighbor_rank", F.row_number().over(order)).filter(F.col("neighbor_rank") <= n)


def build(events: DataFrame, depth: int = 3, max_gap_ms: int = GAP_MS, min_users: int = 3, n: int = 50) -> DataFrame:
    """The whole matrix of raw events."""
    return top_neighbors(symmetrize(pair_counts(user_pairs(events, depth, max_gap_ms), min_users)), n)
