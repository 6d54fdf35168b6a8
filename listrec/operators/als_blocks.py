"""Training of implicit ALS on packed blocks, a few of them at a time.

Users and items fall into blocks by a hash of their ids.  To solve the users of a block
its task gets the factors of the items that they have, each once.  With all blocks at
once these copies would be many times the factors, and Spark's own trainer keeps them
on disk for several iterations; here only a few blocks for each core are solved at a
time, and the shuffle files of each go when its factors are written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import io

#: Ratings of a block at most (a task holds the factors of as many ids), and at least if there are cores to spare.
MOST, LEAST = 500_000, 50_000
#: Blocks that are solved at a time, for each core.
EACH = 3
#: Ratings that are multiplied together.
TOGETHER = 4096
LISTS = "block int, ids binary, lengths binary, places binary, weights binary, starts binary, wanted array<binary>"
FACTORS = "block int, ids binary, factors binary, gram binary"


def _block(col: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(col).cast("long")), F.lit(blocks)).cast("int")


def _batch(kind: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    names = [c.split(" ") for c in kind.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(names)], [n for n, _ in names])


def lists_of(ratings: DataFrame, own: str, other: str, blocks: int) -> DataFrame:
    """One row a block of ``own`` ids: the ids, how many ratings each has, and these as places in a list of ``other`` ids.

    That list is in order of the other side's blocks, ``starts`` says where each begins
    and ``wanted`` has its ids by block.
    """
    cols = [_block(own, blocks).alias("block"), F.col(own).cast("long").alias("own"), F.col(other).cast("long").alias("other"), _block(other, blocks).alias("source"), F.col("weight").cast("float").alias("weight")]
    placed = ratings.select(*cols).filter("own is not null and other is not null").repartitionById(blocks, "block").sortWithinPartitions("own", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # one block
        if not held:
            return
        block, own, other, source, weight = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
        first = np.nonzero(np.append(True, own[1:] != own[:-1]))[0]
        lengths = np.diff(np.append(first, len(own)))
        names, at, place = np.unique(other, return_index=True, return_inverse=True)
        order = np.argsort(source[at], kind="stable")
        back = np.empty(len(names), np.int32)
        back[order] = np.arange(len(names), dtype=np.int32)
        starts = np.searchsorted(source[at][order], np.arange(blocks + 1)).astype(np.int64)
        wanted = [names[order[s:e]].tobytes() for s, e in zip(starts[:-1], starts[1:], strict=True)]
        yield _batch(LISTS, [(int(block[0]), own[first].tobytes(), lengths.astype(np.int32).tobytes(), back[place].tobytes(), weight.astype(np.float32).tobytes(), starts.tobytes(), wanted)])

    return placed.mapInArrow(run, LISTS)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers of ``x`` (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def first_factors(ids: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """A random direction for each id, the same however ids are dealt."""
    base = _mixed(ids.astype(np.uint64) ^ _mixed(np.full(1, seed, np.uint64)))[:, None]
    u, v = ((_mixed(base + np.arange(s, s + rank, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53 for s in (0, rank))
    x = np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * np.pi * v)
    return (x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[:, None]).astype(np.float32)


def _row(block: int, ids: bytes, x: np.ndarray) -> tuple:
    z = x.astype(np.float64)
    return block, ids, x.tobytes(), (z.T @ z).tobytes()


def _begin(lists: DataFrame, rank: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ids in zip(b.column("block").to_pylist(), b.column("ids").to_pylist(), strict=True):
                yield _batch(FACTORS, [_row(block, ids, first_factors(np.frombuffer(ids, np.int64), rank, seed))])

    return lists.select("block", "ids").mapInArrow(run, FACTORS)


def _cholesky_solve(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solutions of many small positive definite systems."""
    low, x = np.linalg.cholesky(left), right.copy()
    for j in range(x.shape[1]):
        x[:, j] = (x[:, j] - np.einsum("mi,mi->m", low[:, j, :j], x[:, :j])) / low[:, j, j]
    for j in reversed(range(x.shape[1])):
        x[:, j] = (x[:, j] - np.einsum("mi,mi->m", low[:, j + 1 :, j], x[:, j + 1 :])) / low[:, j, j]
    return x


def solved(lengths: np.ndarray, places: np.ndarray, weights: np.ndarray, y: np.ndarray, gram: np.ndarray, reg: float, alpha: float) -> np.ndarray:
    """The least-squares factor of each id, ids of equally many ratings together; a weight that is not positive counts as no interest."""
    k = y.shape[1]
    begins, order = np.cumsum(lengths) - lengths, np.argsort(lengths, kind="stable")
    out, at = np.empty((len(lengths), k), np.float32), 0
    while at < len(order):
        n = int(lengths[order[at]])
        some = order[at : min(at + max(1, TOGETHER // n), int(np.searchsorted(lengths, n, side="right", sorter=order)))]
        left, right, liked = 0.0, np.zeros((len(some), k)), np.zeros(len(some))
        for s in range(0, n, TOGETHER):  # the ratings of one id can be many
            cells = begins[some][:, None] + np.arange(s, min(n, s + TOGETHER))
            own, w = y[places[cells]].astype(np.float64), weights[cells].astype(np.float64)
            c, positive = alpha * np.abs(w), w > 0
            product = (own * c[:, :, None]).transpose(0, 2, 1) @ own
            left = product if s == 0 else left + product
            right += (((1 + c) * positive)[:, None, :] @ own)[:, 0]
            liked += positive.sum(axis=1)
        left += gram
        left[:, np.arange(k), np.arange(k)] += reg * liked[:, None]
        try:
            out[some] = _cholesky_solve(left, right)
        except np.linalg.LinAlgError:
            out[some] = (np.linalg.pinv(left) @ right[:, :, None])[:, :, 0]
        at += len(some)
    return out


def _sent(factors: DataFrame, lists: DataFrame, rank: int, blocks: int) -> DataFrame:
    """(block, source, data): to each block of ``lists`` the factors that it wants, by the block that they come from."""
    none = lambda t: F.lit(None).cast(t)
    asked = lists.select(F.col("block").alias("to"), F.posexplode("wanted").alias("block", "ids")).filter(F.length("ids") > 0).select("block", "to", "ids", none("binary").alias("factors"))
    rows = factors.select("block", F.lit(-1).alias("to"), "ids", "factors").unionByName(asked)
    kind = "block int, source int, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block, to, ids, data = (b.column(c)[i].as_py() for c in ("block", "to", "ids", "factors"))
                if to < 0:
                    own, x = np.frombuffer(ids, np.int64), np.frombuffer(data, np.float32).reshape(-1, rank)
                else:
                    yield _batch(kind, [(to, block, x[np.searchsorted(own, np.frombuffer(ids, np.int64))].tobytes())])

    return rows.repartitionById(blocks, "block").sortWithinPartitions("block", "to").mapInArrow(run, kind)


def _step(factors: DataFrame, lists: DataFrame, blocks: int, first: int, last: int, gram: np.ndarray, reg: float, alpha: float) -> DataFrame:
    """The factors of the blocks from ``first`` to ``last`` - 1 of ``lists``, given those of the other side."""
    rank, some = len(gram), lists.filter((F.col("block") >= first) & (F.col("block") < last))
    parts = ("ids", "lengths", "places", "weights", "starts")
    rows = some.select("block", F.lit(-1).alias("source"), *parts).unionByName(_sent(factors, some, rank, blocks), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for i in range(b.num_rows):
                source = b.column("source")[i].as_py()
                if source >= 0:
                    data = np.frombuffer(b.column("data")[i].as_buffer(), np.float32).reshape(-1, rank)
                    y[starts[source] : starts[source] + len(data)] = data
                    continue
                if held:
                    yield _batch(FACTORS, [_row(*held, solved(lengths, places, weights, y, gram, reg, alpha))])
                held = b.column("block")[i].as_py(), b.column("ids")[i].as_py()
                lengths, places, weights, starts = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in zip(parts[1:], (np.int32, np.int32, np.float32, np.int64), strict=True))
                y = np.zeros((starts[-1], rank), np.float32)
        if held:
            yield _batch(FACTORS, [_row(*held, solved(lengths, places, weights, y, gram, reg, alpha))])

    return rows.repartitionById(last - first, F.col("block") - first).sortWithinPartitions("block", "source").mapInArrow(run, FACTORS)


def _gram(factors: DataFrame, rank: int) -> np.ndarray:
    """The sum of the blocks' small squares."""
    return sum((np.frombuffer(r["gram"]).reshape(rank, rank) for r in factors.select("gram").collect()), np.zeros((rank, rank)))


def unpacked(factors: DataFrame, rank: int) -> DataFrame:
    """(id, features) of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, data in zip(b.column("ids").to_pylist(), b.column("factors").to_pylist(), strict=True):
                own, x = np.frombuffer(ids, np.int64), np.frombuffer(data, np.float32)
                for s in range(0, len(own), 10_000):
                    part = own[s : s + 10_000]
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * rank), pa.array(x[s * rank : (s + len(part)) * rank]))
                    yield pa.RecordBatch.from_arrays([pa.array(part), rows], ["id", "features"])

    return factors.select("ids", "factors").mapInArrow(run, "id long, features array<float>")


@dataclass
class Factors:
    """(id, features) of both sides; ``userFactors`` are None if they were not asked for."""

    userFactors: DataFrame | None
    itemFactors: DataFrame
    rank: int


def train(ratings: DataFrame, user: str = "user_id", item: str = "item_id", rank: int = 32, reg: float = 0.1, iterations: int = 15, alpha: float = 1.0, seed: int = 42, users: bool = True, most: int = MOST, at_once: int | None = None) -> Factors:
    """Implicit ALS on the rows of ``user``, ``item`` and ``weight``, read several times: they should lie in files.

    Items are solved first, from random user factors, then users from the items, and
    so on; the problems are those of Spark ML's implicit ALS.  Without ``users`` the last
    round of users is left out.  Blocks hold up to ``most`` ratings, and ``at_once``
    of them (``EACH`` for each core, if not given) are solved at a time, which bounds the disk.
    """
    spark = ratings.sparkSession
    rows, cores = ratings.count(), spark.sparkContext.defaultParallelism
    at_once = at_once or EACH * cores
    blocks = max(1, -(-rows // most), min(cores, rows // LEAST))
    blocks = blocks if blocks <= at_once else -(-blocks // at_once) * at_once
    made: list[str] = []

    def staged(df: DataFrame, name: str) -> DataFrame:
        made.append(io.shared_path(spark, name))
        io.write_stage(df, made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    lists = {"user": staged(lists_of(ratings, user, item, blocks), "lists"), "item": staged(lists_of(ratings, item, user, blocks), "lists")}
    kept = list(made)
    factors, old = staged(_begin(lists["user"], rank, seed), "factors"), made[-1:]
    sides = {"user": (factors, old)}
    for side in [*["item", "user"] * max(iterations, 1)][: 2 * max(iterations, 1) - (not users)]:
        gram, before, new = _gram(factors, rank), factors, []
        for first in range(0, blocks, at_once):
            staged(_step(before, lists[side], blocks, first, min(first + at_once, blocks), gram, reg, alpha), "factors")
            new.append(made[-1])
        factors = spark.read.schema(FACTORS).parquet(*new)
        for path in sides.get(side, (None, []))[1]:
            io.remove(spark, path)
        sides[side] = factors, new
    out = {side: io.staged(unpacked(f, rank), f"{side}_factors") for side, (f, _) in sides.items() if users or side == "item"}
    for path in [*kept, *sides["user"][1], *sides["item"][1]]:
        io.remove(spark, path)
    return Factors(out.get("user"), out["item"], rank)
