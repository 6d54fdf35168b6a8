"""Near duplicates of vectors by cross-polytope hashing.

Three hash functions each turn a unit vector by random signs and fast Hadamard
transforms (three rounds) and take the nearest corners of the cross-polytope: the
``FIRST`` best of the first function, and the ``REST`` best pairs of corners of the
other two by least total loss.  Two vectors are candidates if they share a corner of
the first and a pair of the others, so each looks into several buckets of the other.
Candidates are verified in their bucket by vectors of 16-bit integers whose error is
bounded; the few within that error of the limit are verified in double precision.

At the limit of 0.93 two vectors of 64 numbers share a bucket with a probability of
0.9999, at 0.95 of 0.99998; of 400,000 random pairs at 0.97 none was missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components

FIRST, REST, ROUNDS, SEED = 6, 24, 3, 42
#: Corners looked at for each of the two later functions.
DEPTH = 8
SCALE = 32_767.0
#: Rows of a group that are compared together before it is parted by its buckets, and of a part before it is dealt into blocks.
GROUP, BLOCK = 4_096, 16_384
#: Most oversized groups that are broadcast; more are joined by a shuffle.
FEW = 1_000_000
#: Buckets of more rows are compared by matrix products, smaller ones all together.
SMALL = 24


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; no row is zero."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two long), keeping lengths."""
    n, width, h = len(x), x.shape[1], 1
    while h < width:
        pairs = x.reshape(n, -1, 2, h)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def side(size: int) -> int:
    """Corners of the cross-polytope for vectors of ``size`` numbers (padded to a power of two)."""
    return 2 << max(1, (size - 1).bit_length())


def wide(size: int) -> int:
    """Bytes of a pair of corners."""
    return 2 if side(size) <= 128 else 4


def corners(x: np.ndarray, k: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` nearest corners of function ``k`` for each row, best first, and their losses against the best."""
    width = side(x.shape[1]) // 2
    turned = np.zeros((len(x), width))
    turned[:, : x.shape[1]] = x
    signs = np.random.default_rng([SEED, k]).choice([-1.0, 1.0], size=(ROUNDS, width))
    for s in signs:
        turned = hadamard(turned * s)
    count = min(count, width)
    size = np.abs(turned)
    at = np.argsort(-size, axis=1, kind="stable")[:, :count]
    best = np.take_along_axis(size, at, 1)
    return 2 * at + (np.take_along_axis(turned, at, 1) < 0), best[:, :1] - best


def probes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the corners of the first function, and the numbers of the best corner pairs of the others; both ascending."""
    first, _ = corners(x, 0, FIRST)
    (a, lost_a), (b, lost_b) = corners(x, 1, DEPTH), corners(x, 2, DEPTH)
    ways = [(i, j) for i, j in product(range(a.shape[1]), range(b.shape[1])) if (i + 1) * (j + 1) <= REST]
    i, j = np.array(ways).T
    at = np.argsort(lost_a[:, i] + lost_b[:, j], axis=1, kind="stable")[:, :REST]
    both = np.take_along_axis(a[:, i] * side(x.shape[1]) + b[:, j], at, 1)
    return np.sort(first, axis=1), np.sort(both, axis=1)


def pack(first: np.ndarray, rest: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """One row of bytes a vector: corners, corner pairs (missing ones as all ones), 16-bit numbers."""
    out = []
    for cells, count, width in ((first, FIRST, 4), (rest, REST, wide(whole.shape[1]))):
        full = np.full((len(cells), count), (1 << 8 * width) - 1, f">u{width}")
        full[:, : cells.shape[1]] = cells
        out.append(full.view(np.uint8).reshape(len(cells), -1))
    return np.concatenate((*out, np.ascontiguousarray(whole, "<i2").view(np.uint8).reshape(len(whole), -1)), axis=1)


def unpack(packed: np.ndarray, size: int) -> dict[str, np.ndarray]:
    ends = np.cumsum([0, 4 * FIRST, wide(size) * REST, 2 * size])
    parts = [np.ascontiguousarray(packed[:, s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
    return {"first": parts[0].view(">u4").astype(np.int64), "rest": parts[1].view(f">u{wide(size)}").astype(np.int64), "q": parts[2].view("<i2")}


def sketched(distinct: DataFrame) -> DataFrame:
    """Adds ``size``, the corners ``first``, and ``pack`` in place of ``embedding``."""
    kept = [c for c in distinct.columns if c != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("embedding")
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
            first: list = [None] * len(lengths)
            packed = first.copy()
            for d in np.unique(lengths).tolist():
                rows = np.nonzero(lengths == d)[0]
                x = unit(values[starts[rows, None] + np.arange(d)])
                f, r = probes(x)
                whole = pack(f, r, np.rint(x * SCALE))
                for k, row in enumerate(rows.tolist()):
                    first[row], packed[row] = f[k].tolist(), whole[k].tobytes()
            made = [pa.array(lengths, pa.int32()), pa.array(first, pa.list_(pa.int32())), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made], [*kept, "size", "first", "pack"])

    fields = ", ".join(f"`{c}` {t}" for c, t in distinct.dtypes if c != "embedding")
    return distinct.mapInArrow(run, f"{fields}, size int, first array<int>, pack binary")


def dealt(sketches: DataFrame) -> DataFrame:
    """Rows (label, size, corner, parts, part, i, j, own, node, n, pack) of which any two candidates meet in one unit.

    A unit is (label, size, corner, part, i, j).  A group (label, size, corner) of over
    ``GROUP`` rows is parted by its buckets, so a row goes to ``REST`` parts at most;
    a part of over ``BLOCK`` rows holds a bucket of very many near copies and is dealt
    into blocks that meet in pairs.
    """
    group = ["label", "size", "corner"]
    rows = sketches.withColumn("corner", F.explode("first"))

    def shares(counted: DataFrame, keys: list[str], limit: int, name: str) -> DataFrame:
        large = counted.groupBy(*keys).agg(F.count("*").alias("c")).filter(F.col("c") > limit)
        large = cut(large.select(*keys, F.ceil(F.col("c") / limit).cast("int").alias(name)), name)
        return F.broadcast(large) if large.count() <= FEW else large

    rows = rows.join(shares(rows.select(*group), group, GROUP, "parts"), group, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    width = F.when(F.col("size") <= 64, wide(64)).otherwise(wide(65))
    bucket = lambda k: F.conv(F.hex(F.substring(F.col("pack"), 4 * FIRST + 1 + k * width, width)), 16, 10).cast("long")
    parts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(REST - 1)), lambda k: F.pmod(bucket(k), F.col("parts")).cast("int")))
    rows = rows.withColumn("part", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(parts)))
    unit_keys = [*group, "part"]
    rows = rows.join(shares(rows.select(*unit_keys), unit_keys, BLOCK, "blocks"), unit_keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})


UNIT = ["label", "size", "corner", "part", "i", "j"]
FOUND = "kind int, a long, b long, n long"
#: Kinds of rows found: links of a node, a pair of nodes in one component, a pair too near the limit to tell.
COUNT, EDGE, UNSURE = 0, 1, 2
NOTHING = pa.RecordBatch.from_arrays([pa.array([], pa.int32()), *[pa.array([], pa.int64())] * 3], ["kind", "a", "b", "n"])


def shared_least(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least number that two rows share, for each row of the two matrices."""
    same = (x[:, :, None] == y[:, None, :]).any(axis=2)
    return np.where(same, x, np.iinfo(x.dtype).max).min(axis=1)


class Block:
    """Whole units held by a task: row arrays, the links found so far, and who they join."""

    def __init__(self, cols: dict[str, np.ndarray], least: float) -> None:
        self.c, self.least = cols, least
        rows = len(cols["node"])
        self.links, self.root = np.zeros(rows), np.arange(rows)
        self.unsure: list[tuple[np.ndarray, np.ndarray]] = []
        width = cols["q"].shape[1]
        self.x = cols["q"].astype(np.float32) / np.float32(SCALE)
        #: Bound of the error of a product of two rows: each number is off by half a step at most.
        self.off = 2.1 * np.sqrt(width) * 0.5 / SCALE + 1e-5

    def take(self, a: np.ndarray, b: np.ndarray, cos: np.ndarray) -> None:
        """Keep pairs of rows by their cosine."""
        sure = cos >= self.least + self.off
        if not sure.all():
            self.unsure.append((a[~sure], b[~sure]))
            a, b = a[sure], b[sure]
        n = self.c["n"]
        self.links += np.bincount(a, n[b], len(self.links)) + np.bincount(b, n[a], len(self.links))
        while len(a):
            p, q = self.root[a], self.root[b]
            apart = p != q
            a, b = a[apart], b[apart]
            low, high = np.minimum(p, q)[apart], np.maximum(p, q)[apart]
            np.minimum.at(self.root, high, low)
            while (self.root != (up := self.root[self.root])).any():
                self.root = up

    def small(self, row: np.ndarray, bucket: np.ndarray, key: np.ndarray) -> None:
        """Buckets of few rows, all together: entries (row, bucket, key) by bucket."""
        d = 1
        while d < len(row):
            same = bucket[:-d] == bucket[d:]
            if not same.any():
                return
            at = np.nonzero(same)[0]
            for s in range(0, len(at), 1 << 16):
                k = at[s : s + (1 << 16)]
                self.pairs(row[k], row[k + d], key[k])
            d += 1

    def pairs(self, a: np.ndarray, b: np.ndarray, key: np.ndarray) -> None:
        c = self.c
        met = (c["i"][a] == c["j"][a]) | (c["own"][a] != c["own"][b])
        a, b, key = a[met], b[met], key[met]
        cos = np.einsum("ij,ij->i", self.x[a], self.x[b])
        at = np.nonzero(cos >= self.least - self.off)[0]
        a, b, key, cos = a[at], b[at], key[at], cos[at]
        own = (shared_least(c["rest"][a], c["rest"][b]) == key) & (shared_least(c["first"][a], c["first"][b]) == c["corner"][a])
        self.take(a[own], b[own], cos[own])

    def large(self, row: np.ndarray, key: int) -> None:
        """One bucket of many rows, by products of slices of rows with all rows."""
        c = self.c
        before = np.concatenate((np.where(c["rest"][row] < key, c["rest"][row], -1), np.where(c["first"][row] < c["corner"][row[0]], -2 - c["first"][row], -1)), axis=1)
        known, place = np.unique(before, return_inverse=True)
        met = np.zeros((len(row), len(known)), np.float32)
        met[np.arange(len(row))[:, None], place.reshape(before.shape)] = 1
        met = met[:, (known != -1) & (met.sum(axis=0) > 1)]
        x, crossed = self.x[row], c["i"][row[0]] != c["j"][row[0]]
        for s in range(0, len(row) - 1, 512):
            e = min(s + 512, len(row))
            cos = x[s:e] @ x[s:].T
            new = (cos >= self.least - self.off) & (met[s:e] @ met[s:].T == 0)
            new &= np.arange(e - s)[:, None] < np.arange(len(row) - s)[None, :]
            if crossed:
                new &= c["own"][row[s:e]][:, None] != c["own"][row[s:]][None, :]
            a, b = np.nonzero(new)
            self.take(row[s + a], row[s + b], cos[a, b])

    def solve(self, unit: np.ndarray) -> pa.RecordBatch:
        c = self.c
        key, none = c["rest"].ravel(), (1 << 8 * wide(self.x.shape[1])) - 1
        row = np.repeat(np.arange(len(unit)), c["rest"].shape[1])
        here = (key != none) & (key % c["parts"][row] == c["part"][row])
        row, key = row[here], key[here]
        if not len(row):
            return NOTHING
        order = np.lexsort((row, key, unit[row]))
        row, key = row[order], key[order]
        starts = np.concatenate(([True], (key[1:] != key[:-1]) | (unit[row[1:]] != unit[row[:-1]])))
        bucket = np.cumsum(starts) - 1
        sizes = np.bincount(bucket)
        few = (sizes[bucket] > 1) & (sizes[bucket] <= SMALL)
        self.small(row[few], bucket[few], key[few])
        ends = np.cumsum(sizes)
        for k in np.nonzero(sizes > SMALL)[0].tolist():
            self.large(row[ends[k] - sizes[k] : ends[k]], int(key[ends[k] - 1]))
        node, linked, joined = c["node"], np.nonzero(self.links)[0], np.nonzero(self.root != np.arange(len(unit)))[0]
        p, q = (np.concatenate([u[k] for u in self.unsure] or [np.empty(0, np.int64)]) for k in (0, 1))
        kinds = np.repeat(np.array([COUNT, EDGE, UNSURE], np.int32), [len(linked), len(joined), len(p)])
        a = node[np.concatenate((linked, joined, p))]
        b = np.concatenate((node[linked], node[self.root[joined]], node[q]))
        n = np.concatenate((self.links[linked].astype(np.int64), np.zeros(len(joined) + len(p), np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(a), pa.array(b), pa.array(n)], ["kind", "a", "b", "n"])


def compared(rows: DataFrame, least: float) -> DataFrame:
    """What the units hold, as rows of ``FOUND``; each pair of nodes is taken in one unit, in its least shared bucket."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = ("corner", "parts", "part", "i", "j", "own", "node", "n")

    def done(table: pa.Table, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = table.column("size").to_numpy()
        for d in np.unique(size).tolist():
            at = np.nonzero(size == d)[0]
            part = table.take(pa.array(at)).combine_chunks()
            cols = {k: part.column(k).to_numpy().astype(np.int64) for k in numbers}
            cols |= unpack(np.frombuffer(b"".join(part.column("pack").to_pylist()), np.uint8).reshape(len(at), -1), d)
            yield Block(cols, least).solve(unit[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held is not None else new
            if held.num_rows >= BLOCK:
                unit = numbered(held)
                end = int(np.searchsorted(unit, unit[-1]))
                if end:
                    yield from done(held.slice(0, end), unit[:end])
                    held = held.slice(end)
        if held is not None and held.num_rows:
            yield from done(held, numbered(held))

    def numbered(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for k in UNIT:
            values = table.column(k).combine_chunks().dictionary_encode()
            codes = (values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values).indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(new)

    wanted = rows.select(*dict.fromkeys((*UNIT, *numbers)), "pack")
    return wanted.repartition(parts, *UNIT).sortWithinPartitions(*UNIT).mapInArrow(run, FOUND)


def exact(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose vectors (node, embedding, n) have a cosine of ``least`` or more; with n_a and n_b."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = cut(vectors.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "unsure")
    for side in ("a", "b"):
        pairs = pairs.join(own.select(F.col("node").alias(side), F.col("embedding").alias(f"x_{side}"), F.col("n").alias(f"n_{side}")), side)
    sums = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    scaled = lambda c: F.transform(c, lambda v: v.cast("double") / F.array_max(F.transform(c, lambda w: F.abs(w.cast("double")))))
    x, y = scaled(F.col("x_a")), scaled(F.col("x_b"))
    return pairs.filter(sums(x, y) / F.sqrt(sums(x, x) * sums(y, y)) >= least).select("a", "b", "n_a", "n_b")


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """Per row: vec_id, ``n_links``, ``component_id`` and ``kept``.

    Rows of equal, non-null ``label`` link when the cosine of their ``embedding``
    vectors is ``least`` or more; vectors of different lengths never do.  Vectors that
    are null, empty or zero, or hold nulls or numbers that are not finite, link with
    nothing.  Equal vectors of a label are compared once and counted for each other.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the least
    vec_id reachable, itself included, ``kept`` says whether it is the row's own.
    Rows that repeat an id are vectors of their own; rows without an id link as any
    other and are never kept.  An empty table gives an empty result.
    """
    source = vectors.select("vec_id", "label", "embedding")
    number = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", number) & F.exists("embedding", lambda v: v != 0)
    marks = {"d1": F.xxhash64("label", "embedding"), "d2": F.xxhash64(F.lit(1), "embedding", "label")}
    rows = source.withColumn("embedding", F.when(usable, F.col("embedding")))
    whole = rows.filter("embedding is not null").withColumns(marks)
    # only vectors that occur more than once have a sum to fetch, so the vectors themselves are not shuffled
    repeated = cut(whole.groupBy("d1", "d2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).filter("n > 1"), "repeated")
    joined = whole.join(F.broadcast(repeated) if repeated.count() <= FEW else repeated, ["d1", "d2"], "left")
    once = joined.filter("n is null").withColumns({"least": F.col("vec_id"), "n": F.lit(1).cast("long")})
    one_of = cut(joined.filter(F.col("n").isNotNull() & F.col("vec_id").eqNullSafe(F.col("least"))).dropDuplicates(["d1", "d2"]), "one_of")
    distinct = once.unionByName(one_of).select("label", "embedding", "least", "n", "d1", "d2", F.monotonically_increasing_id().alias("node"))
    heads = cut(sketched(distinct), "sketches")
    found = cut(compared(dealt(heads.select("label", "size", "node", "n", "first", "pack")), least), "found")
    places = heads.select("node", "n", "d1", "d2")
    unsure = found.filter(F.col("kind") == UNSURE).select("a", "b").distinct()
    if not unsure.isEmpty():
        near = whole.join(places, ["d1", "d2"]).select("node", "embedding", "n")
        sure = cut(exact(unsure, near, least), "exact")
        both = F.explode(F.array(F.struct(F.lit(COUNT).alias("kind"), F.col("a"), F.col("b"), F.col("n_b").alias("n")), F.struct(F.lit(COUNT).alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_a").alias("n"))))
        found = found.unionByName(sure.select(both.alias("x")).select("x.*")).unionByName(sure.select(F.lit(EDGE).alias("kind"), "a", "b", F.lit(0).cast("long").alias("n")))
    counts = found.filter(F.col("kind") == COUNT).groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "node")
    roots = components(found.filter(F.col("kind") == EDGE).select("a", "b"))
    named = heads.select("node", "n", "least", "d1", "d2").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(named.join(first, "root").select("d1", "d2", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "named")
    keyed = rows.select("vec_id", *[F.when(F.col("embedding").isNotNull(), c).alias(k) for k, c in marks.items()])
    out = keyed.join(named, ["d1", "d2"], "left")
    alone = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), alone.cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
