"""Implicit ALS: training, fold-in of unseen users, blocked top-N scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import io
from . import als_blocks


def fit(encoded: DataFrame, rank: int = 32, reg: float = 0.1, iterations: int = 15, alpha: float = 1.0, seed: int = 42) -> als_blocks.Factors:
    """Train implicit ALS on (user_idx, item_idx, weight), a few blocks at a time."""
    model = als_blocks.train(io.staged(encoded, "encoded"), "user_idx", "item_idx", rank, reg, iterations, alpha, seed)
    model.userFactors, model.itemFactors = (f.withColumn("id", F.col("id").cast("int")) for f in (model.userFactors, model.itemFactors))
    return model


def gram(item_factors: DataFrame) -> np.ndarray | None:
    """The product of the factor matrix with itself: each task sums, the driver adds up small squares; None without factors."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                y = b.column("features").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["g"])

    rows = [np.array(r["g"]) for r in item_factors.select("features").mapInArrow(part, "g array<double>").collect()]
    if not rows:
        return None
    total = np.sum(rows, axis=0)
    k = int(round(len(total) ** 0.5))
    return total.reshape(k, k)


def fold_in(history: DataFrame, item_factors: DataFrame, reg: float = 0.1, alpha: float = 1.0) -> DataFrame:
    """(user_id, features) of users from their history (user_id, item_id, weight) and item factors (id, features).

    The user's least-squares problem is that of the training, so a training user
    gets the stored factor.  Items without a factor are dropped; a user without any
    known item gives no row, no factors give an empty result.  Histories are capped
    upstream, so a user's list is short.
    """
    g = gram(item_factors)
    if g is None:
        return history.select(F.col("user_id").cast("long"), F.lit(None).cast("array<float>").alias("features")).limit(0)
    known = history.join(item_factors, F.col("item_id") == F.col("id"))
    per = known.groupBy("user_id").agg(F.collect_list("weight").alias("w"), F.collect_list("features").alias("y"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(g)
        for b in batches:
            lengths = b.column("w").value_lengths().to_numpy(zero_copy_only=False)
            w = alpha * b.column("w").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            y = b.column("y").flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, k)
            ends = np.cumsum(lengths)
            x = np.empty((b.num_rows, k), np.float32)
            for s in range(0, b.num_rows, 1024):  # so many systems at a time
                e = min(s + 1024, b.num_rows)
                left, right = np.empty((e - s, k, k)), np.empty((e - s, k))
                for i in range(s, e):
                    own = slice(ends[i] - lengths[i], ends[i])
                    left[i - s] = g + (y[own] * w[own, None]).T @ y[own] + reg * lengths[i] * np.eye(k)
                    right[i - s] = (1 + w[own]) @ y[own]
                x[s:e] = np.linalg.solve(left, right[:, :, None])[:, :, 0]
            features = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("user_id").cast(pa.int64()), features], ["user_id", "features"])

    return per.mapInArrow(solve, "user_id long, features array<float>")


def best_of(scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the ``n`` greatest scores and their ids, in no order; ties at the end go to the smaller ids."""
    if scores.shape[1] <= n:
        return scores, ids
    at = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    least = np.take_along_axis(scores, at, 1).min(axis=1)
    for row in np.nonzero((scores >= least[:, None]).sum(axis=1) > n)[0]:
        at[row] = np.lexsort((ids[row], -scores[row]))[:n]
    return np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)


#: Items of a block, and blocks of the longest items that every user is scored with first.
BLOCK, HEAD = 4096, 4
#: Users that are scored together, and their blocks that a task takes for one part of the items.
TOGETHER, RUN = 512, 16
#: Items of a part at most, which a task holds.
PART = 500_000
#: Bounds are loosened by this share, more than products of doubles are off; and by this one for products of floats, of up to a hundred numbers or so a factor.
SLACK, COARSE = 1e-9, 2e-5


def length(features: Column) -> Column:
    return F.sqrt(F.aggregate(features, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """The numbers of a column of equally long arrays as rows, without a Python object each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.empty((0, 0))


def item_blocks(items: DataFrame, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """(part, block, longest, n, ids, factors): items by falling length, ``block`` to a row, as packed numbers.

    Parts are ranges of lengths; without ``parts`` as many as hold ``PART`` items each.
    """
    placed = items.select(F.col("id").cast("long").alias("id"), "features", length(F.col("features")).alias("length"))
    order = (F.desc("length"), F.col("id"))
    placed = placed.repartitionByRange(parts or -(-items.count() // PART) or 1, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, None

        def packed(t: pa.Table) -> pa.RecordBatch:
            factors = _matrix(t.column("features").combine_chunks(), len(t)).astype(np.float32)
            cols = [[part], [number], [t.column("length")[0].as_py()], [len(t)], [t.column("id").to_numpy().tobytes()], [factors.tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "block", "longest", "n", "ids", "factors"])

        for b in batches:
            new = pa.Table.from_batches([b])
            held = pa.concat_tables([held, new]) if held is not None else new
            while len(held) >= block:
                yield packed(held.slice(0, block))
                held, number = held.slice(block), number + 1
        if held is not None and len(held):
            yield packed(held)

    return placed.sortWithinPartitions(*order).mapInArrow(run, "part int, block int, longest double, n int, ids binary, factors binary")


Blocks = list[tuple[float, np.ndarray, np.ndarray]]


def _unpacked(longest: float, ids: bytes, factors: bytes) -> tuple[float, np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return longest, own, np.frombuffer(factors, np.float32).reshape(len(own), -1)


def _products(users: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Row by row in double precision, equal factors to equal scores."""
    return np.einsum("ij,ij->i", users.astype(np.float64), factors.astype(np.float64))


def _hits(users: np.ndarray, least: np.ndarray, margin: np.ndarray, factors: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of all pairs that can reach ``least`` or, where there is none yet, be among the ``n`` best; a few others too.

    Products of single precision are off by ``margin`` at most.
    """
    near = users @ factors.T
    limit = least - margin
    new = np.nonzero(least == -np.inf)[0]
    if len(new) and len(factors) > n:
        limit[new] = np.partition(near[new], len(factors) - n, axis=1)[:, len(factors) - n] - 2.0 * margin[new]
    limit = np.nextafter((limit - 1e-36).astype(np.float32), np.float32(-np.inf))
    below = near < limit[:, None]
    reach = np.logical_not(below, out=below).ravel()
    if len(reach) % 8:
        return np.divmod(np.flatnonzero(reach), len(factors))
    eights = np.flatnonzero(reach.view(np.uint64))  # nearly all are zero
    at, place = np.nonzero(reach.reshape(-1, 8)[eights])
    return np.divmod(eights[at] * 8 + place, len(factors))


def _best(users: np.ndarray, floor: np.ndarray, blocks: Blocks, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of each user's best ``n`` among blocks of falling length, and how many pairs of user and block were scored.

    The product of two lengths bounds a score.  Once it is below what a user has as
    their ``n``-th best (``floor`` to begin with), no later block is looked at for them.
    Products of single precision tell which pairs of a block can reach the ``n``-th best,
    and only these are scored in double precision and merged.  Lists that are not full
    end in scores of minus infinity.
    """
    scores, ids, least, done = np.full((len(users), n), -np.inf), np.full((len(users), n), np.iinfo(np.int64).max), floor.copy(), 0
    size = np.sqrt((users.astype(np.float64) ** 2).sum(axis=1))
    coarse = COARSE * max(1.0, users.shape[1] / 100)
    for longest, own, factors in blocks:
        open_ = np.nonzero(size * longest * (1 + SLACK) >= least - np.abs(least) * SLACK)[0]
        if not len(open_):
            break
        done += len(open_)
        row, col = _hits(users[open_], least[open_], size[open_] * (longest * coarse), factors, n)
        if not len(row):
            continue
        who, first, counts = np.unique(row, return_index=True, return_counts=True)
        at = np.arange(len(row)) - np.repeat(first, counts)
        some, line = open_[who], np.repeat(np.arange(len(who)), counts)
        new, names = np.full((len(who), counts.max()), -np.inf), np.full((len(who), counts.max()), np.iinfo(np.int64).max)
        names[line, at] = own[col]
        for s in range(0, len(row), 1 << 16):
            e = s + (1 << 16)
            new[line[s:e], at[s:e]] = _products(users[open_[row[s:e]]], factors[col[s:e]])
        scores[some], ids[some] = best_of(np.concatenate((scores[some], new), axis=1), np.concatenate((ids[some], names), axis=1), n)
        least[some] = np.maximum(least[some], scores[some].min(axis=1))
    return scores, ids, done


def _with_head(users: DataFrame, head: Blocks, n: int) -> DataFrame:
    """Per user: id, features, ``floor`` (the ``n``-th best score, or null) and the best of the longest items, in order."""
    kind = "array<struct<item_id:bigint,als_score:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, TOGETHER):
                part = b.slice(s, TOGETHER)
                x = _matrix(part.column("features"), len(part)).astype(np.float32)
                scores, ids, _ = _best(x, np.full(len(x), -np.inf), head, n)
                order = np.lexsort((ids, -scores), axis=1)
                scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
                held = min(n, sum(len(own) for _, own, _ in head))
                scores, ids, full = scores[:, :held], ids[:, :held], held >= n
                pairs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(ids).ravel()), pa.array(np.ascontiguousarray(scores).ravel())], ["item_id", "als_score"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * held), pairs)
                floor = pa.array(scores[:, -1]) if full else pa.nulls(len(x), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("features"), floor, lists], ["id", "features", "floor", "best"])

    return users.mapInArrow(run, f"id long, features array<float>, floor double, best {kind}")


def _user_blocks(users: DataFrame) -> DataFrame:
    """(run, block, need, ids, factors, floors) of users by the item length that they need at least."""
    size = length(F.col("features"))
    need = F.when((size > 0) & (F.col("floor") > 0), F.col("floor") / size * (1 - SLACK)).otherwise(0.0)
    placed = users.select("id", "features", "floor", need.alias("need")).repartitionByRange("need", "id").sortWithinPartitions("need", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for b in batches:
            for s in range(0, b.num_rows, TOGETHER):
                own = b.slice(s, TOGETHER)
                floors = own.column("floor").fill_null(float("-inf")).to_numpy(zero_copy_only=False)
                factors = _matrix(own.column("features"), len(own)).astype(np.float32)
                cols = [[(part << 32) + number // RUN], [(part << 32) + number], [own.column("need")[0].as_py()], [own.column("id").to_numpy().tobytes()], [factors.tobytes()], [floors.tobytes()]]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["run", "block", "need", "ids", "factors", "floors"])
                number += 1

    return placed.mapInArrow(run, "run long, block long, need double, ids binary, factors binary, floors binary")


def _beyond_head(users: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """(user_id, item_id, als_score, scored): what the other items add to the users' lists.

    Each part of the items is held by a task and blocks of users stream past it; a user
    block comes to the parts only whose longest item can still enter a list.  Rows of
    null items say how many pairs of user and block were scored.
    """
    longest = [(r["part"], r["m"]) for r in blocks.groupBy("part").agg(F.max("longest").alias("m")).collect()]
    reach = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(float(m)).alias("m")) for p, m in longest])
    wanted = users.select("*", F.explode(F.filter(reach, lambda r: r["m"] >= F.col("need"))).alias("r")).withColumn("part", F.col("r.part")).drop("r")
    pairs = wanted.select("part", "run").distinct()
    lit = F.lit
    held = blocks.join(pairs, "part").select("part", "run", lit(0).alias("kind"), F.col("block").cast("long").alias("block"), "longest", "ids", "factors", lit(None).cast("binary").alias("floors"))
    came = wanted.select("part", "run", lit(1).alias("kind"), "block", lit(0.0).alias("longest"), "ids", "factors", "floors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items = None, []
        for b in batches:
            for i in range(b.num_rows):
                part, group, kind, size, ids, factors, floors = (b.column(c)[i].as_py() for c in ("part", "run", "kind", "longest", "ids", "factors", "floors"))
                if (part, group) != key:
                    key, items = (part, group), []
                if kind == 0:
                    items.append(_unpacked(size, ids, factors))
                    continue
                floor = np.frombuffer(floors, np.float64)
                _, who, x = _unpacked(0.0, ids, factors)
                scores, found, done = _best(x, floor, items, n)
                row, col = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
                cols = [np.append(who[row], 0), np.append(found[row, col], 0), np.append(scores[row, col], 0.0), np.append(np.zeros(len(row), np.int64), done)]
                last = np.arange(len(row) + 1) == len(row)
                arrays = [pa.array(c, mask=last) for c in cols[:3]] + [pa.array(cols[3], mask=~last)]
                yield pa.RecordBatch.from_arrays(arrays, ["user_id", "item_id", "als_score", "scored"])

    tasks = held.unionByName(came).repartition("part", "run").sortWithinPartitions("part", "run", "kind", "block")
    return tasks.mapInArrow(run, "user_id long, item_id long, als_score double, scored long")


def laid_out(item_factors: DataFrame, pool: DataFrame | None, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """The blocks of the pool's items, written: for several scorings of the same items."""
    items = item_factors.join(pool.select(F.col("item_id").alias("id")), "id", "left_semi") if pool is not None else item_factors
    return io.staged(item_blocks(items, parts, block), "items")


def _prepared(user_factors: DataFrame, blocks: DataFrame, n: int, head: int) -> tuple[DataFrame, DataFrame | None]:
    """Users with their best of the longest items, and what lies beyond these (None if nothing does)."""
    order = (F.desc("longest"), F.col("part"), F.col("block"))
    first = blocks.orderBy(*order).limit(head + 1).collect()
    longest = [_unpacked(r["longest"], r["ids"], r["factors"]) for r in first[:head]]
    users = _with_head(user_factors.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<float>").alias("features")), longest, n)
    if len(first) <= head:
        return users, None
    users, cut = io.staged(users, "users"), first[head]
    rest = blocks.filter((F.col("longest") < cut["longest"]) | ((F.col("longest") == cut["longest"]) & (F.struct("part", "block") >= F.struct(F.lit(cut["part"]), F.lit(cut["block"])))))
    return users, _beyond_head(io.staged(_user_blocks(users), "blocks"), rest, n)


def score_top_n(user_factors: DataFrame, item_factors: DataFrame, pool: DataFrame | None = None, n: int = 400, parts: int | None = None, block: int = BLOCK, head: int = HEAD, laid: DataFrame | None = None) -> DataFrame:
    """The ``n`` items of the pool with the greatest dot product for each user (both: id, features).

    Exact, with sums in double precision and ties to the smaller item.  Items lie in
    blocks by falling length.  Every user is first scored with the ``head`` longest
    blocks (at most ``head`` x ``block`` items, which are broadcast); their ``n``-th best
    score over the user's length is the least length that an item must have to
    matter.  Only parts with such items are then scored, and within them only the
    blocks before the bound is met, for blocks of users with like bounds.  No pair
    becomes a row unless it reaches the user's ``n``-th best score so far.  Whoever
    scores several groups of users gives the blocks (``laid_out``) as ``laid``.
    """
    users, rest = _prepared(user_factors, laid if laid is not None else laid_out(item_factors, pool, parts, block), n, head)
    own = users.select(F.col("id").alias("user_id"), F.posexplode("best").alias("als_rank", "b"))
    if rest is None:
        return own.select("user_id", "b.item_id", "b.als_score", "als_rank")
    order = Window.partitionBy("user_id").orderBy(F.desc("als_score"), "item_id")
    rows = own.select("user_id", "b.item_id", "b.als_score").unionByName(rest.filter("item_id is not null").select("user_id", "item_id", "als_score"))
    return rows.withColumn("als_rank", F.row_number().over(order) - 1).filter(F.col("als_rank") < n)


def pruned_share(user_factors: DataFrame, item_factors: DataFrame, n: int = 400, parts: int | None = None, block: int = BLOCK, head: int = HEAD) -> DataFrame:
    """One row: pairs of user and item block beyond the head that were ``scored``, and ``all_pairs`` of them."""
    _, rest = _prepared(user_factors, laid_out(item_factors, None, parts, block), n, head)
    every = max(0, item_blocks(item_factors, parts, block).count() - head) * user_factors.count()
    found = rest.agg(F.coalesce(F.sum("scored"), F.lit(0)).cast("long").alias("scored")) if rest is not None else item_factors.sparkSession.range(1).select(F.lit(0).cast("long").alias("scored"))
    return found.withColumn("all_pairs", F.lit(every).cast("long"))


def recommend_from_history(history: DataFrame, item_factors: DataFrame, pool: DataFrame | None, n: int = 400, reg: float = 0.1, alpha: float = 1.0, **how) -> DataFrame:
    """Fold users in, then score them."""
    users = fold_in(history, item_factors, reg, alpha).withColumnRenamed("user_id", "id")
    return score_top_n(users, item_factors, pool, n, **how)


def training_loss(interactions: DataFrame, user_factors: DataFrame, item_factors: DataFrame, reg: float = 0.1, alpha: float = 1.0) -> DataFrame:
    """(loss, observed, all_cells, penalty): the loss that the training lowers, over every user-item cell.

    ``interactions`` has user_idx, item_idx, weight, factors have id, features.  A cell
    without interaction counts (0 - x y)^2; their sum over all cells is the sum of the
    products of the two Gram matrices, so only observed cells are looked at one by
    one.  The penalty weighs a factor's square by the user's or item's interactions.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x = user_factors.select(F.col("id").alias("user_idx"), F.col("features").alias("x"))
    y = item_factors.select(F.col("id").alias("item_idx"), F.col("features").alias("y"))
    cells = interactions.select("user_idx", "item_idx", "weight").join(x, "user_idx").join(y, "item_idx")
    c, p = 1.0 + alpha * F.col("weight"), dot(F.col("x"), F.col("y"))
    sums = cells.agg(
        F.coalesce(F.sum(c * (1.0 - p) * (1.0 - p) - p * p), F.lit(0.0)).alias("observed"),
        F.coalesce(F.sum(dot(F.col("x"), F.col("x")) + dot(F.col("y"), F.col("y"))), F.lit(0.0)).alias("squares"),
    )
    a, b = gram(user_factors), gram(item_factors)
    every = float((a * b).sum()) if a is not None and b is not None else 0.0
    return sums.select((F.col("observed") + every + reg * F.col("squares")).alias("loss"), "observed", F.lit(every).alias("all_cells"), (reg * F.col("squares")).alias("penalty"))
