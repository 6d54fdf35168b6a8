"""A listwise ranker: boosted trees on pairwise gradients within each user's list (LambdaMART).

The lists stay where Spark keeps them, one row a user.  In each pass the tasks turn
the scores of their lists into gradients and add these up by tree node, feature and
bin; Spark adds up the tasks' sums, and the driver gets at most nodes x features x
bins of them to choose the splits of one level.  Gradients are summed as integers, so
trees do not depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import io
from . import target_stats

#: Gradients are summed in steps of 1 / FIXED.
FIXED = float(1 << 24)


@dataclass
class Tree:
    """Nodes by number: a leaf has feature -1; rows go left if their bin is at most ``bin``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])

    def add(self, value: float, rows: int) -> int:
        for column, v in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, value), (self.rows, rows)):
            column.append(v)
        return len(self.feature) - 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.bin, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        while True:
            inner = np.nonzero(feature[at] >= 0)[0]
            if not len(inner):
                return at
            n = at[inner]
            at[inner] = np.where(bins[inner, feature[n]] <= cut[n], left[n], right[n])

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


@dataclass
class Ranker:
    """Trees over ``numbers`` and the target statistics of ``categories``.

    Bin 0 of a feature is for missing numbers, bin b for those above b - 1 of its ``borders``.
    """

    numbers: list[str]
    categories: list[str]
    borders: list[np.ndarray]
    prior: float
    stats: DataFrame
    trees: list[Tree]
    #: NDCG of the validation lists after no, one, two, ... trees; empty without validation.
    staged: list[float] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return [*self.numbers, *(f"ts_{c}" for c in self.categories)]


def binned(x: np.ndarray, borders: Sequence[np.ndarray]) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8)
    for f, b in enumerate(borders):
        known = ~np.isnan(x[:, f])
        out[known, f] = 1 + np.searchsorted(b, x[known, f], side="left")
    return out


def discounts(score: np.ndarray, k: int) -> np.ndarray:
    """What each place of the list is worth, given the scores; nothing below the first ``k``; ties keep their order."""
    rank = np.empty(len(score), np.int64)
    rank[np.argsort(-score, kind="stable")] = np.arange(len(score))
    return np.where(rank < k, 1.0 / np.log2(rank + 2.0), 0.0)


def ideal(positives: int, k: int) -> float:
    return float((1.0 / np.log2(np.arange(min(positives, k)) + 2.0)).sum())


def gradients(score: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of a list's rows, in steps of 1 / ``FIXED``.

    Each pair of a positive and a negative pushes them apart by the change of
    NDCG@``k`` that swapping them would make.
    """
    up, down = np.nonzero(label)[0], np.nonzero(label == 0)[0]
    g, h = np.zeros(len(label)), np.zeros(len(label))
    if len(up) and len(down):
        worth = discounts(score, k)
        swap = np.abs(worth[up][:, None] - worth[down][None, :]) / ideal(len(up), k)
        rho = 1.0 / (1.0 + np.exp(np.clip(score[up][:, None] - score[down][None, :], -500, 500)))
        push, bend = swap * rho, swap * rho * (1.0 - rho)
        g[up], g[down] = push.sum(axis=1), -push.sum(axis=0)
        h[up], h[down] = bend.sum(axis=1), bend.sum(axis=0)
    return np.rint(g * FIXED).astype(np.int64), np.rint(h * FIXED).astype(np.int64)


def _arrays(batch: pa.RecordBatch, i: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(batch.column("bins")[i].as_py(), np.uint8).reshape(-1, width)
    return bins, np.frombuffer(batch.column("label")[i].as_py(), np.uint8), np.frombuffer(batch.column("score")[i].as_py(), np.float64)


def packed(rows: DataFrame, features: Sequence[str], borders: Sequence[np.ndarray]) -> DataFrame:
    """One row a user: bins (rows x features), labels and scores of 0, by item; a list is as long as its candidates."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    lists = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("item_id", F.col("target").cast("int").alias("y"), x.alias("x")))).alias("l"))
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("l")
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            flat = column.flatten()
            values = flat.field("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            bins, label = binned(values, borders), flat.field("y").to_numpy(zero_copy_only=False).astype(np.uint8)
            ends = np.cumsum(lengths)
            cuts = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
            cols = [[bins[s:e].tobytes() for s, e in cuts], [label[s:e].tobytes() for s, e in cuts], [np.zeros(e - s).tobytes() for s, e in cuts]]
            yield pa.RecordBatch.from_arrays([b.column("user_id"), *(pa.array(c, pa.binary()) for c in cols)], ["user_id", "bins", "label", "score"])

    return lists.mapInArrow(run, "user_id long, bins binary, label binary, score binary")


def advanced(lists: DataFrame, trees: Sequence[Tree], width: int) -> DataFrame:
    """The lists with the trees' values added to their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = []
            for i in range(b.num_rows):
                bins, _, score = _arrays(b, i, width)
                scores.append((score + sum(t.predict(bins) for t in trees)).tobytes())
            yield b.set_column(b.schema.get_field_index("score"), "score", pa.array(scores, pa.binary()))

    return lists.mapInArrow(run, lists.schema)


def sums(lists: DataFrame, trees: Sequence[Tree], growing: Tree, width: int, bins: int, k: int) -> DataFrame:
    """(node, cell, g, h, n): sums over the rows in each leaf of ``growing``, by cell = feature x ``bins`` + bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = len(growing.feature) * width * bins
        total = np.zeros((3, cells), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                own, label, score = _arrays(b, i, width)
                g, h = gradients(score + sum(t.predict(own) for t in trees), label, k)
                at = ((growing.leaf_of(own)[:, None] * width + np.arange(width)) * bins + own).ravel()
                for row, v in zip(total, (g, h, np.ones(len(g), np.int64)), strict=True):
                    np.add.at(row, at, np.repeat(v, width))
        used = np.nonzero(total[2])[0]
        node, cell = np.divmod(used, width * bins)
        yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int32)), pa.array(cell.astype(np.int32)), *(pa.array(row[used]) for row in total)], ["node", "cell", "g", "h", "n"])

    part = lists.mapInArrow(run, "node int, cell int, g long, h long, n long")
    return part.groupBy("node", "cell").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])


def best_split(total: np.ndarray, l2: float, least_rows: int) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of a node's sums (3 x features x bins), or None; ties go to the first feature and bin."""
    g, h, n = (np.cumsum(a, axis=1) for a in total)
    worth = lambda a, b: (a / FIXED) ** 2 / (b / FIXED + l2)
    all_g, all_h, all_n = g[:, -1:], h[:, -1:], n[:, -1:]
    gain = worth(g, h) + worth(all_g - g, all_h - h) - worth(all_g, all_h)
    gain = np.where((n >= least_rows) & (all_n - n >= least_rows), gain, -np.inf)
    at = int(np.argmax(gain))
    f, b = divmod(at, gain.shape[1])
    return (float(gain[f, b]), f, b) if gain[f, b] > 1e-9 else None


def split(tree: Tree, frontier: Sequence[int], found: pd.DataFrame, width: int, bins: int, rate: float, l2: float, least_rows: int) -> list[int]:
    """Split the frontier's nodes by their sums; returns the new leaves."""
    new = []
    for node in frontier:
        own = found[found["node"] == node]
        total = np.zeros((3, width * bins), np.int64)
        total[:, own["cell"].to_numpy()] = own[["g", "h", "n"]].to_numpy().T
        total = total.reshape(3, width, bins)
        if node == 0:
            tree.rows[0] = int(total[2, 0].sum())
        best = best_split(total, l2, least_rows)
        if best is None:
            continue
        _, f, b = best
        sides = []
        for part in (total[:, f, : b + 1], total[:, f, b + 1 :]):
            g, h, n = part.sum(axis=1).tolist()
            sides.append(tree.add(rate * (g / FIXED) / (h / FIXED + l2), n))
        tree.feature[node], tree.bin[node], (tree.left[node], tree.right[node]) = f, b, sides
        new += sides
    return new


def staged_ndcg(lists: DataFrame, trees: Sequence[Tree], width: int, k: int) -> list[float]:
    """Mean NDCG@``k`` over the lists with a positive, after no, one, two, ... trees, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(trees) + 2, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                bins, label, score = _arrays(b, i, width)
                if not label.any():
                    continue
                best, now = ideal(int(label.sum()), k), score.copy()
                total[-1] += 1
                for r in range(len(trees) + 1):
                    total[r] += round(float(discounts(now, k)[label > 0].sum()) / best * (1 << 30))
                    if r < len(trees):
                        now = now + trees[r].predict(bins)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["r", "v"])

    rows = lists.mapInArrow(run, "r int, v long").groupBy("r").agg(F.sum("v").alias("v")).orderBy("r").collect()
    counts = [r["v"] for r in rows] or [0] * (len(trees) + 2)
    return [v / (1 << 30) / max(counts[-1], 1) for v in counts[:-1]]


def borders_of(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Up to ``bins`` - 2 borders a feature, at even quantiles of its known values."""
    at = [i / (bins - 1) for i in range(1, bins - 1)]
    found = rows.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), at, 100_000).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(q or [], np.float64)) for q in found]


def fit(
    train: DataFrame,
    validation: DataFrame | None = None,
    numbers: Sequence[str] = (),
    categories: Sequence[str] = (),
    rounds: int = 500,
    depth: int = 6,
    rate: float = 0.05,
    l2: float = 3.0,
    bins: int = 128,
    k: int = 160,
    least_rows: int = 1,
    every: int = 10,
    seed: int = 42,
) -> Ranker:
    """Fit on distinct (user_id, item_id) pairs with ``target``, ``numbers`` and ``categories``.

    Trees of ``depth`` levels take ``depth`` passes each.  Only users with a positive
    have gradients, so lists without one are left out.  Every ``every`` rounds the
    scores are written to the shared folder, so a pass adds up fewer trees than that.
    With ``validation`` its NDCG@``k`` after each round is taken in one pass at the end
    and the trees up to the best round (the first of equals) are kept.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins are bytes")
    numbers, categories, spark = list(numbers), list(categories), train.sparkSession
    prior = float(train.agg(F.avg(F.col("target").cast("int"))).first()[0] or 0.0)
    stats = io.staged(target_stats.whole(train, categories, prior), "stats") if categories else spark.createDataFrame([], "name string, v string, value double")
    model = Ranker(numbers, categories, [], prior, stats, [])
    rows = train.select("user_id", "item_id", "target", *numbers)
    if categories:
        rows = rows.join(target_stats.ordered(train, categories, prior, seed=seed), ["user_id", "item_id"])
    rows = io.staged(rows, "train")
    model.borders = borders_of(rows, model.features, bins)
    with_positive = rows.filter("target").select("user_id").distinct()
    width, path = len(model.features), io.shared_path(spark, "lists")
    io.write_stage(packed(rows.join(with_positive, "user_id", "left_semi"), model.features, model.borders), path)
    since = 0
    for r in range(rounds):
        if r and r % every == 0:
            before, path = path, io.shared_path(spark, "lists")
            io.write_stage(advanced(spark.read.parquet(before), model.trees[since:], width), path)
            io.remove(spark, before)
            since = r
        lists, tree, frontier = spark.read.parquet(path), Tree(), [0]
        for _ in range(depth):
            found = sums(lists, model.trees[since:], tree, width, bins, k)
            frontier = split(tree, frontier, found.filter(F.col("node").isin(frontier)).toPandas(), width, bins, rate, l2, least_rows)
            if not frontier:
                break
        if len(tree.feature) == 1:
            break  # no split lowers the loss any more
        model.trees.append(tree)
    io.remove(spark, path)
    if validation is not None:
        held = io.staged(packed(prepared(model, validation).withColumn("target", F.col("target")), model.features, model.borders), "held")
        model.staged = staged_ndcg(held, model.trees, width, k)
        model.trees = model.trees[: int(np.argmax(model.staged))]
    return model


def prepared(model: Ranker, df: DataFrame) -> DataFrame:
    """The rows with the features of the model."""
    target = ["target"] if "target" in df.columns else []
    rows = df.select("user_id", "item_id", *target, *model.numbers, *model.categories)
    return target_stats.with_whole(rows, model.stats, model.categories, model.prior)


def score(model: Ranker, df: DataFrame) -> DataFrame:
    """(user_id, item_id[, target], rank_score); rows are scored as they come."""
    target = [F.col("target").cast("int").alias("target")] if "target" in df.columns else []
    x = F.array(*[F.col(c).cast("double") for c in model.features]).alias("x")
    rows = prepared(model, df).select("user_id", "item_id", *target, x)
    keep, width, borders, trees = rows.columns[:-1], len(model.features), model.borders, model.trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            bins, total = binned(values, borders), np.zeros(b.num_rows)
            for t in trees:
                total += t.predict(bins)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(total)], [*keep, "rank_score"])

    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kinds}, rank_score double")


def trees_table(model: Ranker, spark: SparkSession) -> DataFrame:
    """One row a node: tree, node, feature (null in a leaf), bin, left, right, value, rows."""
    rows = [
        (i, n, model.features[f] if f >= 0 else None, b, left, right, v, c)
        for i, t in enumerate(model.trees)
        for n, (f, b, left, right, v, c) in enumerate(zip(t.feature, t.bin, t.left, t.right, t.value, t.rows, strict=True))
    ]
    return spark.createDataFrame(rows, "tree int, node int, feature string, bin int, left int, right int, value double, rows long")


def importances(trees: DataFrame) -> DataFrame:
    """(feature, importance): how much the prediction changes, in percent, greatest first.

    ``trees`` is a table of nodes.  A split counts the squared distances of its sides'
    mean values from the mean of both, weighted by the rows of each side.  Means are
    taken from the leaves up, one level of all trees at a time.
    """
    mean = trees.filter("feature is null").select("tree", "node", "value", "rows")
    inner = trees.filter("feature is not null").select("tree", "node", "feature", "left", "right")
    changes = []
    while True:
        sides = inner
        for side in ("left", "right"):
            sides = sides.join(mean.select("tree", F.col("node").alias(side), F.col("value").alias(f"v_{side}"), F.col("rows").alias(f"n_{side}")), ["tree", side])
        n = F.col("n_left") + F.col("n_right")
        v = F.when(n > 0, (F.col("v_left") * F.col("n_left") + F.col("v_right") * F.col("n_right")) / n).otherwise(0.0)
        sides = sides.withColumns({"rows": n, "value": v})
        change = F.col("n_left") * (F.col("v_left") - F.col("value")) ** 2 + F.col("n_right") * (F.col("v_right") - F.col("value")) ** 2
        done = io.staged(sides.select("tree", "node", "feature", "value", "rows", change.alias("change")), "level")
        if done.isEmpty():
            break
        changes.append(done)
        mean = mean.unionByName(done.select("tree", "node", "value", "rows"))
        inner = inner.join(done.select("tree", "node"), ["tree", "node"], "left_anti")
    if not changes:
        return trees.sparkSession.createDataFrame([], "feature string, importance double")
    rows = changes[0]
    for more in changes[1:]:
        rows = rows.unionByName(more)
    per = rows.groupBy("feature").agg(F.sum("change").alias("c"))
    total = per.agg(F.sum("c").alias("total")).withColumn("_k", F.lit(0))
    per = per.withColumn("_k", F.lit(0)).join(F.broadcast(total), "_k")  # one row
    return per.select("feature", F.when(F.col("total") > 0, 100.0 * F.col("c") / F.col("total")).otherwise(0.0).alias("importance")).orderBy(F.desc("importance"), "feature")


def save(model: Ranker, spark: SparkSession, path: str) -> None:
    """Write the model to Parquet: trees, borders, target statistics and names."""
    io.write_stage(trees_table(model, spark), f"{path}/trees")
    io.write_stage(model.stats, f"{path}/stats")
    rows = [(i, n, n.removeprefix("ts_") if i >= len(model.numbers) else None, b.tolist(), model.prior) for i, (n, b) in enumerate(zip(model.features, model.borders, strict=True))]
    io.write_stage(spark.createDataFrame(rows, "place int, feature string, category string, borders array<double>, prior double"), f"{path}/features")


def load(spark: SparkSession, path: str) -> Ranker:
    """The model that ``save`` wrote."""
    rows = spark.read.parquet(f"{path}/features").orderBy("place").collect()
    places = {r["feature"]: r["place"] for r in rows}
    trees: dict[int, Tree] = {}
    for r in spark.read.parquet(f"{path}/trees").orderBy("tree", "node").collect():
        t = trees.setdefault(r["tree"], Tree([], [], [], [], [], []))
        f = places[r["feature"]] if r["feature"] is not None else -1
        for column, v in zip((t.feature, t.bin, t.left, t.right, t.value, t.rows), (f, r["bin"], r["left"], r["right"], r["value"], r["rows"]), strict=True):
            column.append(v)
    numbers = [r["feature"] for r in rows if r["category"] is None]
    categories = [r["category"] for r in rows if r["category"] is not None]
    return Ranker(numbers, categories, [np.array(r["borders"]) for r in rows], rows[0]["prior"], spark.read.parquet(f"{path}/stats"), [trees[i] for i in sorted(trees)])
