"""Hold-out targets and recall."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.events import DAY_MS, is_contact


def holdout_targets(events: DataFrame, contact_eids: DataFrame, threshold_ms: int, days: int = 7) -> DataFrame:
    """Contacts in the ``days`` from the threshold on items new to the user."""
    t = F.col("timestamp")
    later = is_contact(events.filter((t >= threshold_ms) & (t < threshold_ms + days * DAY_MS)), contact_eids)
    pairs = later.filter("is_contact").select("user_id", "item_id").distinct()
    before = events.filter(t < threshold_ms).select("user_id", "item_id")
    return pairs.join(before, ["user_id", "item_id"], "left_anti")


def _mean_recall(hits: DataFrame, targets: DataFrame, users: DataFrame) -> DataFrame:
    """``recall``: mean over users with targets of hits over all their targets."""
    total = targets.join(users, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))
    found = hits.groupBy("user_id").agg(F.count("*").alias("h"))
    return total.join(found, "user_id", "left").agg(F.avg(F.coalesce("h", F.lit(0)) / F.col("n")).alias("recall"), F.count("*").alias("n_users"))


def recall_at_k(preds: DataFrame, score_col: str, targets: DataFrame, k: int = 160, users: DataFrame | None = None) -> DataFrame:
    """Recall of each user's ``k`` best pairs; users default to those with predictions."""
    one = preds.groupBy("user_id", "item_id").agg(F.max(score_col).alias("s"))
    wanted = targets.select("user_id", "item_id").distinct()
    order = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("s"), "item_id")
    top = one.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    who = (users if users is not None else preds).select("user_id").distinct()
    return _mean_recall(top.join(wanted, ["user_id", "item_id"]), wanted, who)


def user_recall(preds: DataFrame, score_cols: list[str], targets: DataFrame, k: int = 160) -> DataFrame:
    """(user_id, r_...): for each score column the share of a user's targets among their ``k`` best pairs; users with predictions and targets."""
    one = preds.groupBy("user_id", "item_id").agg(*[F.max(c).alias(c) for c in score_cols])
    wanted = targets.select("user_id", "item_id").distinct().withColumn("_t", F.lit(1))
    places = {f"_p_{c}": F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last(c), "item_id")) for c in score_cols}
    marked = one.withColumns(places).join(wanted, ["user_id", "item_id"], "left")
    hits = marked.groupBy("user_id").agg(*[F.count_if((F.col(f"_p_{c}") <= k) & F.col("_t").isNotNull()).alias(f"_h_{c}") for c in score_cols])
    total = wanted.groupBy("user_id").agg(F.count("*").alias("_n"))
    return hits.join(total, "user_id").select("user_id", *[(F.col(f"_h_{c}") / F.col("_n")).alias(f"r_{c}") for c in score_cols])


#: How often a user may be drawn in a replicate; more has a probability of 6e-11.
MOST_DRAWN = 12


def drawn(seed: int = 42) -> Column:
    """How often ``user_id`` is drawn in replicate ``r``: a Poisson(1) number from a hash of both, the same in every run."""
    limits, total, term = [], 0.0, math.exp(-1)
    for n in range(MOST_DRAWN):
        total, term = total + term, term / (n + 1)
        limits.append(int(total * 2**32))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("user_id").cast("string"), F.col("r").cast("string"))
    u = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return sum(((u >= limit).cast("int") for limit in limits), F.lit(0))


def bootstrap(preds: DataFrame, score_cols: list[str], targets: DataFrame, k: int = 160, replicates: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(score, gain, low, high, better): gains in recall over the first column with paired bootstrap intervals.

    Users are drawn with replacement by hashed Poisson weights, the same for all
    columns, in one pass: each task sums all replicates of its users, and one row a
    replicate is left.  ``low`` and ``high`` are order statistics of the replicates'
    gains, ``better`` is the share of replicates with a gain above zero.
    """
    per = user_recall(preds, score_cols, targets, k)
    rows = per.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn("w", F.when(F.col("r") == 0, 1).otherwise(drawn(seed)))
    sums = rows.groupBy("r").agg(F.sum("w").alias("n"), *[F.sum(F.col("w") * F.col(f"r_{c}")).alias(c) for c in score_cols]).filter("n > 0")
    gains = sums.select("r", F.explode(F.array(*[F.struct(F.lit(c).alias("score"), ((F.col(c) - F.col(score_cols[0])) / F.col("n")).alias("gain")) for c in score_cols[1:]])).alias("x"))
    gains = gains.select("r", "x.score", "x.gain").groupBy("score").agg(F.max(F.when(F.col("r") == 0, F.col("gain"))).alias("gain"), F.sort_array(F.collect_list(F.when(F.col("r") > 0, F.col("gain")))).alias("g"))
    size = F.size("g")
    skip = F.floor(F.lit((1 - level) / 2) * size).cast("int")
    return gains.select("score", "gain", F.get("g", skip).alias("low"), F.get("g", size - 1 - skip).alias("high"), (F.size(F.filter("g", lambda v: v > 0)) / size).alias("better"))


def compare(preds: DataFrame, score_cols: list[str], targets: DataFrame, k: int = 160) -> DataFrame:
    """Recall of several score columns, and their gain over the first one."""
    each = [recall_at_k(preds, c, targets, k).select(F.lit(c).alias("score"), F.lit(i).alias("i"), "recall") for i, c in enumerate(score_cols)]
    rows = reduce(DataFrame.unionByName, each)
    base = F.broadcast(rows.filter("i = 0").select(F.lit(1).alias("_k"), F.col("recall").alias("base")))  # one row
    gain = F.col("recall") - F.col("base")
    return rows.withColumn("_k", F.lit(1)).join(base, "_k").select("score", "recall", gain.alias("gain"), F.when(F.col("base") > 0, gain / F.col("base")).alias("relative_gain"))


def popular_baseline(top: DataFrame, targets: DataFrame, users: DataFrame) -> DataFrame:
    """Recall of one shared list for all the given users."""
    wanted = targets.select("user_id", "item_id").distinct()
    return _mean_recall(wanted.join(top.select("item_id"), "item_id", "left_semi"), wanted, users.select("user_id").distinct())


def retrieval_recall(pool: DataFrame, targets: DataFrame, flags: tuple[str, ...] = ("in_als", "in_covisit")) -> DataFrame:
    """Share of all target pairs that the candidates hold, and hits per source."""
    wanted = targets.select("user_id", "item_id").distinct()
    marks = pool.groupBy("user_id", "item_id").agg(F.lit(1).alias("hit"), *(F.max(F.col(c).cast("int")).alias(c) for c in flags))
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(f"hits_{c.removeprefix('in_')}") for c in flags]
    return wanted.join(marks, ["user_id", "item_id"], "left").agg(F.count("*").alias("n_targets"), F.count("hit").alias("n_hits"), *sums, F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
