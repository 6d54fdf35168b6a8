"""Candidate generation, merging and filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import io
from . import ids


def seed_items(interactions: DataFrame, users: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` latest items of each listed user."""
    latest = Window.partitionBy("user_id").orderBy(F.desc("last_timestamp"), "item_id")
    listed = interactions.join(users.select("user_id"), "user_id", "left_semi")
    ranked = listed.withColumn("_r", F.row_number().over(latest)).filter(F.col("_r") <= n)
    return ranked.select("user_id", F.col("item_id").alias("seed_item_id"))


def covisit_scores(seeds: DataFrame, matrix: DataFrame, pool: DataFrame) -> DataFrame:
    """Weights of the seeds' neighbours in the pool, summed by (user, neighbour).

    The pool is applied to the matrix before the join; the skew join splits hot seeds.
    """
    allowed = matrix.join(pool.select(F.col("item_id").alias("neighbor_id")), "neighbor_id", "left_semi")
    found = seeds.join(allowed, F.col("seed_item_id") == F.col("item_id"))
    return found.groupBy("user_id", F.col("neighbor_id").alias("item_id")).agg(F.sum("weight").cast("double").alias("covisit_score"))


def covisit_top_n(scores: DataFrame, n: int = 400) -> DataFrame:
    """The best ``n`` a user, ranked from 0, ties by item."""
    order = Window.partitionBy("user_id").orderBy(F.desc("covisit_score"), "item_id")
    return scores.withColumn("covisit_rank", F.row_number().over(order) - 1).filter(F.col("covisit_rank") < n)


def merge(als: DataFrame, covisit: DataFrame, missing_rank: int = 999) -> DataFrame:
    """Both sources by (user, item); flags are taken before the gaps are filled."""
    a = als.select("user_id", "item_id", "als_score", "als_rank")
    c = covisit.select("user_id", "item_id", "covisit_score", "covisit_rank")
    filled = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return a.join(c, ["user_id", "item_id"], "full").select(
        "user_id", "item_id", filled("als_score", 0.0), filled("als_rank", missing_rank), filled("covisit_score", 0.0), filled("covisit_rank", missing_rank),
        F.col("als_score").isNotNull().alias("in_als"), F.col("covisit_score").isNotNull().alias("in_covisit"),
    )


def cold_users(users: DataFrame, candidates: DataFrame) -> DataFrame:
    """Listed users without any candidate."""
    return users.select("user_id").distinct().join(candidates.select("user_id"), "user_id", "left_anti")


#: Longest popular list that is packed to one array and broadcast.
LONGEST = 10_000


def _for_each(users: DataFrame, top: DataFrame, order: list) -> DataFrame:
    """Every user with every row of a short list, which is packed to one array.

    A list of over ``LONGEST`` rows is refused when the query runs.
    """
    best = top.orderBy(*order).limit(LONGEST + 1)
    ranked = best.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)
    packed = ranked.agg(F.sort_array(F.collect_list(F.struct("pos", "item_id"))).alias("top"))
    refused = F.raise_error(F.lit(f"the popular list has over {LONGEST} rows")).cast("array<struct<pos:int,item_id:bigint>>")
    packed = packed.select(F.when(F.size("top") > LONGEST, refused).otherwise(F.col("top")).alias("top"), F.lit(0).alias("_k"))
    joined = users.select("user_id").withColumn("_k", F.lit(0)).join(F.broadcast(packed), "_k")
    return joined.select("user_id", F.explode("top").alias("t")).select("user_id", "t.item_id", "t.pos")


def add_popular_fallback(candidates: DataFrame, users: DataFrame, top: DataFrame) -> DataFrame:
    """Candidates tagged 'als', and the popular list (a few hundred rows) for each cold user."""
    cold = _for_each(cold_users(users, candidates), top, [F.desc("item_popularity"), "item_id"])
    cold = cold.select("user_id", "item_id", F.lit(0.0).alias("als_score"), F.col("pos").cast("int").alias("als_rank"), F.lit("popular_fallback").alias("source"))
    return candidates.select("user_id", "item_id", "als_score", "als_rank", F.lit("als").alias("source")).unionByName(cold)


def exclude_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates the user has not touched yet; ``seen`` are the pairs of the whole log, see ``interactions.touched``."""
    return candidates.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def _additions(have: DataFrame, places: DataFrame, taken: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """(user_id, item_id, pos): the free items of ``places`` (item_id, idx) that take users from ``have`` to ``n`` items, in order.

    ``keys`` may name a group: then ``have`` says which group a user draws from, and
    items are numbered within theirs.
    """
    wanted = taken.join(have.select("user_id", *keys), "user_id")
    gaps = wanted.join(places, ["item_id", *keys]).groupBy("user_id").agg(F.sort_array(F.collect_set("idx")).alias("gaps"))
    need = F.lit(n) - F.col("have")
    shifted = F.filter(F.transform(F.coalesce("gaps", F.array().cast("array<int>")), lambda g, i: g - i), lambda g: g < need)
    rows = have.join(gaps, "user_id", "left").select("user_id", *keys, "have", need.alias("need"), shifted.alias("before"))
    rows = rows.select("user_id", *keys, "have", "before", F.explode(F.sequence(F.lit(0), (F.col("need") - 1).cast("int"))).alias("j"))
    rows = rows.select("user_id", *keys, (F.col("have") + F.col("j")).alias("pos"), (F.col("j") + F.size(F.filter("before", lambda g: g <= F.col("j")))).cast("int").alias("idx"))
    return rows.join(places, ["idx", *keys]).select("user_id", "item_id", "pos")


def fill_up(candidates: DataFrame, popular: DataFrame, seen: DataFrame, n: int, users: DataFrame | None = None, favourites: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, pos, filled): users below ``n`` candidates get the most popular items that they have not seen.

    ``candidates`` needs ``rank``, ``popular`` (item_id, item_popularity) may be of any
    length.  Without ``users`` those without candidates are not added; with them every
    listed user gets a list, and no other.  With ``favourites`` (user_id, group) and
    ``groups`` (item_id, group), say of verticals or regions, a user's favourite group
    is drawn from first, then all items.  Popular items are numbered once; a user's
    own and seen items are gaps in these numbers, from which those of the items to add
    follow: the j-th free number is j plus the gaps before it.  So nobody's history is
    cut and no list is laid out for each user.
    """
    order = Window.partitionBy("user_id").orderBy("rank", "item_id")
    if users is not None:
        users = users.select("user_id").distinct()
        candidates = candidates.join(users, "user_id", "left_semi")
    out = io.staged(candidates.select("user_id", "item_id", (F.row_number().over(order) - 1).cast("int").alias("pos"), F.lit(False).alias("filled")).filter(F.col("pos") < n), "own")
    everyone = users if users is not None else out.select("user_id").distinct()
    popular = popular.select("item_id", "item_popularity")
    best = (F.desc("item_popularity"), F.col("item_id"))
    rounds: list[tuple[DataFrame, list[str]]] = []
    if favourites is not None and groups is not None:
        places = ids.numbered(popular.join(groups.select("item_id", F.col("group").alias("grp")).filter("grp is not null"), "item_id"), F.col("grp"), *best)
        first = io.staged(places.groupBy("grp").agg(F.min("idx").alias("first")), "groups")
        rounds.append((places.join(first, "grp").select("item_id", "grp", (F.col("idx") - F.col("first")).alias("idx")), ["grp"]))
    rounds.append((ids.numbered(popular, *best).select("item_id", "idx"), []))
    for places, keys in rounds:
        have = everyone.join(out.groupBy("user_id").agg(F.count("*").alias("have")), "user_id", "left").select("user_id", F.coalesce("have", F.lit(0)).alias("have")).filter(F.col("have") < n)
        if keys:
            have = have.join(favourites.select("user_id", F.col("group").alias("grp")), "user_id")
        taken = out.select("user_id", "item_id").unionByName(seen.select("user_id", "item_id"))
        more = _additions(have, places, taken, n, keys).select("user_id", "item_id", F.col("pos").cast("int").alias("pos"), F.lit(True).alias("filled"))
        out = io.staged(out.unionByName(io.staged(more, "more")), "filled")
    return out
