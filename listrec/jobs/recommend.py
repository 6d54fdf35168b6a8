"""The whole chain: retrieval by two sources, features, ranker, submission lists, recall.

Training ends where the target week begins, so no later event reaches the lists.
``train`` makes what inference needs, ``save`` and ``load`` keep it in files, and
``lists`` makes lists for listed users with a history of their own: these are folded
in, and who has too few candidates gets popular items.  ``run`` does both.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import events as ev
from ..operators import als, als_blocks, boosting, candidates, covisit, evaluate, features, interactions, pool, popularity, ranking
from ..sources import io


def item_factors(pairs: DataFrame, rank: int = 32, iterations: int = 15) -> DataFrame:
    """(id, features) of the items of ALS trained on the pairs, which should lie in files; written."""
    return als_blocks.train(pairs, rank=rank, iterations=iterations, users=False).itemFactors


def als_candidates(pairs: DataFrame, allowed: DataFrame, rank: int = 32, iterations: int = 15, n: int = 400) -> DataFrame:
    """Train ALS on the pairs and score every user by folding in their history."""
    pairs = io.staged(pairs, "pairs")
    return als.recommend_from_history(pairs, item_factors(pairs, rank, iterations), allowed, n)


def history_of(events: DataFrame, contacts: DataFrame, cutoff_ms: int, days: int, recent: int) -> DataFrame:
    """The latest items of each user in the window."""
    return interactions.keep_recent(interactions.aggregate(ev.with_weight(ev.in_window(events, cutoff_ms, days), contacts)), recent)


def covisit_lists(history: DataFrame, matrix: DataFrame, allowed: DataFrame, n: int = 400, seeds: int = 15) -> DataFrame:
    """The best ``n`` neighbours of each user's seeds."""
    users = history.select("user_id").distinct()
    return candidates.covisit_top_n(candidates.covisit_scores(candidates.seed_items(history, users, seeds), matrix, allowed), n)


def complete(ranked: DataFrame, users: DataFrame, seen: DataFrame, pairs: DataFrame, allowed: DataFrame, k: int, favourites: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, pos, filled): exactly ``k`` unseen items for every listed user, as far as the pool goes.

    ``ranked`` needs ``rank``; ``seen`` holds all that the users ever touched.  With
    ``favourites`` and ``groups`` a user's favourite group is drawn from first.
    """
    popular = pool.restrict_to(popularity.item_popularity(pairs), allowed, "item_id")
    return candidates.fill_up(ranked, popular, seen, k, users, favourites, groups)


#: The tables of a trained model, all by original ids.
TABLES = ("pairs", "pool", "matrix", "factors")


@dataclass
class Trained:
    """What inference needs: capped interactions, pool, co-visitation, item factors and the ranker."""

    pairs: DataFrame
    pool: DataFrame
    matrix: DataFrame
    factors: DataFrame
    ranker: boosting.Ranker
    threshold_ms: int
    days: int
    recent: int
    n: int


def save(model: Trained, spark: SparkSession, path: str) -> None:
    """Write the model's tables, ranker and settings under ``path``."""
    for name in TABLES:
        io.write_stage(getattr(model, name), f"{path}/{name}")
    boosting.save(model.ranker, spark, f"{path}/ranker")
    settings = [(model.threshold_ms, model.days, model.recent, model.n)]
    io.write_stage(spark.createDataFrame(settings, "threshold_ms long, days int, recent int, n int"), f"{path}/settings")


def load(spark: SparkSession, path: str) -> Trained:
    """The model that ``save`` wrote."""
    own = spark.read.parquet(f"{path}/settings").first().asDict()
    return Trained(*(spark.read.parquet(f"{path}/{name}") for name in TABLES), boosting.load(spark, f"{path}/ranker"), **own)


def feature_table(model: Trained, items: DataFrame, popular: DataFrame, laid: DataFrame, history: DataFrame, seen: DataFrame, targets: DataFrame | None) -> DataFrame:
    """Features of the unseen candidates of both sources for the users with a history.

    ``popular`` is the popularity of the model's pairs, ``laid`` its factors in blocks.
    """
    found = als.recommend_from_history(history, model.factors, model.pool, model.n, laid=laid)
    merged = candidates.merge(found, covisit_lists(history, model.matrix, model.pool, model.n))
    fresh = candidates.exclude_seen(merged, seen)
    rows = features.build_merged(fresh, items, popular, features.user_top_vertical(history, items), targets)
    return features.with_profile(rows, features.user_profile(history, items), items)


def _about_items(model: Trained) -> tuple[DataFrame, DataFrame]:
    """What ``feature_table`` wants to know of the items, written."""
    return io.staged(popularity.item_popularity(model.pairs), "popular"), als.laid_out(model.factors, model.pool)


def train(
    spark: SparkSession,
    events: DataFrame,
    items: DataFrame,
    contacts: DataFrame,
    threshold_ms: int,
    days: int = 28,
    recent: int = 100,
    min_users: int = 3,
    n: int = 400,
    k: int = 160,
    rank: int = 32,
    iterations: int = 15,
    rounds: int = 500,
    depth: int = 6,
) -> tuple[Trained, DataFrame]:
    """(model, recall of the validation users).

    Candidates are only made for users with a target in the week after the threshold:
    no other list has a gradient or a recall.
    """
    pairs = io.staged(history_of(events, contacts, threshold_ms, days, recent), "pairs")
    model = Trained(
        pairs, io.staged(pool.allowed_items(items, pairs), "pool"), io.staged(covisit.build(ev.in_window(events, threshold_ms, days), min_users=min_users), "matrix"),
        item_factors(pairs, rank, iterations), None, threshold_ms, days, recent, n,
    )
    targets = io.staged(evaluate.holdout_targets(events, contacts, threshold_ms), "targets")
    who = targets.select("user_id").distinct()
    seen = interactions.touched(events.join(who, "user_id", "left_semi"), threshold_ms)
    with io.passing(spark):
        known = io.staged(feature_table(model, items, *_about_items(model), io.staged(pairs.join(who, "user_id", "left_semi"), "own"), seen, targets), "features")
    fitted, val = ranking.split_by_user(known)
    model.ranker = ranking.fit(fitted, val, rounds=rounds, depth=depth, k=k)
    return model, evaluate.recall_at_k(ranking.score(model.ranker, val), "rank_score", targets, k)


#: Candidates, of both sources before they are merged, that are ranked at a time.
AT_ONCE = 8_000_000


def ranked_lists(model: Trained, items: DataFrame, history: DataFrame, seen: DataFrame, k: int, at_once: int = AT_ONCE) -> DataFrame:
    """(user_id, item_id, vertical_id, rank_score, pos): at most ``k`` unseen items a user with a history; written.

    A user's candidates are many times their list, so users are ranked in slices by a
    hash of the id, and only the lists of a slice are kept: the disk does not
    grow with candidates.  ``history`` and ``seen`` are read once a slice and should
    lie in files.
    """
    spark = history.sparkSession
    slices = max(1, -(-history.select("user_id").distinct().count() * 2 * model.n // at_once))
    popular, laid = _about_items(model)
    found: list[DataFrame] = []
    for i in range(slices):
        inside = F.pmod(F.xxhash64("user_id"), F.lit(slices)) == i
        with io.passing(spark):
            rows = io.staged(feature_table(model, items, popular, laid, io.staged(history.filter(inside), "slice"), seen.filter(inside), None), "features")
            found.append(io.staged(ranking.balance_by_vertical(ranking.score(model.ranker, rows), items, k), "ranked"))
    return reduce(DataFrame.unionByName, found)


def lists(model: Trained, items: DataFrame, contacts: DataFrame, users: DataFrame, user_events: DataFrame, k: int = 160) -> DataFrame:
    """(user_id, item_id, pos, filled): exactly ``k`` items for each listed user, cold ones included, as far as the pool goes.

    Listed users that repeat count once.  Candidates come from their latest items in
    the window; whatever they ever touched before the threshold is left out.  Lists
    too short are filled from the user's favourite vertical, then from all.
    """
    listed = io.staged(user_events.join(users.select("user_id").distinct(), "user_id", "left_semi"), "listed")
    history = io.staged(history_of(listed, contacts, model.threshold_ms, model.days, model.recent), "own")
    seen = io.staged(interactions.touched(listed, model.threshold_ms), "seen")
    ranked = ranked_lists(model, items, history, seen, k)
    favourites = features.user_top_vertical(history, items).select("user_id", F.col("top_vertical").alias("group"))
    groups = items.select("item_id", F.col("vertical_id").alias("group"))
    return complete(ranked.withColumn("rank", F.col("pos")), users, seen, model.pairs, model.pool, k, favourites, groups)


def run(spark: SparkSession, events: DataFrame, items: DataFrame, contacts: DataFrame, threshold_ms: int, users: DataFrame | None = None, user_events: DataFrame | None = None, k: int = 160, **how) -> tuple[DataFrame, DataFrame]:
    """(lists, recall): train, then lists of the listed users, or without ``users`` those of all users of the log.

    The histories of listed users are read from ``user_events``, or from ``events``;
    ``how`` are the settings of ``train``.
    """
    model, recall = train(spark, events, items, contacts, threshold_ms, k=k, **how)
    if users is None:
        return ranked_lists(model, items, model.pairs, interactions.touched(events, threshold_ms), k), recall
    return lists(model, items, contacts, users, events if user_events is None else user_events, k), recall
