"""For each user the next items by co-visitation."""

from pyspark.sql import DataFrame

from ..functions import events as ev
from ..operators import candidates, covisit, interactions, pool


def run(events: DataFrame, items: DataFrame, contacts: DataFrame, cutoff_ms: int, days: int = 28, recent: int = 20, min_users: int = 3, seeds: int = 15, n: int = 400) -> DataFrame:
    """(user_id, item_id, covisit_score, covisit_rank) of every user with a history in the window."""
    log = ev.in_window(events, cutoff_ms, days)
    pairs = interactions.keep_recent(interactions.aggregate(ev.with_weight(log, contacts)), recent)
    matrix = covisit.build(log, min_users=min_users)
    allowed = pool.allowed_items(items, pairs)
    users = pairs.select("user_id").distinct()
    return candidates.covisit_top_n(candidates.covisit_scores(candidates.seed_items(pairs, users, seeds), matrix, allowed), n)
