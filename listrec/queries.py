"""Registered queries on the given tables, each with the SQL that must agree with it."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import events as ev
from .jobs import next_items, recommend
from .operators import als, boosting, candidates, covisit, evaluate, features, ids, interactions, pool, popularity, ranking, semantic, stats, target_stats
from .sources import adapters as ad
from .sources import io

RECENT, TOP, SEEDS, MIN_USERS, K = 20, 40, 15, 3, 10
ROUNDS, DEPTH = 10, 4
FIRST_MS = ad.CUTOFF_MS - 28 * ad.DAY_MS


class Tables:
    """The chain of intermediate tables over one folder, by mapping A; all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str, cutoff_ms: int = ad.CUTOFF_MS) -> None:
        self.spark, self.dir = spark, sf_dir
        self.events = ad.click_log(spark, sf_dir)
        self.contacts = ad.contacts(spark)
        self.items = ad.items(spark, sf_dir)
        self.log = ev.in_window(self.events, cutoff_ms)
        self.weighted = ev.with_weight(self.log, self.contacts)
        self.aggregated = interactions.aggregate(self.weighted)
        self.pairs = interactions.keep_recent(self.aggregated, RECENT)
        self.pool = pool.allowed_items(self.items, self.pairs)
        self.popularity = popularity.item_popularity(self.pairs)
        self.top = popularity.top_by_weight(self.pairs, self.pool, TOP)

    def read_events(self) -> DataFrame:
        """The log written in the model's schema and read by the library's reader."""
        path = io.shared_path(self.spark, "events")
        io.write_stage(self.events, path)
        return io.read_events(self.spark, path)

    def read_items(self) -> DataFrame:
        path = io.shared_path(self.spark, "items")
        io.write_stage(self.items, path)
        return io.read_items(self.spark, path)

    @property
    def bucketed(self) -> DataFrame:
        """The window's events as a table in buckets of users."""
        return io.bucketed(self.log, "log")

    @property
    def matrix(self) -> DataFrame:
        return covisit.build(self.log, min_users=MIN_USERS)

    @property
    def users(self) -> DataFrame:
        """Listed users: all in the log, and all customers, many of whom are not (cold)."""
        customers = self.spark.read.parquet(f"{self.dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
        return self.events.select("user_id").union(customers).distinct()

    @property
    def seen(self) -> DataFrame:
        """All that the users touched in the whole log before the cutoff."""
        return interactions.touched(self.events, ad.CUTOFF_MS)

    @property
    def seeds(self) -> DataFrame:
        return candidates.seed_items(self.pairs, self.users, SEEDS)

    @property
    def covisit(self) -> DataFrame:
        return candidates.covisit_top_n(candidates.covisit_scores(self.seeds, self.matrix, self.pool), TOP)

    @property
    def als(self) -> DataFrame:
        users, items = ad.factors(self.spark, self.dir)
        return als.score_top_n(users, items, self.pool, TOP)

    @property
    def merged(self) -> DataFrame:
        return candidates.merge(self.als, self.covisit)

    @property
    def fallback(self) -> DataFrame:
        return candidates.add_popular_fallback(self.als, self.users, self.top)

    @property
    def targets(self) -> DataFrame:
        return evaluate.holdout_targets(self.events, self.contacts, ad.THRESHOLD_MS)

    @property
    def vertical(self) -> DataFrame:
        return features.user_top_vertical(self.pairs, self.items)

    @property
    def merged_features(self) -> DataFrame:
        return features.build_merged(self.merged, self.items, self.popularity, self.vertical, self.targets)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions of the oracles, each with those it stands on.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), """SELECT user_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS item_id, epoch_us(ts) // 1000 AS "timestamp",
        CAST(CASE event_type WHEN 'view' THEN 7 WHEN 'click' THEN 1 WHEN 'signup' THEN 10 WHEN 'error' THEN 11 WHEN 'purchase' THEN 20 END AS INTEGER) AS eid FROM events"""),
    "items": ((), """SELECT p_partkey AS item_id, CAST(CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 3 WHEN 'SMALL' THEN 4 WHEN 'STANDARD' THEN 6 END AS INTEGER) AS vertical_id,
        CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS category_ext_y, CAST(p_size AS INTEGER) AS region_id_y, CAST(p_partkey % 10 AS INTEGER) AS loc_id_y FROM part"""),
    "log": (("ev",), f"""SELECT * FROM ev WHERE "timestamp" >= {FIRST_MS} AND "timestamp" < {ad.CUTOFF_MS} AND eid <> 7"""),
    "weighted": (("log",), "SELECT *, CAST(CASE WHEN eid = 20 THEN 5 ELSE 1 END AS INTEGER) AS weight FROM log"),
    "agg": (("weighted",), 'SELECT user_id, item_id, CAST(sum(weight) AS INTEGER) AS weight, max("timestamp") AS last_timestamp FROM weighted GROUP BY ALL'),
    "pairs": (("agg",), f"SELECT * FROM agg QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_timestamp DESC, item_id) <= {RECENT}"),
    "pool": (("items", "pairs"), "SELECT item_id FROM items WHERE vertical_id IN (0, 2, 3, 4, 5, 7) AND item_id IN (SELECT item_id FROM pairs GROUP BY item_id HAVING count(DISTINCT user_id) >= 2)"),
    "seen": (("ev",), f"""SELECT DISTINCT user_id, item_id FROM ev WHERE eid <> 7 AND "timestamp" < {ad.CUTOFF_MS}"""),
    "up": (("log",), """SELECT DISTINCT user_id, least(item_id, n) AS item_a, greatest(item_id, n) AS item_b FROM (
        SELECT user_id, item_id, "timestamp" AS t, unnest([lead(item_id, 1) OVER w, lead(item_id, 2) OVER w, lead(item_id, 3) OVER w]) AS n, unnest([lead("timestamp", 1) OVER w, lead("timestamp", 2) OVER w, lead("timestamp", 3) OVER w]) AS nt
        FROM log WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", item_id)) WHERE n <> item_id AND nt - t <= 86400000"""),
    "pc": (("up",), f"SELECT item_a, item_b, count(*) AS weight FROM up GROUP BY ALL HAVING count(*) >= {MIN_USERS}"),
    "sym": (("pc",), "SELECT item_a AS item_id, item_b AS neighbor_id, weight FROM pc UNION ALL SELECT item_b, item_a, weight FROM pc"),
    "matrix": (("sym",), "SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, neighbor_id) AS INTEGER) AS neighbor_rank FROM sym QUALIFY neighbor_rank <= 50"),
    "pop": (("pairs",), "SELECT item_id, CAST(sum(weight) AS BIGINT) AS item_popularity, count(*) AS item_n_users FROM pairs GROUP BY item_id"),
    "top": (("pop", "pool"), f"SELECT item_id, item_popularity FROM pop WHERE item_id IN (FROM pool) ORDER BY item_popularity DESC, item_id LIMIT {TOP}"),
    "users": (("ev",), "SELECT user_id FROM ev UNION SELECT c_custkey FROM customer"),
    "seeds": (("pairs", "users"), f"SELECT user_id, item_id AS seed_item_id FROM pairs WHERE user_id IN (FROM users) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_timestamp DESC, item_id) <= {SEEDS}"),
    "cscores": (("seeds", "matrix", "pool"), "SELECT user_id, neighbor_id AS item_id, CAST(sum(weight) AS DOUBLE) AS covisit_score FROM seeds JOIN matrix ON seed_item_id = matrix.item_id WHERE neighbor_id IN (FROM pool) GROUP BY ALL"),
    "ctop": (("cscores",), f"SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY covisit_score DESC, item_id) - 1 AS INTEGER) AS covisit_rank FROM cscores QUALIFY covisit_rank < {TOP}"),
    "als": (("pool",), f"""SELECT user_id, item_id, als_score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY als_score DESC, item_id) - 1 AS INTEGER) AS als_rank FROM (
        SELECT u.vec_id AS user_id, i.vec_id AS item_id, list_dot_product(CAST(u.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) AS als_score
        FROM embeddings u, embeddings i WHERE u.vec_id % 50 = 0 AND i.vec_id IN (FROM pool)) QUALIFY als_rank < {TOP}"""),
    "merged": (("als", "ctop"), """SELECT user_id, item_id, coalesce(als_score, 0.0) AS als_score, coalesce(als_rank, 999) AS als_rank, coalesce(covisit_score, 0.0) AS covisit_score, coalesce(covisit_rank, 999) AS covisit_rank,
        als_score IS NOT NULL AS in_als, covisit_score IS NOT NULL AS in_covisit FROM als FULL JOIN ctop USING (user_id, item_id)"""),
    "cold": (("als", "users"), "SELECT user_id FROM users WHERE user_id NOT IN (SELECT user_id FROM als)"),
    "fb": (("als", "cold", "top"), """SELECT user_id, item_id, als_score, als_rank, 'als' AS source FROM als UNION ALL
        SELECT user_id, item_id, 0.0, CAST(row_number() OVER (PARTITION BY user_id ORDER BY item_popularity DESC, item_id) - 1 AS INTEGER), 'popular_fallback' FROM cold, top"""),
    "targets": (("ev",), f"""SELECT DISTINCT user_id, item_id FROM ev t WHERE "timestamp" >= {ad.THRESHOLD_MS} AND "timestamp" < {ad.CUTOFF_MS} AND eid = 20
        AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.user_id = t.user_id AND b.item_id = t.item_id AND b."timestamp" < {ad.THRESHOLD_MS})"""),
    "vert": (("pairs", "items"), "SELECT user_id, vertical_id AS top_vertical FROM (SELECT user_id, vertical_id, sum(weight) AS w FROM pairs JOIN items USING (item_id) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY w DESC, vertical_id) = 1"),
    "feat": (("merged", "items", "pop", "vert", "targets"), """SELECT m.user_id, m.item_id, als_score, als_rank, covisit_score, covisit_rank, CAST(in_als AS INTEGER) AS in_als, CAST(in_covisit AS INTEGER) AS in_covisit,
        vertical_id, category_ext_y, region_id_y, loc_id_y, coalesce(item_popularity, 0) AS item_popularity, coalesce(item_n_users, 0) AS item_n_users, CAST(vertical_id = top_vertical AS INTEGER) AS user_top_vertical_match, t.user_id IS NOT NULL AS target
        FROM merged m LEFT JOIN items USING (item_id) LEFT JOIN pop USING (item_id) LEFT JOIN vert v ON v.user_id = m.user_id LEFT JOIN targets t ON t.user_id = m.user_id AND t.item_id = m.item_id"""),
    "per_user": (("ev",), "SELECT user_id, count(*) AS length FROM ev WHERE eid <> 7 GROUP BY user_id"),
    "fac": ((), "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS y1, CAST(embedding[2] AS DOUBLE) AS y2 FROM embeddings"),
    "fold": (("pairs", "fac"), """SELECT user_id, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS x1, (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) AS x2 FROM (
        SELECT user_id, any_value(g11) + sum(weight * y1 * y1) + 0.1 * count(*) AS a11, any_value(g12) + sum(weight * y1 * y2) AS a12, any_value(g22) + sum(weight * y2 * y2) + 0.1 * count(*) AS a22, sum((1 + weight) * y1) AS b1, sum((1 + weight) * y2) AS b2
        FROM pairs JOIN fac ON item_id = id, (SELECT sum(y1 * y1) AS g11, sum(y1 * y2) AS g12, sum(y2 * y2) AS g22 FROM fac) GROUP BY user_id)"""),
    "evb": ((), f"""SELECT o_custkey AS user_id, l_partkey AS item_id, epoch_us(o_orderdate) // 1000 AS "timestamp", CAST(CASE l_returnflag WHEN 'N' THEN 7 WHEN 'A' THEN 1 WHEN 'R' THEN 20 END AS INTEGER) AS eid FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "logb": (("evb",), f"""SELECT * FROM evb WHERE eid <> 7 AND "timestamp" >= {ad.CUTOFF_B_MS - 3650 * ad.DAY_MS} AND "timestamp" < {ad.CUTOFF_B_MS}"""),
    "pcb": (("logb",), """SELECT item_a, item_b, count(*) AS weight FROM (SELECT DISTINCT user_id, least(item_id, n) AS item_a, greatest(item_id, n) AS item_b FROM (
        SELECT user_id, item_id, "timestamp" AS t, unnest([lead(item_id, 1) OVER w, lead(item_id, 2) OVER w, lead(item_id, 3) OVER w]) AS n, unnest([lead("timestamp", 1) OVER w, lead("timestamp", 2) OVER w, lead("timestamp", 3) OVER w]) AS nt
        FROM logb WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", item_id)) WHERE n <> item_id AND nt - t <= 86400000) GROUP BY ALL HAVING count(*) >= 2"""),
    "matrixb": (("pcb",), """SELECT item_id, neighbor_id, weight, CAST(row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, neighbor_id) AS INTEGER) AS neighbor_rank FROM (
        SELECT item_a AS item_id, item_b AS neighbor_id, weight FROM pcb UNION ALL SELECT item_b, item_a, weight FROM pcb) QUALIFY neighbor_rank <= 50"""),
}


def with_ctes(select: str, *names: str) -> str:
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            needs, sql = CTES[name]
            for n in needs:
                add(n)
            done[name] = sql

    for n in names:
        add(n)
    head = "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in done.items())
    return f"{head}\n{select.strip()}"


def register(name: str, select: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if select is not None:
            ORACLES[name] = with_ctes(select, *ctes)
        return f

    return keep


def simple(name: str, f: Callable[[Tables], DataFrame], select: str, *ctes: str) -> None:
    """A query of one expression over the tables."""
    register(name, select, *ctes)(lambda spark, sf_dir: f(Tables(spark, sf_dir)))


simple("a1_read_events", lambda t: t.read_events(), "SELECT * FROM ev", "ev")
simple("a2_user_history", lambda t: recommend.history_of(t.read_events(), t.contacts, ad.THRESHOLD_MS, 14, RECENT), f"""
  SELECT * FROM (SELECT user_id, item_id, CAST(sum(CASE WHEN eid = 20 THEN 5 ELSE 1 END) AS INTEGER) AS weight, max("timestamp") AS last_timestamp FROM ev
  WHERE eid <> 7 AND "timestamp" >= {ad.THRESHOLD_MS - 14 * ad.DAY_MS} AND "timestamp" < {ad.THRESHOLD_MS} GROUP BY user_id, item_id)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_timestamp DESC, item_id) <= {RECENT}""", "ev")
def through_csv(t: Tables, df: DataFrame, name: str) -> str:
    """The path of ``df`` written as CSV with a header."""
    path = io.shared_path(t.spark, name)
    df.write.option("header", True).csv(path)
    return path


simple("a3_read_ids", lambda t: io.read_ids(t.spark, through_csv(t, t.users, "users"), "user_id"), "SELECT user_id FROM users", "users")
simple("a3_read_targets", lambda t: io.read_targets(t.spark, through_csv(t, t.targets, "targets")), "SELECT user_id, item_id FROM targets", "targets")
simple("a4_read_items", lambda t: t.read_items(), "SELECT * FROM items", "items")
simple("a6_event_counts", lambda t: stats.event_counts(train=t.events.filter(F.col("timestamp") < ad.THRESHOLD_MS), eval=t.events.filter(F.col("timestamp") >= ad.THRESHOLD_MS)), f"""
  SELECT coalesce(split, 'total') AS split, n_events FROM (SELECT CASE WHEN "timestamp" < {ad.THRESHOLD_MS} THEN 'train' ELSE 'eval' END AS split, count(*) AS n_events FROM ev GROUP BY ROLLUP (1))""", "ev")
simple("b1_in_window", lambda t: t.log, "SELECT * FROM log", "log")
simple("b2_with_weight", lambda t: t.weighted, "SELECT * FROM weighted", "weighted")
simple("b5_restrict_to", lambda t: pool.restrict_to(t.pairs, t.pool, "item_id"), "SELECT * FROM pairs WHERE item_id IN (FROM pool)", "pairs", "pool")
simple("c1_aggregate", lambda t: t.aggregated, "SELECT * FROM agg", "agg")
simple("c2_keep_recent", lambda t: t.pairs, "SELECT * FROM pairs", "pairs")
simple("c3_user_pairs", lambda t: covisit.user_pairs(t.log), "SELECT * FROM up", "up")
simple("c4_pair_counts", lambda t: covisit.pair_counts(covisit.user_pairs(t.log), MIN_USERS), "SELECT * FROM pc", "pc")
simple("c2_keep_recent_bucketed", lambda t: interactions.keep_recent(interactions.aggregate(ev.with_weight(t.bucketed, t.contacts)), RECENT), "SELECT * FROM pairs", "pairs")
simple("c4_pair_counts_sketched", lambda t: covisit.pair_counts_sketched(covisit.user_pairs(t.bucketed), MIN_USERS), "SELECT * FROM pc", "pc")
simple("c5_symmetrize", lambda t: covisit.symmetrize(covisit.pair_counts(covisit.user_pairs(t.log), MIN_USERS)), "SELECT * FROM sym", "sym")
simple("c6_top_neighbors", lambda t: t.matrix, "SELECT * FROM matrix", "matrix")
simple("c7_covisit_coverage", lambda t: rounded(stats.covisit_coverage(t.matrix, t.items), "share"), "SELECT count(*) AS n_edges, count(DISTINCT item_id) AS n_items, round(count(DISTINCT item_id) / (SELECT CAST(count(DISTINCT item_id) AS DOUBLE) FROM items), 6) AS share FROM matrix", "matrix", "items")
simple("d1_dense_index", lambda t: ids.dense_index(t.pairs, "item_id"), "SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT item_id FROM pairs)", "pairs")
simple("d2_encode", lambda t: ids.encode(t.pairs, ids.dense_index(t.pairs, "user_id"), ids.dense_index(t.pairs, "item_id")), """
  SELECT CAST(u.idx AS INTEGER) AS user_idx, CAST(i.idx AS INTEGER) AS item_idx, weight FROM pairs
  JOIN (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM (SELECT DISTINCT user_id FROM pairs)) u USING (user_id)
  JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM pairs)) i USING (item_id)""", "pairs")
simple("d3_matrix_stats", lambda t: rounded(stats.matrix_stats(t.pairs), "density_pct"), """
  SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS nnz, round(100.0 * count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id)), 6) AS density_pct FROM pairs""", "pairs")
simple("d4_lookup", lambda t: ids.lookup(t.items.select("item_id", "vertical_id"), ids.dense_index(t.pairs, "item_id"), "item_id")[0], """
  SELECT item_id, vertical_id, CAST(idx AS INTEGER) AS idx FROM items JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM pairs)) USING (item_id)""", "items", "pairs")
simple("d4_lookup_dropped", lambda t: ids.lookup(t.items.select("item_id"), ids.dense_index(t.pairs, "item_id"), "item_id")[1], "SELECT count(*) AS n_dropped FROM items WHERE item_id NOT IN (SELECT item_id FROM pairs)", "items", "pairs")
simple("d5_allowed_items", lambda t: t.pool, "SELECT * FROM pool", "pool")
simple("d6_item_popularity", lambda t: t.popularity, "SELECT * FROM pop", "pop")
simple("d7_top_by_weight", lambda t: t.top, "SELECT * FROM top", "top")
simple("d8_top_by_users", lambda t: popularity.top_by_users(t.pairs, t.items, k=TOP), f"""
  SELECT item_id, count(*) AS n_users FROM pairs WHERE item_id IN (SELECT item_id FROM items WHERE vertical_id IN (0, 2, 3, 4, 5, 7)) GROUP BY item_id ORDER BY n_users DESC, item_id LIMIT {TOP}""", "pairs", "items")
simple("e3_score_top_n", lambda t: rounded(t.als, "als_score"), "SELECT user_id, item_id, round(als_score, 6) AS als_score, als_rank FROM als", "als")
simple("e5_seed_items", lambda t: t.seeds, "SELECT * FROM seeds", "seeds")
simple("e6_covisit_scores", lambda t: candidates.covisit_scores(t.seeds, t.matrix, t.pool), "SELECT * FROM cscores", "cscores")
simple("e7_covisit_top_n", lambda t: t.covisit, "SELECT * FROM ctop", "ctop")
simple("e8_merge", lambda t: rounded(t.merged, "als_score"), "SELECT * REPLACE (round(als_score, 6) AS als_score) FROM merged", "merged")
simple("e9_source_overlap", lambda t: stats.source_overlap(t.merged), """
  SELECT count(*) FILTER (in_als AND NOT in_covisit) AS als_only, count(*) FILTER (in_covisit AND NOT in_als) AS covisit_only, count(*) FILTER (in_als AND in_covisit) AS "both", count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM merged""", "merged")
simple("e10_cold_users", lambda t: candidates.cold_users(t.users, t.als), "SELECT * FROM cold", "cold")
simple("e11_popular_fallback", lambda t: rounded(t.fallback, "als_score"), "SELECT * REPLACE (round(als_score, 6) AS als_score) FROM fb", "fb")
simple("f1_user_top_vertical", lambda t: t.vertical, "SELECT * FROM vert", "vert")
simple("f2_with_target", lambda t: features.with_target(t.covisit, t.targets), """
  SELECT c.*, t.user_id IS NOT NULL AS target FROM ctop c LEFT JOIN targets t ON t.user_id = c.user_id AND t.item_id = c.item_id""", "ctop", "targets")
simple("f3_build_single", lambda t: rounded(features.build_single(t.fallback, t.items, t.popularity, t.vertical, t.targets), "als_score"), """
  SELECT m.user_id, m.item_id, round(als_score, 6) AS als_score, als_rank, CAST(source = 'popular_fallback' AS INTEGER) AS is_cold, vertical_id, category_ext_y, region_id_y, loc_id_y,
  coalesce(item_popularity, 0) AS item_popularity, coalesce(item_n_users, 0) AS item_n_users, CAST(vertical_id = top_vertical AS INTEGER) AS user_top_vertical_match, t.user_id IS NOT NULL AS target
  FROM fb m LEFT JOIN items USING (item_id) LEFT JOIN pop USING (item_id) LEFT JOIN vert v ON v.user_id = m.user_id LEFT JOIN targets t ON t.user_id = m.user_id AND t.item_id = m.item_id""", "fb", "items", "pop", "vert", "targets")
simple("f4_build_merged", lambda t: rounded(t.merged_features, "als_score"), "SELECT * REPLACE (round(als_score, 6) AS als_score) FROM feat", "feat")
simple("f5_positive_rate", lambda t: rounded(stats.positive_rate(t.merged_features), "rate"), "SELECT CAST(sum(CAST(target AS INTEGER)) AS BIGINT) AS n_positive, round(avg(CAST(target AS INTEGER)), 6) AS rate FROM feat", "feat")
simple("g1_split_by_user", lambda t: ranking.split_by_user(t.pairs)[1], "SELECT * FROM pairs WHERE substring(md5('42:' || user_id), 1, 8) < '33333333'", "pairs")


def _recall(score: str, k: int) -> str:
    return f"""SELECT avg(coalesce(h, 0) / n) AS recall, count(*) AS n_users FROM (SELECT user_id, CAST(count(*) AS DOUBLE) AS n FROM targets WHERE user_id IN (SELECT user_id FROM merged) GROUP BY user_id)
    LEFT JOIN (SELECT user_id, count(*) AS h FROM (SELECT user_id, item_id FROM merged QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {score} DESC, item_id) <= {k}) JOIN targets USING (user_id, item_id) GROUP BY user_id) USING (user_id)"""


simple("h1_recall_at_k", lambda t: rounded(evaluate.recall_at_k(t.merged, "covisit_score", t.targets, K), "recall"), f"SELECT round(recall, 6) AS recall, n_users FROM ({_recall('covisit_score', K)})", "merged", "targets")
simple("h2_compare", lambda t: rounded(evaluate.compare(t.merged, ["als_score", "covisit_score"], t.targets, K), "recall", "gain", "relative_gain"), f"""
  SELECT score, round(recall, 6) AS recall, round(recall - base, 6) AS gain, round(CASE WHEN base > 0 THEN (recall - base) / base END, 6) AS relative_gain
  FROM (SELECT 'als_score' AS score, recall FROM ({_recall('als_score', K)}) UNION ALL SELECT 'covisit_score', recall FROM ({_recall('covisit_score', K)})), (SELECT recall AS base FROM ({_recall('als_score', K)}))""", "merged", "targets")
def _drawn(seed: int = 42) -> str:
    """The SQL of ``evaluate.drawn``."""
    limits, total, term = [], 0.0, math.exp(-1)
    for n in range(evaluate.MOST_DRAWN):
        total, term = total + term, term / (n + 1)
        limits.append(int(total * 2**32))
    return f"len(list_filter({limits}, lambda x: CAST('0x' || substr(md5('{seed}:' || user_id || ':' || r), 1, 8) AS BIGINT) >= x))"


def _user_recall(score: str, name: str) -> str:
    return f"""(SELECT user_id, coalesce(h, 0) / n AS {name} FROM (SELECT user_id, CAST(count(*) AS DOUBLE) AS n FROM targets WHERE user_id IN (SELECT user_id FROM merged) GROUP BY user_id)
    LEFT JOIN (SELECT user_id, count(*) AS h FROM (SELECT user_id, item_id FROM merged QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {score} DESC, item_id) <= {K}) JOIN targets USING (user_id, item_id) GROUP BY user_id) USING (user_id))"""


simple("h2_paired_bootstrap", lambda t: rounded(evaluate.bootstrap(t.merged, ["als_score", "covisit_score"], t.targets, K), "gain", "low", "high", "better"), f"""
  , per AS (SELECT * FROM {_user_recall("als_score", "a")} JOIN {_user_recall("covisit_score", "c")} USING (user_id)), reps AS (SELECT unnest(range(1, 201)) AS r),
  each AS (SELECT r, sum(w * c) / sum(w) - sum(w * a) / sum(w) AS g FROM (SELECT *, {_drawn()} AS w FROM per, reps) GROUP BY r HAVING sum(w) > 0), l AS (SELECT list_sort(list(g)) AS g FROM each)
  SELECT 'covisit_score' AS score, round((SELECT avg(c) - avg(a) FROM per), 6) AS gain, round(g[1 + CAST(floor(0.025 * len(g)) AS INTEGER)], 6) AS low, round(g[len(g) - CAST(floor(0.025 * len(g)) AS INTEGER)], 6) AS high,
         round(len(list_filter(g, lambda x: x > 0)) / CAST(len(g) AS DOUBLE), 6) AS better FROM l""", "merged", "targets")
simple("h3_popular_baseline", lambda t: rounded(evaluate.popular_baseline(t.top, t.targets, t.users), "recall"), """
  SELECT round(avg(coalesce(h, 0) / n), 6) AS recall, count(*) AS n_users FROM (SELECT user_id, CAST(count(*) AS DOUBLE) AS n FROM targets WHERE user_id IN (FROM users) GROUP BY user_id)
  LEFT JOIN (SELECT user_id, count(*) AS h FROM targets WHERE item_id IN (SELECT item_id FROM top) GROUP BY user_id) USING (user_id)""", "targets", "users", "top")
simple("k1_event_type_funnel", lambda t: stats.event_type_funnel(t.events, t.contacts), "SELECT eid, count(*) AS n_events, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct, eid = 20 AS is_contact FROM ev GROUP BY eid", "ev")
simple("k2_daily_activity", lambda t: stats.daily_activity(t.events, t.contacts), """SELECT CAST(make_timestamp("timestamp" * 1000) AS DATE) AS day, count(*) AS n_events, count(*) FILTER (eid = 20) AS n_contacts FROM ev GROUP BY 1""", "ev")
simple("k3_cold_user_share", lambda t: rounded(stats.cold_user_share(t.events), "cold_pct"), """
  SELECT count(*) AS n_users, count(*) FILTER (n = 0) AS n_cold, round(100.0 * count(*) FILTER (n = 0) / count(*), 6) AS cold_pct FROM (SELECT user_id, count(*) FILTER (eid <> 7) AS n FROM ev GROUP BY user_id)""", "ev")
simple("k4_history_quantiles", lambda t: stats.history_quantiles(t.events.filter("eid <> 7")), """
  SELECT q, length FROM (SELECT length, row_number() OVER (ORDER BY length) - 1 AS i, count(*) OVER () AS n FROM per_user), (SELECT CAST(unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS DOUBLE) AS q)
  WHERE i = floor((n - 1) * q + 0.5)""", "per_user")
simple("k5_history_histogram", lambda t: stats.history_histogram(t.events.filter("eid <> 7")), """
  SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((length - lo) / ((hi - lo) / 50.0)), 49) END AS INTEGER) AS bin, count(*) AS n_users FROM (
    SELECT length, min(length) OVER () AS lo, max(length) OVER () AS hi FROM per_user WHERE length <= (
      SELECT length FROM (SELECT length, row_number() OVER (ORDER BY length) - 1 AS i, count(*) OVER () AS n FROM per_user) WHERE i = floor((n - 1) * CAST(0.95 AS DOUBLE) + 0.5))) GROUP BY 1""", "per_user")
simple("l1_exclude_seen", lambda t: candidates.exclude_seen(t.covisit, t.seen), "SELECT c.* FROM ctop c ANTI JOIN seen p ON p.user_id = c.user_id AND p.item_id = c.item_id", "ctop", "seen")
simple("l2_fill_up", lambda t: candidates.fill_up(t.covisit.filter("covisit_rank < 5").withColumn("rank", F.col("covisit_rank")), t.top, t.seen, 12), """
  , own AS (SELECT user_id, item_id, covisit_rank AS pos FROM ctop WHERE covisit_rank < 5), have AS (SELECT user_id, count(*) AS have FROM own GROUP BY user_id HAVING count(*) < 12),
  extra AS (SELECT user_id, item_id, have + row_number() OVER (PARTITION BY user_id ORDER BY item_popularity DESC, item_id) - 1 AS pos FROM (
    SELECT * FROM have, top WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.user_id = have.user_id AND o.item_id = top.item_id) AND NOT EXISTS (SELECT 1 FROM seen p WHERE p.user_id = have.user_id AND p.item_id = top.item_id)))
  SELECT user_id, item_id, CAST(pos AS INTEGER) AS pos, false AS filled FROM own UNION ALL SELECT user_id, item_id, CAST(pos AS INTEGER), true FROM extra WHERE pos < 12""", "ctop", "top", "seen")
simple("l2_fill_up_listed", lambda t: recommend.complete(t.covisit.withColumn("rank", F.col("covisit_rank")), t.users, t.seen, t.pairs, t.pool, 12), """
  , own AS (SELECT user_id, item_id, covisit_rank AS pos FROM ctop WHERE covisit_rank < 12 AND user_id IN (FROM users)), have AS (SELECT user_id, count(item_id) AS have FROM users LEFT JOIN own USING (user_id) GROUP BY user_id HAVING count(item_id) < 12),
  best AS (SELECT item_id, item_popularity FROM pop WHERE item_id IN (FROM pool) ),
  extra AS (SELECT user_id, item_id, have + row_number() OVER (PARTITION BY user_id ORDER BY item_popularity DESC, item_id) - 1 AS pos FROM (
    SELECT * FROM have, best WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.user_id = have.user_id AND o.item_id = best.item_id) AND NOT EXISTS (SELECT 1 FROM seen p WHERE p.user_id = have.user_id AND p.item_id = best.item_id)))
  SELECT user_id, item_id, CAST(pos AS INTEGER) AS pos, false AS filled FROM own UNION ALL SELECT user_id, item_id, CAST(pos AS INTEGER), true FROM extra WHERE pos < 12""", "ctop", "pop", "pool", "seen", "users")
simple("l2_fill_up_favourites", lambda t: recommend.complete(t.covisit.filter("covisit_rank < 3").withColumn("rank", F.col("covisit_rank")), t.users, t.seen, t.pairs, t.pool, 14, t.vertical.select("user_id", F.col("top_vertical").alias("group")), t.items.select("item_id", F.col("vertical_id").alias("group"))), """
  , own AS (SELECT user_id, item_id, covisit_rank AS pos FROM ctop WHERE covisit_rank < 3 AND user_id IN (FROM users)), have AS (SELECT user_id, count(item_id) AS have FROM users LEFT JOIN own USING (user_id) GROUP BY user_id),
  best AS (SELECT item_id, item_popularity, vertical_id FROM pop JOIN pool USING (item_id) JOIN items USING (item_id)),
  free AS (SELECT user_id, have, item_id, item_popularity, coalesce(vertical_id = top_vertical, false) AS liked FROM have LEFT JOIN vert USING (user_id), best
    WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.user_id = have.user_id AND o.item_id = best.item_id) AND NOT EXISTS (SELECT 1 FROM seen p WHERE p.user_id = have.user_id AND p.item_id = best.item_id)),
  extra AS (SELECT user_id, item_id, have + row_number() OVER (PARTITION BY user_id ORDER BY liked DESC, item_popularity DESC, item_id) - 1 AS pos FROM free)
  SELECT user_id, item_id, CAST(pos AS INTEGER) AS pos, false AS filled FROM own UNION ALL SELECT user_id, item_id, CAST(pos AS INTEGER), true FROM extra WHERE pos < 14""", "ctop", "pop", "pool", "items", "vert", "seen", "users")
simple("f6_profile_features", lambda t: rounded(features.with_profile(t.covisit, features.user_profile(t.pairs, t.items), t.items), "vertical_share", "category_share", "region_share"), """
  , h AS (SELECT user_id, weight, vertical_id, category_ext_y, region_id_y FROM pairs JOIN items USING (item_id)), tot AS (SELECT user_id, count(*) AS user_n_items, CAST(sum(weight) AS BIGINT) AS user_weight FROM pairs GROUP BY user_id)
  SELECT c.*, user_n_items, user_weight, round(coalesce((SELECT sum(weight) FROM h WHERE h.user_id = c.user_id AND h.vertical_id = i.vertical_id), 0) / user_weight, 6) AS vertical_share,
    round(coalesce((SELECT sum(weight) FROM h WHERE h.user_id = c.user_id AND h.category_ext_y = i.category_ext_y), 0) / user_weight, 6) AS category_share,
    round(coalesce((SELECT sum(weight) FROM h WHERE h.user_id = c.user_id AND h.region_id_y = i.region_id_y), 0) / user_weight, 6) AS region_share
  FROM ctop c JOIN tot USING (user_id) LEFT JOIN items i USING (item_id)""", "ctop", "pairs", "items")
simple("l3_balance_by_vertical", lambda t: ranking.balance_by_vertical(t.covisit, t.items, k=15, quota=3, depth=30, score_col="covisit_score"), """
  SELECT user_id, item_id, vertical_id, covisit_score, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY over_q, d) - 1 AS pos FROM (
    SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, vertical_id ORDER BY d) > 3 THEN 1 ELSE 0 END AS over_q FROM (
      SELECT c.user_id, c.item_id, vertical_id, covisit_score, d FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY covisit_score DESC, item_id) AS d FROM ctop) c LEFT JOIN items USING (item_id) WHERE d <= 30))) WHERE pos < 15""", "ctop", "items")
def submitted(t: Tables) -> DataFrame:
    """The submission file read back."""
    path = io.shared_path(t.spark, "submission")
    io.write_submission(t.covisit, path, 12, "covisit_score")
    return io.read_targets(t.spark, path)


simple("l4_submission", submitted, "SELECT user_id, item_id FROM ctop QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY covisit_score DESC, item_id) <= 12", "ctop")
simple("l5_holdout_targets", lambda t: t.targets, "SELECT * FROM targets", "targets")
simple("l6_retrieval_recall", lambda t: rounded(evaluate.retrieval_recall(t.merged, t.targets), "recall"), """
  SELECT count(*) AS n_targets, count(m.user_id) AS n_hits, CAST(sum(coalesce(CAST(in_als AS INTEGER), 0)) AS BIGINT) AS hits_als, CAST(sum(coalesce(CAST(in_covisit AS INTEGER), 0)) AS BIGINT) AS hits_covisit,
  round(avg(CASE WHEN m.user_id IS NULL THEN 0 ELSE 1 END), 6) AS recall FROM targets t LEFT JOIN merged m ON m.user_id = t.user_id AND m.item_id = t.item_id""", "targets", "merged")


@register("flagship_next_items", "SELECT * FROM ctop", "ctop")
def flagship(spark: SparkSession, sf_dir: str, min_users: int = MIN_USERS) -> DataFrame:
    t = Tables(spark, sf_dir)
    return next_items.run(t.events, t.items, t.contacts, ad.CUTOFF_MS, recent=RECENT, min_users=min_users, seeds=SEEDS, n=TOP)


@register("m1_aggregate_orders", """SELECT user_id, item_id, CAST(sum(CASE WHEN eid = 20 THEN 5 ELSE 1 END) AS INTEGER) AS weight, max("timestamp") AS last_timestamp FROM logb GROUP BY user_id, item_id""", "logb")
def aggregate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 on the larger catalogue of mapping B."""
    log = ev.in_window(ad.order_log(spark, sf_dir), ad.CUTOFF_B_MS, 3650)
    return interactions.aggregate(ev.with_weight(log, ad.contacts(spark)))


@register("m2_covisit_orders", "SELECT * FROM matrixb", "matrixb")
def covisit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 to C6 on mapping B."""
    return covisit.build(ev.in_window(ad.order_log(spark, sf_dir), ad.CUTOFF_B_MS, 3650), min_users=2)


def _factors(t: Tables):
    user_index, item_index = ids.dense_index(t.pairs, "user_id"), ids.dense_index(t.pairs, "item_id")
    return als.fit(ids.encode(t.pairs, user_index, item_index)), user_index, item_index


@register("e1_als_fit")
def als_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _factors(Tables(spark, sf_dir))[0].itemFactors


@register("e1_training_loss_given_factors", """
  , x AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  cells AS (SELECT weight, list_dot_product(a.v, b.v) AS p, list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) AS sq FROM pairs JOIN x a ON a.id = user_id JOIN x b ON b.id = item_id),
  o AS (SELECT sum((1 + weight) * (1 - p) * (1 - p) - p * p) AS observed, 0.1 * sum(sq) AS penalty FROM cells), e AS (SELECT sum(list_dot_product(a.v, b.v) ** 2) AS all_cells FROM x a, x b)
  SELECT round(observed + all_cells + penalty, 4) AS loss, round(observed, 4) AS observed, round(all_cells, 4) AS all_cells, round(penalty, 4) AS penalty FROM o, e""", "pairs")
def training_loss_given_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss over all cells; SQL forms every pair of vectors, the library two Gram matrices."""
    t = Tables(spark, sf_dir)
    given = ad.factors(spark, sf_dir)[1]
    loss = als.training_loss(t.pairs.select(F.col("user_id").alias("user_idx"), F.col("item_id").alias("item_idx"), "weight"), given, given)
    return loss.select(*[F.round(c, 4).alias(c) for c in loss.columns])


@register("e2_fold_in")
def fold_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    model, users, items = _factors(t)
    history = ids.encode(t.pairs, users, items).select(F.col("user_idx").cast("long").alias("user_id"), F.col("item_idx").alias("item_id"), "weight")
    return als.fold_in(history, model.itemFactors)


@register("e4_recommend_from_history")
def recommend_from_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return recommend.als_candidates(t.pairs, t.pool, n=TOP)


def _given(t: Tables) -> DataFrame:
    """Item factors of two numbers each, so that SQL can solve a user's equations."""
    return ad.factors(t.spark, t.dir)[1].select("id", F.slice("features", 1, 2).alias("features"))


@register("e2_fold_in_given_factors", "SELECT user_id, round(x1, 4) AS x1, round(x2, 4) AS x2 FROM fold", "fold")
def fold_in_given_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    x = [F.round(F.col("features")[i].cast("double"), 4).alias(f"x{i + 1}") for i in range(2)]
    return als.fold_in(t.pairs.select("user_id", "item_id", "weight"), _given(t)).select("user_id", *x)


@register("e4_recommend_given_factors", f"""SELECT user_id, item_id, round(als_score, 4) + 0.0 AS als_score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY als_score DESC, item_id) - 1 AS INTEGER) AS als_rank FROM (
    SELECT user_id, id AS item_id, CAST(CAST(x1 AS FLOAT) AS DOUBLE) * y1 + CAST(CAST(x2 AS FLOAT) AS DOUBLE) * y2 AS als_score FROM fold, fac WHERE id IN (FROM pool)) QUALIFY als_rank < {TOP}""", "fold", "pool")
def recommend_given_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2, then E3, for all users of the log."""
    t = Tables(spark, sf_dir)
    return als.recommend_from_history(t.pairs.select("user_id", "item_id", "weight"), _given(t), t.pool, TOP).withColumn("als_score", F.round("als_score", 4) + F.lit(0.0))


@register("g2_rank_validation")
def rank_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted, val = ranking.split_by_user(io.staged(Tables(spark, sf_dir).merged_features, "features"))
    return ranking.score(ranking.fit(fitted, val, ROUNDS, DEPTH, rate=0.3, k=K), val)


@register("g2_target_statistics", f"""
  , f AS (SELECT user_id, item_id, CAST(target AS INTEGER) AS t, coalesce(CAST(vertical_id AS VARCHAR), 'none') AS a, coalesce(CAST(category_ext_y AS VARCHAR), 'none') AS b, md5('42:' || user_id || ':' || item_id) AS place FROM feat),
  p AS (SELECT avg(t) AS prior FROM f)
  SELECT user_id, item_id, {", ".join(f"round((coalesce(sum(t) OVER {w}, 0) + prior) / (count(*) OVER {w} + 1), 6) AS ts_{c}" for w, c in (("wa", "vertical_id"), ("wb", "category_ext_y")))} FROM f, p
  WINDOW wa AS (PARTITION BY a ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), wb AS (PARTITION BY b ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "feat")
def ordered_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = io.staged(Tables(spark, sf_dir).merged_features, "features")
    prior = float(rows.agg(F.avg(F.col("target").cast("int"))).first()[0] or 0.0)
    return rounded(target_stats.ordered(rows, ("vertical_id", "category_ext_y"), prior), "ts_vertical_id", "ts_category_ext_y")


@register("g3_importances")
def feature_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted, val = ranking.split_by_user(io.staged(Tables(spark, sf_dir).merged_features, "features"))
    return ranking.importances(ranking.fit(fitted, val, ROUNDS, DEPTH, rate=0.3, k=K), spark)


@register("g3_importances_given_trees", """
  , leaves AS (SELECT vertical_id AS t, CASE WHEN region_id_y <= 25 THEN 1 WHEN loc_id_y <= 4 THEN 3 ELSE 4 END AS n, avg(category_ext_y) AS v, count(*) AS c FROM items WHERE vertical_id IS NOT NULL GROUP BY ALL),
  sides AS (SELECT a.t, a.v AS v1, a.c AS c1, b.v AS v3, b.c AS c3, d.v AS v4, d.c AS c4 FROM leaves a, leaves b, leaves d WHERE a.t = b.t AND b.t = d.t AND a.n = 1 AND b.n = 3 AND d.n = 4),
  low AS (SELECT *, (v3 * c3 + v4 * c4) / (c3 + c4) AS v2, c3 + c4 AS c2 FROM sides), root AS (SELECT *, (v1 * c1 + v2 * c2) / (c1 + c2) AS v0 FROM low),
  change AS (SELECT 'region_id_y' AS feature, sum(c1 * (v1 - v0) ** 2 + c2 * (v2 - v0) ** 2) AS c FROM root UNION ALL SELECT 'loc_id_y', sum(c3 * (v3 - v2) ** 2 + c4 * (v4 - v2) ** 2) FROM root)
  SELECT feature, round(100 * c / sum(c) OVER (), 6) AS importance FROM change""", "items")
def importances_given_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree a vertical, two splits each, whose leaves hold the items' mean category."""
    items = Tables(spark, sf_dir).items.filter("vertical_id is not null")
    leaf = F.when(F.col("region_id_y") <= 25, 1).when(F.col("loc_id_y") <= 4, 3).otherwise(4)
    leaves = items.groupBy(F.col("vertical_id").alias("tree"), leaf.alias("node")).agg(F.avg("category_ext_y").alias("value"), F.count("*").alias("rows"))
    none = [F.lit(None).cast("string").alias("feature"), F.lit(-1).alias("left"), F.lit(-1).alias("right")]
    inner = F.inline(F.array(*[F.struct(F.lit(n).alias("node"), F.lit(f).alias("feature"), F.lit(a).alias("left"), F.lit(b).alias("right")) for n, f, a, b in ((0, "region_id_y", 1, 2), (2, "loc_id_y", 3, 4))]))
    splits = leaves.select("tree").distinct().select("tree", inner).withColumns({"value": F.lit(0.0), "rows": F.lit(0).cast("long")})
    return rounded(boosting.importances(leaves.select("tree", "node", "value", "rows", *none).unionByName(splits)), "importance")


def _sid_sql(levels: int = 4, codes: int = 8) -> str:
    """Codes of all vectors, level by level; the centres are given vectors, halved at each level."""
    out = ["x0 AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"]
    for k in range(levels):
        near = f"SELECT x.vec_id, x.v, c.vec_id - {k * codes} AS code, list_transform(c.v, lambda y: y * {0.5**k}) AS m FROM x{k} x, (SELECT vec_id, v FROM x0 WHERE vec_id BETWEEN {k * codes} AND {(k + 1) * codes - 1}) c"
        out.append(f"s{k} AS (SELECT vec_id, code AS sid_{k}, v, m FROM ({near}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) ** 2)), code) = 1)")
        out.append(f"x{k + 1} AS (SELECT vec_id, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) AS v FROM s{k})")
    out.append(f"sids AS (SELECT vec_id AS item_id, {', '.join(f'CAST(sid_{k} AS INTEGER) AS sid_{k}' for k in range(levels))} FROM s0 {' '.join(f'JOIN s{k} USING (vec_id)' for k in range(1, levels))})")
    return ", ".join(out)


def _given_sids(t: Tables, levels: int = 4, codes: int = 8) -> DataFrame:
    vectors = ad.factors(t.spark, t.dir)[1].select(F.col("id").alias("item_id"), "features")
    rows = vectors.filter(F.col("item_id") < levels * codes).orderBy("item_id").collect()  # the given centres, a few
    centres = [np.array([r["features"] for r in rows if k * codes <= r["item_id"] < (k + 1) * codes]) * 0.5**k for k in range(levels)]
    return semantic.encode(vectors, centres)


simple("sid_encode_given_codebooks", _given_sids, f", {_sid_sql()} SELECT * FROM sids", "ev")
simple("sid_prefix_candidates", lambda t: semantic.prefix_candidates(t.pairs, _given_sids(t), t.popularity, t.pool, least=1, n=TOP), f"""
  , {_sid_sql()}, u AS (SELECT user_id, weight, s.* EXCLUDE (item_id) FROM pairs JOIN sids s USING (item_id)), i AS (SELECT s.*, item_popularity FROM sids s JOIN pool USING (item_id) LEFT JOIN pop USING (item_id)),
  hits AS ({" UNION ALL ".join(f"SELECT user_id, i.item_id, item_popularity, weight FROM u JOIN i ON {' AND '.join(f'u.sid_{j} = i.sid_{j}' for j in range(k + 1))}" for k in range(4))})
  SELECT user_id, item_id, CAST(sum(weight) AS DOUBLE) AS sid_score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY sum(weight) DESC, any_value(item_popularity) DESC NULLS LAST, item_id) - 1 AS INTEGER) AS sid_rank FROM hits GROUP BY user_id, item_id QUALIFY sid_rank < {TOP}""", "pairs", "pool", "pop")


@register("sid_fitted_codes")
def fitted_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by centres learned from all vectors."""
    vectors = ad.factors(spark, sf_dir)[1].select(F.col("id").alias("item_id"), "features")
    return semantic.encode(vectors, semantic.fit_codebooks(vectors))


@register("m3_lists_of_listed_users")
def lists_of_listed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain on mapping B for all customers, those without orders included."""
    log, items = io.staged(ad.order_log(spark, sf_dir), "log"), io.staged(ad.items(spark, sf_dir), "items")
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    return recommend.run(spark, log, items, ad.contacts(spark), ad.CUTOFF_B_MS - 365 * ad.DAY_MS, users, k=K, days=3650, min_users=2, n=TOP, rounds=ROUNDS, depth=DEPTH)[0]


@register("m4_covisit_lists_of_listed_users", f"""
  , pairsb AS (SELECT user_id, item_id, CAST(sum(CASE WHEN eid = 20 THEN 5 ELSE 1 END) AS INTEGER) AS weight, max("timestamp") AS last_timestamp FROM logb GROUP BY user_id, item_id QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_timestamp DESC, item_id) <= {RECENT}),
  poolb AS (SELECT item_id FROM items WHERE vertical_id IN (0, 2, 3, 4, 5, 7) AND item_id IN (SELECT item_id FROM pairsb GROUP BY item_id HAVING count(DISTINCT user_id) >= 2)),
  seedsb AS (SELECT user_id, item_id AS seed_item_id FROM pairsb QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_timestamp DESC, item_id) <= {SEEDS}),
  scoresb AS (SELECT user_id, neighbor_id AS item_id, sum(weight) AS s FROM seedsb JOIN matrixb ON seed_item_id = matrixb.item_id WHERE neighbor_id IN (FROM poolb) GROUP BY ALL),
  seenb AS (SELECT DISTINCT user_id, item_id FROM evb WHERE eid <> 7 AND "timestamp" < {ad.CUTOFF_B_MS}),
  freshb AS (SELECT * FROM scoresb s WHERE NOT EXISTS (SELECT 1 FROM seenb p WHERE p.user_id = s.user_id AND p.item_id = s.item_id)),
  usersb AS (SELECT c_custkey AS user_id FROM customer),
  ownb AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item_id) - 1 AS pos FROM freshb WHERE user_id IN (FROM usersb) QUALIFY pos < {K}),
  haveb AS (SELECT user_id, count(item_id) AS have FROM usersb LEFT JOIN ownb USING (user_id) GROUP BY user_id HAVING count(item_id) < {K}),
  bestb AS (SELECT item_id, sum(weight) AS w FROM pairsb WHERE item_id IN (FROM poolb) GROUP BY item_id),
  extrab AS (SELECT user_id, item_id, have + row_number() OVER (PARTITION BY user_id ORDER BY w DESC, item_id) - 1 AS pos FROM (
    SELECT * FROM haveb, bestb WHERE NOT EXISTS (SELECT 1 FROM ownb o WHERE o.user_id = haveb.user_id AND o.item_id = bestb.item_id) AND NOT EXISTS (SELECT 1 FROM seenb p WHERE p.user_id = haveb.user_id AND p.item_id = bestb.item_id)))
  SELECT user_id, item_id, CAST(pos AS INTEGER) AS pos, false AS filled FROM ownb UNION ALL SELECT user_id, item_id, CAST(pos AS INTEGER), true FROM extrab WHERE pos < {K}""", "matrixb", "items")
def covisit_lists_of_listed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-visitation lists on mapping B, without items seen, filled up for every customer."""
    log, contacts = ad.order_log(spark, sf_dir), ad.contacts(spark)
    history = recommend.history_of(log, contacts, ad.CUTOFF_B_MS, 3650, RECENT)
    allowed = pool.allowed_items(ad.items(spark, sf_dir), history)
    found = recommend.covisit_lists(history, covisit_orders(spark, sf_dir), allowed, 1_000_000, SEEDS)
    seen = interactions.touched(log, ad.CUTOFF_B_MS)
    fresh = candidates.exclude_seen(found, seen).withColumn("rank", F.col("covisit_rank"))
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    return recommend.complete(fresh, users, seen, history, allowed, K)
