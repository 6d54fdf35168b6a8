"""Hand-made fixtures; the expected rows are worked out by hand."""

import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from listrec.functions import events as ev
from listrec.operators import als, candidates, covisit, evaluate, features, ids, interactions, pool, popularity, ranking, semantic, stats
from listrec.sources import io

H = 3_600_000
DAY = 24 * H


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def log(spark, data):
    return spark.createDataFrame(data, "user_id long, item_id long, timestamp long, eid int")


def pairs(spark, data):
    return spark.createDataFrame(data, "user_id long, item_id long, weight int, last_timestamp long")


def contacts(spark):
    return spark.createDataFrame([(20,)], "mapped_eid int")


def test_window_edges(spark):
    cut = 40 * DAY
    start = cut - 28 * DAY
    e = log(spark, [(1, 1, start - 1, 1), (1, 2, start, 1), (1, 3, cut - 1, 1), (1, 4, cut, 1), (1, 5, start + 1, 7)])
    assert rows(ev.in_window(e, cut), "item_id") == [(2,), (3,)]


def test_window_reaches_the_scan(spark, tmp_path):
    log(spark, [(1, 1, 1, 1)]).write.parquet(str(tmp_path / "e"))
    plan = ev.in_window(io.read_events(spark, str(tmp_path / "e")), 5 * DAY).select("user_id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(timest" in plan and "LessThan(timest" in plan and "item_id" not in plan.split("ReadSchema")[-1]


def test_weights(spark):
    e = log(spark, [(1, 1, 10, 1), (1, 1, 30, 20), (1, 1, 20, 1)])
    assert rows(interactions.aggregate(ev.with_weight(e, contacts(spark)))) == [(1, 1, 7, 30)]


def test_recent_cap_breaks_ties_by_item(spark):
    p = pairs(spark, [(1, 4, 1, 5), (1, 3, 1, 9), (1, 2, 1, 7), (1, 1, 1, 7)])
    assert rows(interactions.keep_recent(p, 2), "item_id") == [(1,), (3,)]


def test_pairs_reach_depth_three(spark):
    e = log(spark, [(1, i, i * 60_000, 1) for i in range(1, 6)])
    found = rows(covisit.user_pairs(e), "item_a", "item_b")
    assert (1, 4) in found and (1, 5) not in found


def test_pairs_repeats_use_up_depth(spark):
    same = log(spark, [(1, 1, t, 1) for t in range(4)] + [(1, 2, 4, 1)])
    assert rows(covisit.user_pairs(same)) == [(1, 1, 2)]
    assert rows(covisit.user_pairs(log(spark, [(1, 1, t, 1) for t in range(3)]))) == []


def test_pairs_gap_is_inclusive_and_users_stay_apart(spark):
    e = log(spark, [(1, 1, 0, 1), (1, 2, DAY, 1), (1, 3, DAY + 1, 1), (2, 9, DAY + 2, 1)])
    assert rows(covisit.user_pairs(e)) == [(1, 1, 2), (1, 2, 3)]


@pytest.mark.parametrize("gap,depth", [(10, 3), (25, 1), (0, 4)])
def test_a_heavy_users_pairs_equal_brute_force(spark, gap, depth):
    rng = np.random.default_rng(gap)
    data = [(int(u), int(i), int(t), 1) for u, i, t in zip(rng.choice([1, 2, 3], 600, p=[0.8, 0.15, 0.05]), rng.integers(0, 9, 600), rng.integers(-50, 900, 600), strict=True)]
    want = set()
    for u in (1, 2, 3):
        own = sorted((t, i) for v, i, t, _ in data if v == u)
        for k, (t, i) in enumerate(own):
            want |= {(u, min(i, j), max(i, j)) for s, j in own[k + 1 : k + 1 + depth] if i != j and s - t <= gap}
    for heavy in (0, 60, 10_000):
        assert rows(covisit.user_pairs(log(spark, data), depth, gap, heavy)) == sorted(want)


def test_pair_threshold_counts_users(spark):
    e = log(spark, [(u, i, t, 1) for u in (1, 2, 3) for t, i in enumerate((1, 2))] + [(u, i, t + 10 * DAY, 1) for u in (1, 2) for t, i in enumerate((5, 6, 5, 6))])
    assert rows(covisit.pair_counts(covisit.user_pairs(e), 3)) == [(1, 2, 3)]


def test_neighbours_tie_and_matrix_is_symmetric(spark):
    edges = spark.createDataFrame([(1, 9, 4), (1, 8, 4), (1, 7, 4)], "item_id long, neighbor_id long, weight long")
    assert rows(covisit.top_neighbors(edges, 2), "neighbor_id", "neighbor_rank") == [(7, 1), (8, 2)]
    sym = rows(covisit.symmetrize(spark.createDataFrame([(1, 2, 3)], "item_a long, item_b long, weight long")))
    assert sym == [(1, 2, 3), (2, 1, 3)]


def item_table(spark):
    return spark.createDataFrame([(1, 0, 1, 1, 1), (2, 0, 1, 1, 1), (3, 1, 1, 1, 1), (5, 2, 1, 1, 1)], "item_id long, vertical_id int, category_ext_y int, region_id_y int, loc_id_y int")


def test_pool(spark):
    p = pairs(spark, [(1, 1, 1, 1), (2, 1, 1, 1), (1, 2, 1, 1), (1, 3, 1, 1), (2, 3, 1, 1), (1, 4, 1, 1), (2, 4, 1, 1)])
    assert rows(pool.allowed_items(item_table(spark), p)) == [(1,)]


def test_popularity_notions(spark):
    p = pairs(spark, [(1, 1, 9, 1), (1, 2, 1, 1), (2, 2, 1, 1), (3, 3, 50, 1)])
    allowed = spark.createDataFrame([(1,), (2,)], "item_id long")
    assert [tuple(r) for r in popularity.top_by_weight(p, allowed, 2).collect()] == [(1, 9), (2, 2)]
    assert [tuple(r) for r in popularity.top_by_users(p, item_table(spark), k=2).collect()] == [(2, 2), (1, 1)]


def test_seeds_and_scores(spark):
    p = pairs(spark, [(1, 1, 1, 1), (1, 2, 1, 2), (1, 3, 1, 3), (2, 1, 1, 1)])
    users = spark.createDataFrame([(1,)], "user_id long")
    seeds = candidates.seed_items(p, users, 2)
    assert rows(seeds) == [(1, 2), (1, 3)]
    matrix = spark.createDataFrame([(2, 7, 3, 1), (3, 7, 4, 1), (3, 8, 9, 2), (2, 1, 5, 2)], "item_id long, neighbor_id long, weight long, neighbor_rank int")
    allowed = spark.createDataFrame([(7,), (1,)], "item_id long")
    scores = candidates.covisit_scores(seeds, matrix, allowed)
    assert rows(scores) == [(1, 1, 5.0), (1, 7, 7.0)]
    top = candidates.covisit_top_n(scores, 2)
    assert rows(top, "item_id", "covisit_rank") == [(1, 1), (7, 0)]
    assert rows(candidates.exclude_seen(top, p), "item_id") == [(7,)]


def test_merge_flags_see_the_gaps(spark):
    a = spark.createDataFrame([(1, 1, 0.5, 0), (1, 2, -0.1, 1)], "user_id long, item_id long, als_score double, als_rank int")
    c = spark.createDataFrame([(1, 2, 3.0, 0), (1, 3, 2.0, 1)], "user_id long, item_id long, covisit_score double, covisit_rank int")
    merged = candidates.merge(a, c)
    assert rows(merged) == [(1, 1, 0.5, 0, 0.0, 999, True, False), (1, 2, -0.1, 1, 3.0, 0, True, True), (1, 3, 0.0, 999, 2.0, 1, False, True)]
    assert tuple(stats.source_overlap(merged).first()) == (1, 1, 1, 3, 1)


def test_cold_users_get_the_popular_list(spark):
    c = spark.createDataFrame([(1, 9, 1.0, 0)], "user_id long, item_id long, als_score double, als_rank int")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    top = spark.createDataFrame([(5, 10), (6, 20)], "item_id long, item_popularity long")
    out = candidates.add_popular_fallback(c, users, top)
    assert rows(out.filter("source = 'popular_fallback'"), "user_id", "item_id", "als_rank") == [(2, 5, 1), (2, 6, 0), (3, 5, 1), (3, 6, 0)]
    assert out.count() == 5


def test_fill_up(spark):
    c = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 2, 1)], "user_id long, item_id long, rank int")
    top = spark.createDataFrame([(1, 9), (3, 8), (4, 7)], "item_id long, item_popularity long")
    seen = spark.createDataFrame([(1, 3)], "user_id long, item_id long")
    assert rows(candidates.fill_up(c, top, seen, 2)) == [(1, 1, 0, False), (1, 4, 1, True), (2, 1, 0, False), (2, 2, 1, False)]


def test_fill_up_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    top = [(int(i), int(rng.integers(0, 30))) for i in range(120)]
    order = [i for i, _ in sorted(top, key=lambda r: (-r[1], r[0]))]
    own = {u: rng.choice(150, int(rng.integers(0, 8)), replace=False).tolist() for u in range(25)}
    seen = {u: set(rng.choice(150, int(rng.integers(0, 120)), replace=False).tolist()) for u in range(0, 30, 2)}
    frame = lambda r, s: spark.createDataFrame(r, s)
    c = frame([(u, int(i), r) for u, v in own.items() for r, i in enumerate(v)], "user_id long, item_id long, rank int")
    s = frame([(u, int(i)) for u, v in seen.items() for i in v], "user_id long, item_id long")
    listed = frame([(u,) for u in range(20, 32)], "user_id long")
    for n, users in ((6, None), (6, listed), (200, listed)):
        want = []
        for u in range(20, 32) if users is not None else sorted(u for u, v in own.items() if v):
            mine = own.get(u, [])[:n]
            more = [i for i in order if i not in mine and i not in seen.get(u, set())][: n - len(mine)]
            want += [(u, i, p, p >= len(mine)) for p, i in enumerate(mine + more)]
        assert rows(candidates.fill_up(c, frame(top, "item_id long, item_popularity long"), s, n, users)) == sorted(want)


def test_fill_up_draws_from_the_favourite_group_first(spark):
    rng = np.random.default_rng(12)
    top = [(i, int(rng.integers(0, 30))) for i in range(60)]
    group = {i: [None, 1, 2, 3][i % 4] for i in range(58)}
    own = {u: rng.choice(80, int(rng.integers(0, 5)), replace=False).tolist() for u in range(20)}
    seen = {u: set(rng.choice(80, int(rng.integers(0, 50)), replace=False).tolist()) for u in range(20)}
    liked = {u: u % 5 for u in range(15)}  # some like a group that no item is in
    frame = lambda r, s: spark.createDataFrame(r, s)
    got = candidates.fill_up(
        frame([(u, int(i), r) for u, v in own.items() for r, i in enumerate(v)], "user_id long, item_id long, rank int"), frame(top, "item_id long, item_popularity long"),
        frame([(u, int(i)) for u, v in seen.items() for i in v], "user_id long, item_id long"), 12, frame([(u,) for u in range(20)], "user_id long"),
        frame(list(liked.items()), "user_id long, group int"), frame(list(group.items()), "item_id long, group int"),
    )
    want = []
    for u in range(20):
        free = [i for i, _ in sorted(top, key=lambda r: (group.get(r[0]) is None or group.get(r[0]) != liked.get(u), -r[1], r[0])) if i not in own[u] and i not in seen[u]]
        want += [(u, i, p, p >= len(own[u])) for p, i in enumerate((own[u] + free)[:12])]
    assert rows(got) == sorted(want)


def test_nothing_of_a_long_history_comes_back(spark):
    """150 items seen, far more than the capped history holds, some long before the window."""
    e = log(spark, [(1, i, (i - 100) * DAY + H, 1) for i in range(150)] + [(2, i, H, 1) for i in range(155)] + [(1, 152, H, 7)])
    seen = interactions.touched(e, 200 * DAY)
    assert {r.item_id for r in seen.filter("user_id = 1").collect()} == set(range(150))
    found = spark.createDataFrame([(1, i, float(i)) for i in range(155)], "user_id long, item_id long, s double")
    assert sorted(r.item_id for r in candidates.exclude_seen(found, seen).collect()) == [150, 151, 152, 153, 154]
    popular = spark.createDataFrame([(i, 1000 - i) for i in range(155)], "item_id long, item_popularity long")
    none = spark.createDataFrame([], "user_id long, item_id long, rank int")
    assert [r[1] for r in rows(candidates.fill_up(none, popular, seen, 4, seen.filter("user_id = 1")))] == [150, 151, 152, 153]


def test_features_keep_gaps(spark):
    c = spark.createDataFrame([(1, 1, 0.5, 0, "als"), (1, 77, 0.4, 1, "als"), (2, 1, 0.0, 0, "popular_fallback")], "user_id long, item_id long, als_score double, als_rank int, source string")
    p = pairs(spark, [(1, 1, 3, 1)])
    targets = spark.createDataFrame([(1, 1), (1, 1)], "user_id long, item_id long")
    out = features.build_single(c, item_table(spark), popularity.item_popularity(p), features.user_top_vertical(p, item_table(spark)), targets)
    got = rows(out, "user_id", "item_id", "is_cold", "vertical_id", "item_popularity", "user_top_vertical_match", "target")
    assert got == [(1, 1, 0, 0, 3, 1, True), (1, 77, 0, None, 0, None, False), (2, 1, 1, 0, 3, None, False)]


def test_recall(spark):
    p = spark.createDataFrame([(1, 1, 1.0), (2, 1, 1.0), (3, 9, 1.0)], "user_id long, item_id long, s double")
    t = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 1), (4, 1)], "user_id long, item_id long")
    assert tuple(evaluate.recall_at_k(p, "s", t).first()) == (0.5, 3)
    assert tuple(evaluate.recall_at_k(p, "s", t.union(t), users=t).first()) == (0.375, 4)
    perfect = t.selectExpr("user_id", "item_id", "1.0 s")
    assert evaluate.recall_at_k(perfect, "s", t).first()[0] == 1.0


def test_retrieval_recall_is_over_pairs(spark):
    t = spark.createDataFrame([(1, 1)] + [(2, i) for i in range(9)], "user_id long, item_id long")
    p = spark.createDataFrame([(1, 1, True, False)], "user_id long, item_id long, in_als boolean, in_covisit boolean")
    assert tuple(evaluate.retrieval_recall(p, t).first()) == (10, 1, 1, 0, 0.1)


def test_holdout(spark):
    at = 10 * DAY
    e = log(spark, [(1, 1, at, 20), (1, 2, at - 1, 1), (1, 2, at + 1, 20), (1, 3, at + 1, 1), (1, 4, at + 7 * DAY, 20)])
    assert rows(evaluate.holdout_targets(e, contacts(spark), at)) == [(1, 1)]


def test_balance(spark):
    s = spark.createDataFrame([(1, i, float(10 - i)) for i in (1, 2, 3, 5, 6, 7)], "user_id long, item_id long, rank_score double")
    items = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (5, 1), (6, 0), (7, 1)], "item_id long, vertical_id int")
    for k, want in ((4, [1, 2, 5, 7]), (5, [1, 2, 5, 7, 3])):
        got = ranking.balance_by_vertical(s, items, k, quota=2)
        assert [r.item_id for r in got.orderBy("pos").collect()] == want


def test_fold_in_of_a_training_user_is_the_stored_factor(spark):
    rng = np.random.default_rng(3)
    data = [(int(u), int(i), int(w)) for u in range(30) for i, w in zip(rng.choice(20, 6, replace=False), rng.integers(1, 6, 6))]
    enc = spark.createDataFrame(data, "user_idx int, item_idx int, weight int")
    model = als.fit(enc, rank=4, iterations=4)
    got = {r.user_id: r.features for r in als.fold_in(enc.selectExpr("cast(user_idx as long) user_id", "item_idx item_id", "weight"), model.itemFactors).collect()}
    for r in model.userFactors.collect():
        assert np.allclose(got[r.id], r.features, atol=1e-4)


@pytest.mark.parametrize("how", [{}, {"parts": 3, "block": 2, "head": 1}, {"parts": 1, "block": 3, "head": 2}, {"parts": 4, "block": 1, "head": 3}])
def test_score_blocks_equal_brute_force(spark, how):
    rng = np.random.default_rng(1)
    u, v = rng.integers(-2, 3, (7, 3)).astype(float), rng.integers(-2, 3, (11, 3)).astype(float)
    frame = lambda m: spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "id long, features array<float>")
    got = rows(als.score_top_n(frame(u), frame(v), None, 4, **how), "user_id", "als_rank", "item_id", "als_score")
    s = u @ v.T
    want = sorted((i, r, int(j), s[i, j]) for i in range(7) for r, j in enumerate(sorted(range(11), key=lambda j: (-s[i, j], j))[:4]))
    assert got == want


def test_running_best_keeps_the_smaller_ids_of_ties():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n, m = int(rng.integers(1, 6)), int(rng.integers(1, 15))
        scores, ids = rng.integers(0, 4, (3, m)).astype(float), np.stack([rng.permutation(m) for _ in range(3)])
        s, i = als.best_of(scores, ids, n)
        for row in range(3):
            want = sorted(zip(-scores[row], ids[row]))[:n]
            assert sorted(zip(-s[row], i[row])) == want


def test_scoring_takes_empty_tables(spark):
    f = spark.createDataFrame([(1, [1.0, 2.0])], "id long, features array<float>")
    h = spark.createDataFrame([(1, 1, 3)], "user_id long, item_id long, weight int")
    assert als.fold_in(h, f.limit(0)).count() == 0 and als.fold_in(h.limit(0), f).count() == 0
    assert als.score_top_n(f.limit(0), f).count() == 0 and als.score_top_n(f, f.limit(0)).count() == 0
    assert als.recommend_from_history(h, f.limit(0), None).count() == 0
    assert als.score_top_n(f.limit(0), f, head=0).count() == 0
    assert [r[:2] + r[2:] for r in rows(als.score_top_n(f, f, None, 4, parts=3, block=1), "user_id", "item_id", "als_score", "als_rank")] == [(1, 1, 5.0, 0)]


def falling(rng, n, width):
    """Factors whose lengths fall fast, as those of items of falling popularity do."""
    return (rng.normal(size=(n, width)) * (1 + 8 / (1 + np.arange(n)))[:, None]).astype(np.float32)


def test_pruned_scoring_is_exact_and_skips_blocks(spark):
    rng = np.random.default_rng(6)
    u, v = rng.normal(size=(90, 8)).astype(np.float32), falling(rng, 3000, 8)
    u[5] = 0
    frame = lambda m: spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "id long, features array<float>")
    how = {"n": 7, "parts": 5, "block": 40, "head": 2}
    got = rows(als.score_top_n(frame(u), frame(v), **how), "user_id", "als_rank", "item_id", "als_score")
    s = u.astype(float) @ v.astype(float).T
    want = [(i, r, int(j)) for i in range(90) for r, j in enumerate(sorted(range(3000), key=lambda j: (-s[i, j], j))[:7])]
    assert [g[:3] for g in got] == want and all(g[3] == pytest.approx(s[g[0], g[2]]) for g in got)
    share = als.pruned_share(frame(u), frame(v), **how).first()
    assert 0 < share.scored < share.all_pairs


def test_fold_in_and_scoring_of_wide_factors_equal_brute_force(spark):
    """64 numbers a factor: every user's equations solved and all items scored one by one."""
    rng = np.random.default_rng(9)
    y = (rng.normal(size=(200, 64)) / 8).astype(np.float32)
    h = [(u, int(i), int(rng.integers(1, 9))) for u in range(30) for i in rng.choice(220, int(rng.integers(1, 40)), replace=False)]
    history = spark.createDataFrame(h, "user_id long, item_id long, weight int")
    factors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id long, features array<float>")
    pool_ = spark.createDataFrame([(i,) for i in range(0, 200, 2)], "item_id long")
    z, want = y.astype(float), []
    for user in range(30):
        known = [(i, w) for u, i, w in h if u == user and i < 200]
        if known:
            left = z.T @ z + sum(w * np.outer(z[i], z[i]) for i, w in known) + 0.1 * len(known) * np.eye(64)
            x = np.linalg.solve(left, sum((1 + w) * z[i] for i, w in known)).astype(np.float32).astype(float)
            want += [(user, r, int(j), x @ z[j]) for r, j in enumerate(sorted(range(0, 200, 2), key=lambda j: (-(x @ z[j]), j))[:10])]
    got = rows(als.recommend_from_history(history, factors, pool_, 10), "user_id", "als_rank", "item_id", "als_score")
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-5)


def test_training_loss_is_that_of_all_cells_and_falls(spark):
    rng = np.random.default_rng(4)
    data = [(int(u), int(i), int(w)) for u in range(20) for i, w in zip(rng.choice(15, 5, replace=False), rng.integers(1, 6, 5))]
    enc = spark.createDataFrame(data, "user_idx int, item_idx int, weight int")
    losses = []
    for iterations in (1, 3, 9):
        model = als.fit(enc, rank=3, iterations=iterations)
        x, y = ({r.id: np.array(r.features, float) for r in f.collect()} for f in (model.userFactors, model.itemFactors))
        w = {(u, i): c for u, i, c in data}
        loss = sum((1 + w.get((u, i), 0)) * ((1.0 if (u, i) in w else 0.0) - x[u] @ y[i]) ** 2 for u in x for i in y)
        loss += 0.1 * sum(x[u] @ x[u] + y[i] @ y[i] for u, i, _ in data)
        got = als.training_loss(enc, model.userFactors, model.itemFactors).first()
        assert got.loss == pytest.approx(loss)
        losses.append(got.loss)
    assert losses[0] > losses[1] > losses[2]
    assert als.training_loss(enc.limit(0), model.userFactors.limit(0), model.itemFactors).first().loss == 0


def test_fold_in_equals_the_closed_form(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=(6, 2)).astype(np.float32)
    h = [(1, 0, 2), (1, 3, 5), (2, 5, 1), (2, 99, 4)]
    got = {r.user_id: r.features for r in als.fold_in(spark.createDataFrame(h, "user_id long, item_id long, weight int"), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id long, features array<float>"), reg=0.2, alpha=0.5).collect()}
    y = y.astype(float)
    for user in (1, 2):
        known = [(i, 0.5 * w) for u, i, w in h if u == user and i < 6]
        left = y.T @ y + sum(w * np.outer(y[i], y[i]) for i, w in known) + 0.2 * len(known) * np.eye(2)
        assert np.allclose(got[user], np.linalg.solve(left, sum((1 + w) * y[i] for i, w in known)), atol=1e-5)


def test_ranker_splits_categories_as_such(spark):
    """Only odd categories have positives: numbers in order could not tell them in one split."""
    data = [(u, i, 0.0, 1.0, i % 40 if i % 7 else None, 0, 0, 0, 0, 0, 0, None, bool(i % 7 and i % 40 % 2)) for u in range(20) for i in range(60)]
    cols = "user_id long, item_id long, als_score double, covisit_score double, category_ext_y int, vertical_id int, region_id_y int, loc_id_y int, in_als int, item_popularity long, item_n_users long, user_top_vertical_match int, target boolean"
    table = spark.createDataFrame(data, cols).withColumn("n_leak", F.col("target").cast("double"))
    model = ranking.fit(table, rounds=1, depth=1)
    first = ranking.importances(model, spark).first()
    assert (first.feature, round(first.importance, 6)) == ("category_ext_y", 100.0)
    got = ranking.score(model, table).collect()
    assert min(r.rank_score for r in got if r.target) > max(r.rank_score for r in got if not r.target)
    got = ranking.score_pointwise(ranking.fit_pointwise(table, rounds=1, depth=1), table).collect()
    assert min(r.rank_score for r in got if r.target) > max(r.rank_score for r in got if not r.target)


def test_popular_list_of_any_length_is_refused(spark, monkeypatch):
    monkeypatch.setattr(candidates, "LONGEST", 3)
    users = spark.createDataFrame([(1,)], "user_id long")
    none = spark.createDataFrame([], "user_id long, item_id long, als_score double, als_rank int")
    top = spark.createDataFrame([(i, 9 - i) for i in range(4)], "item_id long, item_popularity long")
    assert candidates.add_popular_fallback(none, users, top.limit(3)).count() == 3
    with pytest.raises(Exception, match="over 3 rows"):
        candidates.add_popular_fallback(none, users, top).collect()


def test_dense_index_and_lookup(spark):
    df = spark.createDataFrame([(x,) for x in (50, 7, 7, 1000, -3)], "item_id long")
    index = ids.dense_index(df, "item_id")
    assert rows(index) == [(-3, 0), (7, 1), (50, 2), (1000, 3)]
    found, dropped = ids.lookup(spark.createDataFrame([(7,), (8,)], "item_id long"), index, "item_id")
    assert rows(found) == [(7, 1)] and dropped.first()[0] == 1


def test_split_keeps_users_whole(spark):
    df = spark.range(400).selectExpr("id % 100 as user_id", "id as item_id")
    train, val = ranking.split_by_user(df)
    a, b = {r.user_id for r in train.collect()}, {r.user_id for r in val.collect()}
    assert not a & b and len(a | b) == 100 and 5 < len(b) < 40


def test_history_quantiles_and_histogram(spark):
    e = log(spark, [(u, i, i, 1) for u in range(1, 12) for i in range(u)])
    got = dict(rows(stats.history_quantiles(e, (0.0, 0.5, 1.0))))
    assert got == {0.0: 1, 0.5: 6, 1.0: 11}
    assert sum(r.n_users for r in stats.history_histogram(e, bins=5, upper_q=1.0).collect()) == 11
    single = log(spark, [(1, 1, 1, 1)])
    assert rows(stats.history_histogram(single, upper_q=1.0)) == [(0, 1)]


def test_csv_and_submission(spark, tmp_path):
    (tmp_path / "u.csv").write_text("user_id\n5\n6\n")
    assert rows(io.read_ids(spark, str(tmp_path / "u.csv"), "user_id")) == [(5,), (6,)]
    (tmp_path / "t.csv").write_text("user_id,item_id\n5,1\n")
    assert rows(io.read_targets(spark, str(tmp_path / "t.csv"))) == [(5, 1)]
    ranked = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9), (1, 2, 0.8), (1, 3, 0.5)], "user_id long, item_id long, rank_score double")
    io.write_submission(ranked, str(tmp_path / "out"), k=2)
    lines = [x for f in os.listdir(tmp_path / "out") if f.endswith(".csv") for x in (tmp_path / "out" / f).read_text().split()]
    assert lines[0] == "user_id,item_id" and sorted(lines[1:]) == ["1,2", "1,3"]
    io.write_stage(ranked, str(tmp_path / "stage"))
    assert spark.read.parquet(str(tmp_path / "stage")).count() == 4


def test_ranker_prefers_the_telling_feature(spark):
    rng = np.random.default_rng(5)
    data = []
    for u in range(60):
        for i in range(10):
            x = float(rng.random())
            data.append((u, i, x, 1, 0.0, 999, True, False, x > 0.8))
    m = spark.createDataFrame(data, "user_id long, item_id long, als_score double, als_rank int, covisit_score double, covisit_rank int, in_als boolean, in_covisit boolean, t boolean")
    empty = pairs(spark, [(1, 1, 1, 1)])
    table = features.build_merged(m.drop("t"), item_table(spark), popularity.item_popularity(empty), features.user_top_vertical(empty, item_table(spark)), m.filter("t"))
    train, val = ranking.split_by_user(table)
    model = ranking.fit(train, val, rounds=6, depth=3, rate=0.3, k=5)
    assert ranking.importances(model, spark).first().feature == "als_score"
    recall = evaluate.recall_at_k(ranking.score(model, val), "rank_score", m.filter("t"), k=5).first()[0]
    assert recall > 0.9 and not math.isnan(recall)


def test_sketched_pair_counts_equal_the_exact_ones(spark):
    """Also with a sketch so small that most cells are shared, and with ids of any sign."""
    rng = np.random.default_rng(3)
    p = spark.createDataFrame([(u, int(a), int(b)) for u in range(60) for a, b in rng.integers(-15, 15, (40, 2))], "user_id long, item_a long, item_b long").distinct().repartition(5)
    want = rows(covisit.pair_counts(p, 3))
    for width in (1 << 16, 50):
        assert rows(covisit.pair_counts_sketched(p, 3, width)) == want and want
    bounds = covisit.sketch(p, 1 << 16)
    counts = {r[:2]: r[2] for r in map(tuple, covisit.pair_counts(p, 1).collect())}
    assert covisit.frequent(p, bounds, 3).count() <= sum(n for n in counts.values() if n >= 3) + 20
    assert covisit.pair_counts_sketched(p.limit(0), 3).count() == 0


def test_bucketed_log_needs_no_exchange_on_the_user(spark):
    e = log(spark, [(u, i, (u * 7 + i) * H, 20 if i % 5 else 1) for u in range(30) for i in range(8)])
    b = io.bucketed(e, "log", 3)
    assert rows(b) == rows(e)
    weighted = ev.with_weight(b, contacts(spark))
    for made, plain in (
        (interactions.aggregate(weighted), interactions.aggregate(ev.with_weight(e, contacts(spark)))),
        (interactions.keep_recent(interactions.aggregate(weighted), 3), interactions.keep_recent(interactions.aggregate(ev.with_weight(e, contacts(spark))), 3)),
        (covisit.user_pairs(b), covisit.user_pairs(e)),
    ):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(user_id" not in plan, plan
        assert rows(made) == rows(plain)


def test_bootstrap_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    preds = [(u, i, float(rng.random()), float(rng.random())) for u in range(40) for i in range(12)]
    targets = [(u, int(i)) for u in range(5, 50) for i in rng.choice(12, 2, replace=False)]
    got = evaluate.bootstrap(spark.createDataFrame(preds, "user_id long, item_id long, a double, b double"), ["a", "b"], spark.createDataFrame(targets, "user_id long, item_id long"), 4, replicates=50).first()
    recall = {}
    for u in range(5, 40):
        for c in (2, 3):
            top = {p[1] for p in sorted((p for p in preds if p[0] == u), key=lambda p: (-p[c], p[1]))[:4]}
            recall[u, c] = len(top & {i for v, i in targets if v == u}) / 2
    limits = [sum(math.exp(-1) / math.factorial(j) for j in range(n + 1)) * 2**32 for n in range(12)]

    def weight(u, r):
        x = int(hashlib.md5(f"42:{u}:{r}".encode()).hexdigest()[:8], 16)
        return sum(x >= int(v) for v in limits)

    gains = []
    for r in range(1, 51):
        w = {u: weight(u, r) for u in range(5, 40)}
        gains.append(sum(w[u] * (recall[u, 3] - recall[u, 2]) for u in w) / sum(w.values()))
    gains.sort()
    assert got.gain == pytest.approx(np.mean([recall[u, 3] - recall[u, 2] for u in range(5, 40)]))
    assert (got.low, got.high) == (pytest.approx(gains[1]), pytest.approx(gains[-2])) and got.better == pytest.approx(np.mean(np.array(gains) > 0))
    assert abs(np.mean([weight(u, r) for u in range(100) for r in range(100)]) - 1) < 0.05


def test_semantic_ids_find_items_that_nobody_visited_together(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 10)) * 4
    x = np.array([centre[i % 6] + 0.2 * rng.normal(size=10) for i in range(180)])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, features array<double>")
    books = semantic.fit_codebooks(vectors, levels=3, codes=6)
    codes = {r.item_id: tuple(r)[1:] for r in semantic.encode(vectors, books).collect()}
    for i, v in enumerate(x):
        rest, want = v.copy(), []
        for b in books:
            k = int(((rest - b) ** 2).sum(1).argmin())
            want.append(k)
            rest = rest - b[k]
        assert codes[i] == tuple(want)
    h = [(u, int(i), int(rng.integers(1, 4))) for u in range(6) for i in rng.choice(range(u % 3, 90, 3), 5, replace=False)]
    pop = {i: int(rng.integers(0, 5)) for i in range(0, 180, 2)}
    allowed = [i for i in range(180) if i % 5]
    frame = lambda r, s: spark.createDataFrame(r, s)
    for least, n in ((1, 7), (2, 200)):
        got = semantic.prefix_candidates(frame(h, "user_id long, item_id long, weight int"), semantic.encode(vectors, books), frame(list(pop.items()), "item_id long, item_popularity long"), frame([(i,) for i in allowed], "item_id long"), 3, least, n)
        want = []
        for u in range(6):
            score = {i: sum(w for k in range(least, 4) for v, j, w in h if v == u and codes[j][:k] == codes[i][:k]) for i in allowed}
            top = sorted((i for i in allowed if score[i]), key=lambda i: (-score[i], -pop.get(i, -1), i))[:n]
            want += [(u, i, float(score[i]), r) for r, i in enumerate(top)]
        assert rows(got) == sorted(want)
    matrix = frame([(1, 7, 3)], "item_id long, neighbor_id long, weight long")
    assert {r.item_id for r in got.collect()} - {r.item_id for r in semantic.uncovered(got, matrix).collect()} <= {7}


def test_no_single_partition_window_or_cartesian_product(spark):
    e = log(spark, [(1, 1, 1, 1)])
    plan = covisit.build(e)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan


def test_stream_adds_up_to_the_batch(spark, tmp_path):
    from listrec.streaming.interactions import daily_interactions

    e = log(spark, [(1, 1, H, 1), (1, 1, 2 * H, 20), (1, 1, 3 * H, 7), (2, 1, DAY + H, 1), (9, 9, 9 * DAY, 1)])
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = daily_interactions(stream, contacts(spark)).writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("daily"), "user_id", "item_id", "weight", "last_timestamp") == [(1, 1, 6, 2 * H), (2, 1, 1, DAY + H), (9, 9, 1, 9 * DAY)]
