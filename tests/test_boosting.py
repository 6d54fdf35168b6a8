"""The listwise ranker against a version in numpy, and its target statistics, importances and files."""

import hashlib
import itertools

import numpy as np
import pytest

from listrec.operators import boosting, evaluate, ranking, target_stats

SCHEMA = "user_id long, item_id long, target boolean, a double, b double, c int"
NUMBERS, CATEGORIES = ["a", "b"], ["c"]


def lists(seed=0, users=40, length=12):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(users):
        for i in rng.permutation(100)[:length].tolist():
            a, b, c = float(rng.integers(0, 9)), float(rng.normal()), int(rng.integers(0, 5))
            p = 1 / (1 + np.exp(3 - 0.5 * a - 0.8 * b - (c == 2)))
            rows.append((u, i, bool(rng.random() < p * 0.6), None if rng.random() < 0.1 else a, b, None if c == 4 else c))
    return rows


def statistics_by_force(rows, prior, weight=1.0, seed=42):
    at = lambda r: (hashlib.md5(f"{seed}:{r[0]}:{r[1]}".encode()).hexdigest(), r[0], r[1])
    seen, out = {}, {}
    for r in sorted(rows, key=at):
        t, n = seen.get(r[5], (0, 0))
        out[r[0], r[1]] = (t + weight * prior) / (n + weight)
        seen[r[5]] = t + r[2], n + 1
    return out, {c: (t + weight * prior) / (n + weight) for c, (t, n) in seen.items()}


def test_ordered_statistics_see_only_earlier_rows(spark):
    rows = lists()
    df, prior = spark.createDataFrame(rows, SCHEMA), float(np.mean([r[2] for r in rows]))
    before, whole = statistics_by_force(rows, prior)
    got = {(r.user_id, r.item_id): r.ts_c for r in target_stats.ordered(df, CATEGORIES, prior).collect()}
    assert got.keys() == before.keys() and all(got[k] == pytest.approx(before[k], abs=1e-12) for k in got)
    stats = target_stats.whole(df, CATEGORIES, prior)
    new = spark.createDataFrame([(1, 1, 0.0, 0.0, 2), (1, 2, 0.0, 0.0, None), (1, 3, 0.0, 0.0, 77)], "user_id long, item_id long, a double, b double, c int")
    got = {r.item_id: r.ts_c for r in target_stats.with_whole(new, stats, CATEGORIES, prior).collect()}
    assert got == pytest.approx({1: whole[2], 2: whole[None], 3: prior})


def trees_by_force(groups, borders, rounds, depth, rate, l2, k):
    """(splits, leaf values) of each tree, one row and one pair at a time."""
    x = np.array([r[0] for g in groups for r in g])
    bins = np.array([[0 if np.isnan(v) else 1 + sum(v > q for q in borders[f]) for f, v in enumerate(row)] for row in x])
    score, out = np.zeros(len(x)), []
    for _ in range(rounds):
        g, h, s = np.zeros(len(x), object), np.zeros(len(x), object), 0
        for group in groups:
            e = s + len(group)
            place = {i: p for p, i in enumerate(sorted(range(s, e), key=lambda i: (-score[i], i)))}
            gain = lambda i: 1 / np.log2(place[i] + 2) if place[i] < k else 0.0  # noqa: E731, B023
            y = {i: group[i - s][1] for i in range(s, e)}
            best = sum(1 / np.log2(p + 2) for p in range(min(k, sum(y.values()))))
            sums = {i: [0.0, 0.0] for i in range(s, e)}
            for i, j in itertools.permutations(range(s, e), 2):
                if y[i] and not y[j]:
                    d, rho = abs(gain(i) - gain(j)) / best, 1 / (1 + np.exp(score[i] - score[j]))
                    sums[i][0] += d * rho
                    sums[j][0] -= d * rho
                    sums[i][1] += d * rho * (1 - rho)
                    sums[j][1] += d * rho * (1 - rho)
            for i, (p, q) in sums.items():
                g[i], h[i] = round(p * boosting.FIXED), round(q * boosting.FIXED)
            s = e
        leaves, splits = [(np.arange(len(x)), 0.0)], []
        worth = lambda rows: (sum(g[rows]) / boosting.FIXED) ** 2 / (sum(h[rows]) / boosting.FIXED + l2)  # noqa: E731, B023
        for _ in range(depth):
            grown = []
            for rows, value in leaves:
                best = None
                for f in range(bins.shape[1]):
                    for b in range(bins[:, f].max() + 1):
                        low, high = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                        if len(low) and len(high):
                            won = worth(low) + worth(high) - worth(rows)
                            if won > 1e-9 and (best is None or won > best[0] + 1e-15):
                                best = won, f, b, low, high
                if best is None:
                    grown.append((rows, value))
                    continue
                splits.append(best[1:3])
                grown += [(part, rate * (sum(g[part]) / boosting.FIXED) / (sum(h[part]) / boosting.FIXED + l2)) for part in best[3:]]
            leaves = grown
        for rows, value in leaves:
            score[rows] += value
        out.append((splits, sorted(v for _, v in leaves)))
    return out


def test_trees_equal_a_version_without_spark(spark):
    rows, rounds, depth, rate, l2, k = lists(1, 25, 8), 7, 3, 0.3, 1.0, 5
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    model = boosting.fit(df, None, NUMBERS, CATEGORIES, rounds, depth, rate, l2, 16, k, every=3)
    prior = float(np.mean([r[2] for r in rows]))
    before, _ = statistics_by_force(rows, prior)
    groups = []
    for u in sorted({r[0] for r in rows}):
        own = [r for r in sorted(rows, key=lambda r: r[1]) if r[0] == u]
        if any(r[2] for r in own):
            groups.append([([np.nan if r[3] is None else r[3], r[4], before[u, r[1]]], r[2]) for r in own])
    want = trees_by_force(groups, model.borders, rounds, depth, rate, l2, k)
    assert len(model.trees) == rounds
    for t, (splits, leaves) in zip(model.trees, want, strict=True):
        assert sorted((f, b) for f, b in zip(t.feature, t.bin, strict=True) if f >= 0) == sorted(splits)
        assert sorted(v for f, v in zip(t.feature, t.value, strict=True) if f < 0) == pytest.approx(leaves, abs=1e-12)


def test_best_round_is_that_of_a_fit_for_each_round(spark):
    train, val = spark.createDataFrame(lists(2), SCHEMA), spark.createDataFrame(lists(3), SCHEMA)
    more = {"numbers": NUMBERS, "categories": CATEGORIES, "depth": 2, "rate": 0.5, "bins": 16, "k": 3, "every": 2}
    model = boosting.fit(train, val, rounds=5, **more)
    assert len(model.staged) == 6 and len(model.trees) == int(np.argmax(model.staged))
    for rounds in (1, 3, 5):
        other = boosting.fit(train, None, rounds=rounds, **more)
        scored = boosting.score(other, val).collect()
        total = []
        for u in {r.user_id for r in scored}:
            own = sorted((r for r in scored if r.user_id == u), key=lambda r: (-r.rank_score, r.item_id))
            hits = [p for p, r in enumerate(own) if r.target]
            if hits:
                total.append(sum(1 / np.log2(p + 2) for p in hits if p < 3) / sum(1 / np.log2(p + 2) for p in range(min(3, len(hits)))))
        assert np.mean(total) == pytest.approx(model.staged[rounds], abs=1e-7)
        assert other.trees[: len(model.trees)] == model.trees[:rounds]


def importances_by_force(rows):
    nodes = {(r.tree, r.node): r for r in rows}

    def mean(t, n):
        r = nodes[t, n]
        if r.feature is None:
            return r.value, r["rows"]
        (v, a), (w, b) = mean(t, r.left), mean(t, r.right)
        return (v * a + w * b) / (a + b), a + b

    out = {}
    for (t, _), r in nodes.items():
        if r.feature is not None:
            (v, a), (w, b) = mean(t, r.left), mean(t, r.right)
            m = (v * a + w * b) / (a + b)
            out[r.feature] = out.get(r.feature, 0) + a * (v - m) ** 2 + b * (w - m) ** 2
    return {f: 100 * c / sum(out.values()) for f, c in out.items()}


def test_importances_files_and_empty_input(spark, tmp_path):
    train, val = spark.createDataFrame(lists(4), SCHEMA), spark.createDataFrame(lists(5), SCHEMA)
    model = boosting.fit(train, None, NUMBERS, CATEGORIES, 4, 3, 0.3, bins=16)
    trees = boosting.trees_table(model, spark)
    got = {r.feature: r.importance for r in boosting.importances(trees).collect()}
    assert got == pytest.approx(importances_by_force(trees.collect())) and sum(got.values()) == pytest.approx(100)
    assert boosting.importances(trees.limit(0)).count() == 0
    boosting.save(model, spark, str(tmp_path / "m"))
    again = boosting.load(spark, str(tmp_path / "m"))
    assert again.trees == model.trees and again.features == model.features
    assert sorted(map(tuple, boosting.score(again, val).collect())) == sorted(map(tuple, boosting.score(model, val).collect()))
    none = boosting.fit(train.limit(0), None, NUMBERS, CATEGORIES, 3, 2)
    assert none.trees == [] and {r.rank_score for r in boosting.score(none, val).collect()} == {0.0}


def test_listwise_finds_more_than_pointwise(spark):
    """What to find depends on the list: users differ in level, and only the top of each list counts."""
    rng = np.random.default_rng(8)

    def rows(users):
        out = []
        for u in users:
            level = rng.normal() * 3
            n = 25
            a = rng.normal(size=n) + level
            b = rng.normal(size=n)
            top = np.argsort(-(a + 0.7 * b + 0.5 * rng.normal(size=n)))[: int(rng.integers(1, 4))]
            out += [(u, i, i in set(top.tolist()), float(a[i]), float(b[i]), 1) for i in range(n)]
        return out

    train, val = (spark.createDataFrame(rows(range(*r)), SCHEMA) for r in ((0, 120), (200, 320)))
    model = boosting.fit(train, None, NUMBERS, [], 15, 3, 0.3, bins=32, k=3)
    point = ranking.fit_pointwise(train, rounds=15, depth=3, numbers=NUMBERS, categories=[])
    targets = val.filter("target").select("user_id", "item_id")
    recall = [evaluate.recall_at_k(s, "rank_score", targets, 3).first().recall for s in (boosting.score(model, val), ranking.score_pointwise(point, val))]
    assert recall[0] > recall[1]
