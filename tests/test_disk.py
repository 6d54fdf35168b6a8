"""What stays on disk: shuffle files and intermediate stages go when they are not read any more."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from listrec.functions import events as ev
from listrec.jobs import recommend
from listrec.operators import als, als_blocks, interactions
from listrec.sources import adapters as ad
from listrec.sources import io

DATA = "/root/testdata/sf0.001"


def shuffled(spark):
    """The shuffle files of the session."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def ratings(spark, seed=11, users=60, items=45, each=9):
    rng = np.random.default_rng(seed)
    data = [(1000 + int(u), int(i) * 7, int(w)) for u in range(users) for i, w in zip(rng.choice(items, each, replace=False), rng.integers(1, 6, each))]
    return data, spark.createDataFrame(data, "user_id long, item_id long, weight int")


def test_a_stage_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    sums = io.staged(spark.range(20_000).groupBy((F.col("id") % 500).alias("k")).agg(F.count("*").alias("n")), "sums")
    for _ in range(50):  # files go in the background
        if not shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffled(spark) - before and sums.count() == 500


def test_training_leaves_no_shuffle_files(spark):
    _, df = ratings(spark)
    encoded = io.staged(df.selectExpr("cast(user_id as int) user_idx", "cast(item_id as int) item_idx", "weight"), "encoded")
    before = shuffled(spark)
    als.fit(encoded, rank=4, iterations=4)
    assert len(shuffled(spark) - before) <= 8  # those of one count


@pytest.mark.parametrize("how", [{}, {"most": 100, "at_once": 2}, {"most": 60, "at_once": 20}])
def test_training_in_blocks_equals_dense_algebra(spark, how):
    data, df = ratings(spark)
    rank, reg, iterations = 5, 0.1, 3
    model = als_blocks.train(io.staged(df, "ratings"), rank=rank, reg=reg, iterations=iterations, seed=5, **how)
    users, items = sorted({u for u, _, _ in data}), sorted({i for _, i, _ in data})
    w = np.zeros((len(users), len(items)))
    for u, i, v in data:
        w[users.index(u), items.index(i)] = v

    def solve(w, y):
        return np.array([np.linalg.solve(y.T @ y + (y * r[:, None]).T @ y + reg * (r > 0).sum() * np.eye(rank), ((1 + r) * (r > 0)) @ y) for r in w]).astype(np.float32).astype(float)

    x = als_blocks.first_factors(np.array(users), rank, 5).astype(float)
    for _ in range(iterations):
        y = solve(w.T, x)
        x = solve(w, y)
    for got, ids, want in ((model.userFactors, users, x), (model.itemFactors, items, y)):
        found = {r.id: r.features for r in got.collect()}
        assert sorted(found) == ids and np.allclose([found[i] for i in ids], want, atol=1e-4)


def test_ids_of_many_ratings_are_solved_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    lengths, y = np.array([3, 50, 3, 1, 50, 120], np.int32), rng.normal(size=(30, 4)).astype(np.float32)
    places, weights = rng.integers(0, 30, lengths.sum()).astype(np.int32), rng.choice([-2, 0, 1, 3], lengths.sum()).astype(np.float32)
    gram = y.astype(float).T @ y.astype(float)
    whole = als_blocks.solved(lengths, places, weights, y, gram, 0.1, 1.0)
    monkeypatch.setattr(als_blocks, "TOGETHER", 16)
    assert np.allclose(als_blocks.solved(lengths, places, weights, y, gram, 0.1, 1.0), whole, atol=1e-5)


def test_slices_of_users_give_the_same_lists_and_keep_no_candidates(spark):
    events, items, contacts = (io.staged(d, "t") for d in (ad.click_log(spark, DATA), ad.items(spark, DATA), ad.contacts(spark)))
    model, _ = recommend.train(spark, events, items, contacts, ad.THRESHOLD_MS, n=10, k=5, rank=4, iterations=2, rounds=2, depth=2)
    seen = io.staged(interactions.touched(ev.in_window(events, ad.THRESHOLD_MS), ad.THRESHOLD_MS), "seen")
    base = os.path.dirname(io.shared_path(spark, "x"))
    before = set(os.listdir(base))
    rows = lambda df: sorted(map(tuple, df.collect()))
    users = model.pairs.select("user_id").distinct().count()
    one = rows(recommend.ranked_lists(model, items, model.pairs, seen, 5))
    several = rows(recommend.ranked_lists(model, items, model.pairs, seen, 5, at_once=users * 2 * 10 // 3))
    assert one == several and len(one) > 0
    assert {n.split("-")[0] for n in set(os.listdir(base)) - before} == {"ranked", "popular", "items"}
