"""Every registered query that has SQL agrees with it on the smallest tables."""

import math
import os

import duckdb
import pytest

from listrec import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def normal(rows):
    def one(v):
        return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v

    return sorted((tuple(map(one, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    found = con.sql(queries.ORACLES[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    assert normal(df.select(*cols).collect()) == normal(tuple(r[i] for i in at) for r in found.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).take(1)) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_chain(spark):
    from listrec.jobs import recommend
    from listrec.sources import adapters as ad

    d = DIR.replace("0.001", "0.01")
    lists, recall = recommend.run(spark, ad.click_log(spark, d), ad.items(spark, d), ad.contacts(spark), ad.THRESHOLD_MS, n=20, k=10, rank=4, iterations=2, rounds=3, depth=3)
    assert lists.groupBy("user_id").count().agg({"count": "max"}).first()[0] <= 10
    assert 0 <= recall.first().recall <= 1


def test_job_gives_every_listed_user_a_whole_list(spark, tmp_path):
    """From files to a submission: users with a history of their own, cold ones, one listed twice."""
    from listrec.jobs import main, recommend
    from listrec.sources import adapters as ad

    d, k = DIR.replace("0.001", "0.01"), 10
    paths = {n: str(tmp_path / n) for n in ("events", "own", "items", "contacts", "users", "out")}
    log = ad.click_log(spark, d)
    log.filter("user_id % 5 <> 0").write.parquet(paths["events"])
    log.filter("user_id % 5 = 0").write.parquet(paths["own"])
    ad.items(spark, d).write.parquet(paths["items"])
    ad.contacts(spark).write.option("header", True).csv(paths["contacts"])
    listed = [5, 10, 10, 15, 900_001, 900_002]
    spark.createDataFrame([(u,) for u in listed], "user_id long").write.option("header", True).csv(paths["users"])
    common = ["--model", str(tmp_path / "model"), "--items", paths["items"], "--contacts", paths["contacts"], "--k", str(k)]
    main.main(["train", *common, "--events", paths["events"], "--threshold-ms", str(ad.THRESHOLD_MS), "--n", "20", "--rank", "4", "--iterations", "2", "--rounds", "3", "--depth", "3"], spark)
    main.main(["lists", *common, "--user-events", paths["own"], "--users", paths["users"], "--out", paths["out"]], spark)
    lists = spark.read.parquet(f"{paths['out']}/lists").collect()
    by = {u: sorted(r.pos for r in lists if r.user_id == u) for u in set(listed)}
    assert {r.user_id for r in lists} == set(listed) and all(v == list(range(k)) for v in by.values())
    assert all(r.filled for r in lists if r.user_id > 900_000) and not all(r.filled for r in lists if r.user_id < 900_000)
    history = {(r.user_id, r.item_id) for r in recommend.history_of(log, ad.contacts(spark), ad.THRESHOLD_MS, 28, 100).collect()}
    assert not history & {(r.user_id, r.item_id) for r in lists}
    model = recommend.load(spark, str(tmp_path / "model"))
    again = recommend.lists(model, ad.items(spark, d), ad.contacts(spark), spark.createDataFrame([(u,) for u in listed], "user_id long"), spark.read.parquet(paths["own"]), k).collect()
    assert sorted(again) == sorted(lists)
    sent = spark.read.option("header", True).csv(f"{paths['out']}/submission").collect()
    assert {(int(r.user_id), int(r.item_id)) for r in sent} == {(r.user_id, r.item_id) for r in lists} and len(sent) == len(lists)
