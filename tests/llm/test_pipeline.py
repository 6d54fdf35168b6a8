"""The pipeline's stages on a small table, and the whole on the smallest given one."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from listrec.llm.common import cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(1)
    vocab = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{i}" for i in range(2000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows, labels = [], []
    for i in range(120):
        t = text(80)
        if i % 4 == 0:
            t += " vile nasty"
        rows.append((i, t))
        labels.append((i, 1, int(i % 4 == 0)))
    item = text(30)
    rows += [(200, rows[1][1]), (201, rows[2][1] + " one more"), (202, text(30) + " " + item + " " + text(30)), (203, text(50) + " password=abcdefghijklmnop"), (204, None), (205, text(40) + " nasty vile")]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_each_decision_takes_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, gone = ids(docs), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, tables), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        gone.append(before - ids(docs))
        before = ids(docs)
    assert gone == [{*range(0, 120, 4), 205}, {200, 201}, {202}, set()]
    found = {r.doc_id: r for r in docs.collect()}
    assert found[203].text.endswith("[SECRET]") and found[203].n_chars == len(found[203].text) and found[204].text is None
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert ids(last) == before and last.filter("not round_trip").count() == 0


def test_stages_take_columns_of_any_name(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    extra = ("score", "predicted", "row", "clean", "_n", "_k", "_t", "k", "t", "h", "items", "key", "label", "digest", "sim", "node", "z", "pos", "len")
    wide = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in extra])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = lambda df: sorted(map(str, df.select(docs.columns).collect()))
        got = stage(spark, wide, tables)
        assert got.columns == wide.columns and rows(got) == rows(stage(spark, docs, tables)), name
        assert all(r[c] == f"{c} of {r.doc_id}" for r in got.collect() for c in extra), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, tables).count() == wide.count()


def test_run_equals_the_stages_and_empty_tables_pass(spark, tables, tmp_path):
    assert corpus_pipeline.run(spark, tables).count() == 126 - 31 - 2 - 1
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
