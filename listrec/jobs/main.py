"""Training, and lists for listed users, from tables on paths, for ``spark-submit``.

    spark-submit --py-files listrec.zip listrec/jobs/main.py train --events ... --items ... \\
        --contacts ... --threshold-ms ... --model ...
    spark-submit --py-files listrec.zip listrec/jobs/main.py lists --model ... --user-events ... \\
        --items ... --contacts ... --users ... --out ...

Inference reads what training wrote and trains nothing.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from listrec.jobs import recommend
from listrec.sources import io


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    jobs = p.add_subparsers(dest="job", required=True)
    t, u = jobs.add_parser("train"), jobs.add_parser("lists")
    for j in (t, u):
        j.add_argument("--model", required=True, help="folder of the model")
        j.add_argument("--items", required=True, help="item attributes (Parquet)")
        j.add_argument("--contacts", required=True, help="contact event types (CSV, mapped_eid)")
        j.add_argument("--k", type=int, default=160, help="items of a list")
    t.add_argument("--events", required=True, help="click log (Parquet)")
    t.add_argument("--threshold-ms", type=int, required=True, help="end of training, start of the target week")
    for name, value in (("days", 28), ("recent", 100), ("min-users", 3), ("n", 400), ("rank", 32), ("iterations", 15), ("rounds", 500), ("depth", 6)):
        t.add_argument(f"--{name}", type=int, default=value)
    u.add_argument("--user-events", required=True, help="histories of the listed users (Parquet)")
    u.add_argument("--users", required=True, help="listed users (CSV, user_id)")
    u.add_argument("--out", required=True, help="folder for lists (Parquet) and submission (CSV)")
    return p.parse_args(args)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = arguments(args)
    spark = spark or SparkSession.builder.appName(a.job).getOrCreate()
    items, contacts = io.read_items(spark, a.items), io.read_ids(spark, a.contacts, "mapped_eid")
    if a.job == "train":
        model, recall = recommend.train(spark, io.read_events(spark, a.events), items, contacts, a.threshold_ms, a.days, a.recent, a.min_users, a.n, a.k, a.rank, a.iterations, a.rounds, a.depth)
        recommend.save(model, spark, a.model)
        io.write_stage(recall, f"{a.model}/recall")
        return
    model = recommend.load(spark, a.model)
    found = recommend.lists(model, items, contacts, io.read_ids(spark, a.users, "user_id"), io.read_events(spark, a.user_events), a.k)
    io.write_stage(found, f"{a.out}/lists")
    done = spark.read.parquet(f"{a.out}/lists")
    io.write_submission(done.withColumn("order", -F.col("pos")), f"{a.out}/submission", a.k, "order")


if __name__ == "__main__":
    main()
