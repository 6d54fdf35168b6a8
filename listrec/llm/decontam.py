"""Benchmark decontamination with a broadcast set of normalised n-grams.

Only DataFrame functions run here.  Every benchmark item gives windows of
``width`` consecutive words (an item of fewer words gives one window of all its
words).  A window's sign is a 64-bit hash of four of its words; the distinct signs
form the broadcast side of a hash join that every document window probes with its
place and sign alone, so the work is linear in a text's length.  The texts of the
documents with a match are read again, the matching windows are cut out, and a hit
is kept only when its words equal the benchmark window's words.  The signs are
broadcast only below a checked number of windows and bytes; beyond it the same
rows are joined by a shuffle.  The matches are broadcast to the second read below
a checked number too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of anything but 0-9, a-z and non-ASCII separate."""
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(folded, SEPARATORS), lambda w: w != "")


def _sign(w: Column, first: Column, length: int) -> Column:
    """Hash of four words, spread over a window that starts at the 0-based position ``first``."""
    places = sorted({0, length // 3, 2 * length // 3, length - 1})
    return F.xxhash64(*[F.get(w, first + k) for k in places])


def _windows(w: Column, n: Column, length: int) -> Column:
    """Position (from 1), length and sign of each window of ``length`` words."""
    starts = F.when(n >= length, F.sequence(F.lit(1), n - F.lit(length - 1)))
    starts = F.coalesce(starts, F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), _sign(w, i - 1, length).alias("sign")))


def benchmark_windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Distinct windows: ``h``, ``len``, ``window`` (its words) and ``items`` (who has it)."""
    b = benchmark.select("item_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    length = F.least(F.col("n"), F.lit(width))
    starts = F.sequence(F.lit(1), F.col("n") - length + 1)
    one = b.select("item_id", length.alias("len"), F.explode(F.transform(starts, lambda i: F.slice("w", i, length))).alias("window"))
    one = one.groupBy("len", "window").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    return one.select(F.xxhash64("window").alias("h"), "len", "window", "items")


def hits(documents: DataFrame, benchmark: DataFrame, width: int = 10, broadcast_windows: int = 1_000_000, broadcast_bytes: int = 256 << 20) -> DataFrame:
    """One row per verified window occurrence: ``key``, ``pos``, ``len``, ``items``.

    ``key`` is (doc_id, hash of the text), so rows that share an id but not a
    text stay apart.  Positions count words from 1.
    """
    bench = cut(benchmark_windows(benchmark, width), "windows")
    size = bench.agg(F.count("*").alias("n"), F.sum(F.length(F.concat_ws(" ", "window")) + 48 + 16 * F.size("items")).alias("b"), F.collect_set("len").alias("lens")).first()
    lens, small = sorted(size["lens"]), size["n"] <= broadcast_windows and (size["b"] or 0) <= broadcast_bytes
    put = F.broadcast if small else (lambda side: side)
    docs = documents.select("doc_id", F.xxhash64("text").alias("t"), "text")
    each = docs.select("doc_id", "t", words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    each = each.select("doc_id", "t", F.explode(F.concat(*[_windows(F.col("w"), F.col("n"), m) for m in lens or [width]])).alias("x"))
    each = each.select("doc_id", "t", F.col("x.pos").alias("pos"), F.col("x.len").alias("len"), F.col("x.sign").alias("sign"))
    sign = F.lit(None).cast("long")
    for m in lens:
        sign = F.when(F.col("len") == m, _sign(F.col("window"), F.lit(0), m)).otherwise(sign)
    near = each.join(put(bench.select("len", sign.alias("sign")).distinct()), ["len", "sign"], "left_semi")
    places = near.groupBy(F.col("doc_id").alias("k"), F.col("t").alias("u")).agg(F.collect_set(F.struct("pos", "len")).alias("at"))
    places = cut(places, "places")
    found = places.agg(F.count("*").alias("n"), F.sum(F.size("at")).alias("m")).first()
    few = found["n"] <= broadcast_windows and (found["m"] or 0) <= broadcast_windows
    again = docs.join(F.broadcast(places) if few else places, docs["doc_id"].eqNullSafe(places["k"]) & (docs["t"] == places["u"]))
    cut_out = F.transform("at", lambda x: F.struct(x["pos"].alias("pos"), x["len"].alias("len"), F.slice("w", x["pos"], x["len"]).alias("own")))
    own = again.select(F.struct("doc_id", "t").alias("key"), "at", words(F.col("text")).alias("w")).select("key", F.explode(cut_out).alias("x"))
    own = own.select("key", F.col("x.pos").alias("pos"), F.col("x.len").alias("len"), F.col("x.own").alias("own")).withColumn("h", F.xxhash64("own"))
    return own.join(put(bench), ["h", "len"]).filter(F.col("own") == F.col("window")).select("key", "pos", "len", "items")


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_hit``, ``items`` and ``contaminated``.

    A word inside any occurrence of a benchmark window is hit.  A null or empty
    text has no words and is clean; benchmark items without words have no
    windows; an empty benchmark leaves every document clean.  Repeated rows
    give repeated results.
    """
    found = hits(documents, benchmark, width).groupBy("key").agg(F.collect_set(F.struct("pos", "len")).alias("at"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = F.flatten(F.transform("at", lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1)))
    found = found.select(F.col("key.doc_id").alias("k"), F.col("key.t").alias("t"), F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), F.array_sort("items").alias("items"))
    docs = documents.select("doc_id", F.xxhash64("text").alias("t"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("k")) & (docs["t"] == found["t"])
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return docs.join(found, same, "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents without any benchmark window, with all their columns.

    Null and empty texts and rows without an id stay or go by the same rule: without
    words there is no window.  Repeated rows stay or go together.
    """
    dirty = hits(documents, benchmark, width).select("key").distinct().select(F.col("key.doc_id").alias("k"), F.col("key.t").alias("t"))
    return documents.join(dirty, documents["doc_id"].eqNullSafe(dirty["k"]) & (F.xxhash64(documents["text"]) == dirty["t"]), "left_anti")
