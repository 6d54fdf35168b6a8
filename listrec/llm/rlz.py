"""Substring deduplication by a relative Lempel-Ziv parse over the whole corpus.

Every text is cut into reference blocks that depend on content alone: each window
of ``window`` words is anchored at its least-hashed ``gram``-word sequence, and the
consecutive windows with one anchor form a block.  The earliest place of every
block is the reference index.  Spark looks up, for every text, the blocks that are
indexed earlier; where blocks of one anchor differ, single windows are looked up,
as a window at the end of a copied block may match another reference.  A text is
then parsed greedily: the copy that reaches furthest is taken, copies that go on in
their source join to one factor, and where a factor ends the matches that begin
before its end are tried next.  Words under a factor of a window or more are
removed, so a word goes exactly when a window over it starts earlier, in a smaller
document or further up in its own.

Blocks and windows are compared by a 64-bit hash among those that share an anchor,
itself a 64-bit hash.  Only anchors that occur twice are followed further.  Sums
are written before they are joined, so that the skew join splits hot anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WINDOW, GRAM = 20, 8
#: Odd multipliers of the rolling hashes and of the final mix.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
PLACE = np.uint64((1 << 28) - 1)
FLUSH = 200_000


class Powers:
    """Powers of a multiplier and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, multiplier: int) -> None:
        self.steps = np.uint64(multiplier), np.uint64(pow(multiplier, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            one = [np.concatenate((np.ones(1, np.uint64), np.full(size - 1, s, np.uint64))) for s in self.steps]
            self.up, self.down = (np.multiply.accumulate(o) for o in one)
        return self.up[:n], self.down[:n]


POWERS = [Powers(m) for m in MULTIPLIERS]


def mixed(h: np.ndarray) -> np.ndarray:
    for m in MIX:
        h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Hashes of any runs of a text's words."""

    def __init__(self, words: list[bytes], which: int) -> None:
        n = len(words)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        if which:
            h = mixed(h + np.uint64(which))
        up, self.down = POWERS[which].get(n)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)))

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mixed(h + (ends - starts).astype(np.uint64))


def words_of(text: str | None) -> list[bytes]:
    """Words between blanks and \\t to \\r, unchanged."""
    return text.encode("utf-8", "replace").split() if text else []


def blocks(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, block hash, first window and number of windows of each block."""
    n, span = len(words), window - gram + 1
    if n < window:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32))
    at = np.arange(n - gram + 1)
    grams = Rolling(words, 0).runs(at, at + gram)
    key = (grams & ~PLACE) | at.astype(np.uint64)
    least, have = key, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if span > have:
        rest = span - have
        least = np.minimum(least[:-rest], least[rest:])
    place = (least & PLACE).astype(np.int64)
    first = np.concatenate(([0], np.nonzero(place[1:] != place[:-1])[0] + 1))
    count = np.diff(np.concatenate((first, [len(place)])))
    whole = Rolling(words, 1).runs(first, first + count + window - 1)
    return grams[place[first]].view(np.int64), whole.view(np.int64), first.astype(np.int32), count.astype(np.int32)


def anchored(documents: DataFrame, window: int, gram: int) -> DataFrame:
    """The blocks of all texts: a, p (hashes), doc_id, l (first window), m (windows)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, ids, held = [], [], 0
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                found = blocks(words_of(text.as_py()), window, gram)
                parts.append(found)
                ids.append(doc)
                held += len(found[0])
                if held >= FLUSH:
                    yield rows(parts, ids)
                    parts, ids, held = [], [], 0
            if parts:
                yield rows(parts, ids)

    def rows(parts, ids):
        doc = np.repeat(np.array(ids, np.int64), [len(p[0]) for p in parts])
        a, p, first, m = (np.concatenate([x[k] for x in parts]) for k in range(4))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(p), pa.array(doc), pa.array(first), pa.array(m)], ["a", "p", "doc_id", "l", "m"])

    return documents.filter("doc_id is not null").select("doc_id", "text").mapInArrow(work, "a long, p long, doc_id long, l int, m int")


def packed(documents: DataFrame) -> DataFrame:
    """doc_id and the compressed text, so that a shuffle of texts is small."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = [pack(t.as_py().encode("utf-8", "replace")) if t.is_valid else None for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(z, pa.binary())], ["doc_id", "z"])

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id long, z binary")


def unpack(z) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(z.as_py()).split() if z.is_valid else []


def windows_of(documents: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """Window hashes of the chosen blocks (doc_id, a, l, m): a, w, doc_id, s (start)."""
    per = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("l", "m", "a")).alias("c"))
    joined = packed(documents).join(per, "doc_id").select("doc_id", "z", F.col("c.l").alias("l"), F.col("c.m").alias("m"), F.col("c.a").alias("a"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                roll = Rolling(unpack(b.column("z")[i]), 1)
                first, m, a = (np.array(b.column(c)[i].as_py(), np.int64) for c in ("l", "m", "a"))
                starts = np.concatenate([np.arange(x, x + k) for x, k in zip(first, m, strict=True)])
                anchor = np.repeat(a, m)
                inside = starts + window < len(roll.sums)  # else of another text with this id
                starts, anchor = starts[inside], anchor[inside]
                doc = np.full(len(starts), b.column("doc_id")[i].as_py(), np.int64)
                w = roll.runs(starts, starts + window).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(w), pa.array(doc), pa.array(starts.astype(np.int32))], ["a", "w", "doc_id", "s"])

    return joined.mapInArrow(work, "a long, w long, doc_id long, s int")


def copies(rows: DataFrame, keys: list[str], start: str, length: Column, name: str) -> DataFrame:
    """Rows that an earlier row with the same keys precedes: doc_id, start, n words, source place."""
    place = F.struct("doc_id", F.col(start).alias("s"))
    first = rows.groupBy(*keys).agg(F.min(place).alias("f"), F.count("*").alias("n")).filter("n > 1").drop("n")
    found = rows.join(cut(first, name), keys).filter(place != F.col("f"))
    return found.select("doc_id", F.col(start).alias("start"), length.alias("n"), F.col("f.doc_id").alias("src"), F.col("f.s").alias("src_start"))


def matches(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Copied blocks and windows: doc_id, start, n (words), src and src_start (the earliest place)."""
    every = cut(anchored(documents, window, gram), "anchored")
    again = cut(every.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"), "anchors")
    shared = cut(every.join(again, "a"), "blocks")
    long = copies(shared, ["a", "p"], "l", F.col("m") + F.lit(window - 1), "firsts")
    # Blocks of one anchor that differ: their first occurrences are compared window by window.
    index = cut(shared.groupBy("a", "p").agg(F.min(F.struct("doc_id", "l", "m")).alias("f")).select("a", "f.*"), "index")
    several = cut(index.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"), "several")
    edges = cut(windows_of(documents, index.join(several, "a"), window), "windows")
    return long.unionByName(copies(edges, ["a", "w"], "s", F.lit(window), "earliest"))


def parse(found: list[tuple[int, int, int, int]], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, n, source, source start) of a text from its matches.

    Of the matches that begin before the last factor's end (or, past it, at the next
    place that has one) that which reaches furthest is taken; ties go to the source
    that the factor copies already, then to the earliest.  It lengthens the factor
    if it goes on in its source.  Factors may overlap at their ends by less than they
    add, and none is shorter than a window.
    """
    found, out, i = sorted(m for m in found if m[1] >= window), [], 0
    while i < len(found):
        end = out[-1][0] + out[-1][1] if out and found[i][0] <= out[-1][0] + out[-1][1] else found[i][0]
        best = None
        while i < len(found) and found[i][0] <= end:
            start, n, src, at = found[i]
            goes_on = bool(out) and src == out[-1][2] and start - out[-1][0] == at - out[-1][3]
            rank = (start + n, goes_on, -src, -at)
            if best is None or rank > best[0]:
                best = rank, found[i]
            i += 1
        (reach, goes_on, *_), (start, n, src, at) = best
        if out and reach <= out[-1][0] + out[-1][1]:
            continue
        if goes_on and start <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], reach - out[-1][0], src, out[-1][3])
        else:
            out.append((start, n, src, at))
    return out


def deduplicate(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, ``n_words``, ``n_removed``, ``kept`` (text) and ``factors``.

    ``kept`` joins the words left by one blank.  Null and empty texts have no
    words; texts shorter than a window are kept whole.  Rows without an id are kept
    whole and are no reference.  Ids name documents: of rows that repeat an id
    neither precedes the other, and if their texts differ, what is found in one is
    removed at the same places of the other.  An empty table gives an empty result.
    """
    runs = matches(documents, window, gram)
    per = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "src", "src_start")).alias("r")).withColumnRenamed("doc_id", "k")
    docs = packed(documents)
    joined = docs.join(per, docs["doc_id"] == per["k"], "left").select("doc_id", "z", *(F.col(f"r.{c}").alias(c) for c in ("start", "n", "src", "src_start")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                out = {c: [] for c in ("n_words", "n_removed", "kept", "factors")}
                for i in range(part.num_rows):
                    words = unpack(part.column("z")[i])
                    rows = list(zip(*(part.column(c)[i].as_py() or [] for c in ("start", "n", "src", "src_start")), strict=True))
                    factors = parse(rows, window)
                    gone = np.zeros(len(words) + 1, np.int64)
                    for start, n, _, _ in factors:
                        gone[min(start, len(words))] += 1
                        gone[min(start + n, len(words))] -= 1
                    stays = np.cumsum(gone[:-1]) == 0
                    out["n_words"].append(len(words))
                    out["n_removed"].append(int(len(words) - stays.sum()))
                    kept = [w for w, s in zip(words, stays.tolist(), strict=True) if s] if factors else words
                    out["kept"].append(b" ".join(kept).decode("utf-8"))
                    out["factors"].append(",".join(":".join(map(str, f)) for f in factors))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], ["doc_id", *out])

    return joined.mapInArrow(work, "doc_id long, n_words long, n_removed long, kept string, factors string")
