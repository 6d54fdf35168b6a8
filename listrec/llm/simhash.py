"""Near duplicates by SimHash with a bit-sliced comparison of fingerprints.

Distinct fingerprints meet in buckets: of the eight bytes of two fingerprints at
most ``radius`` bytes differ, so they agree on some choice of the other bytes,
and each choice gives one bucket key.  A bucket's fingerprints are compared
lane by lane: their bits are stored as vertical planes, all pairs at one offset
are updated at once with carry-save counters, and a block is abandoned as soon as
every pair has passed the radius.  The pairs found in a block are reduced to a
spanning forest before they leave the task, and the components of all forests
are the groups of near duplicates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts
from .graph import components

SEED = 42
BLOCK = 65_536
CHUNK = 1 << 20
EMPTY = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of the shingles, repeats included; no word gives 0.

    A-Z is lower-cased, words end at blanks and \\t to \\r, a text of fewer words
    than ``width`` is one shingle.  A bit is set if it is in over half the hashes.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[width - 1 :].tolist() or [len(joined)]
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(first, last, strict=True)), np.uint64, len(last))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """Per row: doc_id and ``fp``."""
    return map_texts(documents, lambda texts: {"fp": [fingerprint(t, width) for t in texts]}, "fp long")


def planes_of(fp: np.ndarray) -> np.ndarray:
    """Vertical bit planes of the fingerprints, each packed to 64-bit words with one spare word."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little").T
    words = (len(fp) + 63) // 64 + 1
    packed = np.zeros((len(bits), words * 8), np.uint8)
    part = np.packbits(bits, axis=1, bitorder="little")
    packed[:, : part.shape[1]] = part
    return packed.view(np.uint64)


def shifted(planes: np.ndarray, d: int) -> np.ndarray:
    """Lane i of the result is lane i + d."""
    q, r = divmod(d, 64)
    low = planes[:, q:]
    out = np.zeros_like(planes)
    out[:, : low.shape[1]] = low >> np.uint64(r)
    if r:
        out[:, : low.shape[1] - 1] |= low[:, 1:] << np.uint64(64 - r)
    return out


def near(planes: np.ndarray, d: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Packed lanes i in ``valid`` whose distance to lane i + d is at most ``radius``."""
    levels = int(radius + 1).bit_length()
    count = [np.zeros_like(valid) for _ in range(levels)]
    over = ~valid
    for at in range(0, len(planes), 8):
        part = planes[at : at + 8]
        for carry in part ^ shifted(part, d):
            for k in range(levels):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry | passed(count, radius)
        if (over == ~np.uint64(0)).all():
            break
    return ~over


def passed(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is exactly one over the radius."""
    out = None
    for k, c in enumerate(count):
        x = c if (radius + 1) >> k & 1 else ~c
        out = x if out is None else out & x
    return out


def close_pairs(fp: np.ndarray, bucket: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The links (same bucket, distance within the radius) of a sorted block, one offset after the other.

    Yields the rows still in play, their buckets, and the two rows of each pair found.
    A fingerprint is one 64-bit word or a row of them.
    """
    rows, planes, d = np.arange(len(fp)), planes_of(fp), 1
    while d < len(rows):
        b = bucket[rows]
        same = b[:-d] == b[d:]
        if not same.any():
            return
        if len(rows) > 256 and 4 * same.sum() < len(rows):
            longer = np.bincount(b - b[0])[b - b[0]] > d
            if not longer.all():
                rows = rows[longer]
                planes = planes_of(fp[rows])
                continue
        valid = np.zeros(planes.shape[1] * 8, np.uint8)
        packed = np.packbits(same, bitorder="little")
        valid[: len(packed)] = packed
        found = near(planes, d, valid.view(np.uint64), radius)
        i = np.nonzero(np.unpackbits(found.view(np.uint8), bitorder="little")[: len(rows) - d])[0]
        yield rows, b, rows[i], rows[i + d]
        d += 1


def forest(fp: np.ndarray, bucket: np.ndarray, radius: int, alike: Callable[[int, int], bool] | None = None, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that span the links of a sorted block.

    With ``alike`` a pair of rows links only if that holds as well; it is asked of
    every pair not yet joined.  Rows of one ``group`` are joined from the start.
    """
    root = np.arange(len(fp))
    if group is not None and len(fp):
        _, first, which = np.unique(group, return_index=True, return_inverse=True)
        root = first[which]
    for rows, b, x, y in close_pairs(fp, bucket, radius):
        apart = root[x] != root[y]
        if apart.any():
            for x_, y_ in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                p, q = x_, y_
                while root[p] != p:
                    p = root[p]
                while root[q] != q:
                    q = root[q]
                if p != q and (alike is None or alike(x_, y_)):
                    root[max(p, q)] = min(p, q)
            while (root != (up := root[root])).any():
                root = up
        if not (root[rows] != root[rows[np.searchsorted(b, b)]]).any():
            break
    at = np.nonzero(root != np.arange(len(fp)))[0]
    return at, root[at]


def crossing(fp: np.ndarray, bucket: np.ndarray, radius: int, group: np.ndarray) -> np.ndarray:
    """Rows of a sorted block that have a link to a row of another group."""
    mixed = np.bincount(bucket, group != group[np.searchsorted(bucket, bucket)])[bucket] > 0
    at, out = np.nonzero(mixed)[0], np.zeros(len(fp), bool)
    for _, _, x, y in close_pairs(fp[at], np.unique(bucket[at], return_inverse=True)[1], radius) if len(at) else ():
        x, y = at[x], at[y]
        other = group[x] != group[y]
        out[x[other]] = out[y[other]] = True
    return np.nonzero(out)[0]


def bucket_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints whose components are those of all links.

    ``distinct`` has one row a fingerprint (``fp``).  With radius 2 a key fixes six
    bytes, so no bucket holds more than 65,536 fingerprints whatever the input.
    """
    masks = [sum(0xFF << 8 * k for k in range(8) if k not in out) for out in combinations(range(8), radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(k).alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(signed)])
    rows = distinct.select("fp", F.explode(keys).alias("x")).select("x.c", "x.key", "fp")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def done(c, key, fp):
            starts = np.concatenate(([True], (c[1:] != c[:-1]) | (key[1:] != key[:-1]))) if len(c) else np.empty(0, bool)
            bucket = np.cumsum(starts) - 1
            shared = np.bincount(bucket)[bucket] > 1 if len(bucket) else starts
            fp = fp[shared]
            a, b = forest(fp, np.unique(bucket[shared], return_inverse=True)[1], radius) if len(fp) else (fp, fp)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"]) if len(fp) else EMPTY

        for batch in batches:
            held = [np.concatenate((h, batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64))) for h, n in zip(held, ("c", "key", "fp"), strict=True)]
            if len(held[0]) >= BLOCK:
                c, key, _ = held
                end = int(np.nonzero((c != c[-1]) | (key != key[-1]))[0][-1]) + 1 if ((c != c[-1]) | (key != key[-1])).any() else 0
                if end:
                    yield done(*(h[:end] for h in held))
                    held = [h[end:] for h in held]
        yield done(*held)

    return rows.repartition(parts, "c", "key").sortWithinPartitions("c", "key", "fp").mapInArrow(link, "a long, b long").distinct()


def groups(documents: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """Per row: doc_id, ``fp`` (signed) and ``component_id``, the least doc_id reachable over links.

    Two documents link when their fingerprints differ in ``radius`` bits or fewer;
    equal fingerprints always link, those of texts without words (null and empty
    included) are 0.  Null ids take part and get their group's least id.  Repeated
    rows give repeated results, an empty table an empty result.
    """
    prints = cut(fingerprints(documents, width), "simhash")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(bucket_links(distinct.select("fp"), radius))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(named.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


#: Of the sketches of whole near-duplicate search: bits, bands and rows of the bucket keys.
WORDS, BANDS, ROWS = 4, 10, 3


def splitmix(h: np.ndarray) -> np.ndarray:
    """A second, independent-looking hash of 64-bit hashes."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The 64-bit hashes of a text's distinct shingles, ascending."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    shingles = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles)))


def at_least(p: np.ndarray, q: np.ndarray, least: float) -> bool:
    """Whether two shingle sets have a Jaccard similarity of ``least`` or more."""
    if len(p) > len(q):
        p, q = q, p
    if len(p) / len(q) < least:
        return False
    both = int(np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p))
    return both / (len(p) + len(q) - both) >= least


def sketch(h: np.ndarray) -> tuple[bytes, list[int]]:
    """A SimHash of 256 bits over a shingle set, and ten bucket keys of three minima each."""
    sums, least = np.zeros((WORDS, 64), np.int64), np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(h), CHUNK // 16):
        part = h[at : at + CHUNK // 16]
        for k in range(WORDS):
            part = splitmix(part)
            sums[k] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        for k in range(BANDS * ROWS):
            least[k] = min(least[k], ((part ^ (part >> np.uint64(29))) * SPREAD[k]).min())
    bits = np.packbits((2 * sums > len(h)).astype(np.uint8), axis=1, bitorder="little")
    return bits.tobytes(), [xxhash.xxh64_intdigest(least[k : k + ROWS].tobytes()) - (1 << 63) for k in range(0, BANDS * ROWS, ROWS)]


SPREAD = splitmix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
#: Most rows of a block of a bucket; a task compares two blocks.
BUCKET = 4096
#: Most large buckets whose sizes are broadcast.
FEW = 1_000_000
#: Members that are compared with one copy of their pivot's text.
STAR = 1024


def in_blocks(rows: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Rows (c, key, node, sim[, digest][, group]) dealt so that any two of a bucket (c, key) meet in a block pair (i, j).

    A bucket of over ``BUCKET`` rows is dealt into blocks by a hash of the row, and
    each pair of blocks is a key of its own (a block meets itself there too).  The
    sizes of such buckets, at most one in ``BUCKET`` rows, are broadcast up to ``FEW``
    of them.  With ``texts`` (node, digest, z) each row comes with its text.
    """
    limit = BUCKET
    sizes = rows.groupBy("c", "key").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    sizes = cut(sizes.select("c", "key", F.ceil(F.col("n") / limit).cast("int").alias("blocks")), "sizes")
    dealt = rows.join(F.broadcast(sizes) if sizes.count() <= FEW else sizes, ["c", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", "sim"), F.col("blocks")).cast("int"))
    if texts is not None:
        dealt = dealt.join(texts, ["node", "digest"])
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (F.col("blocks") == 1) | (x != F.col("own")))
    return dealt.withColumn("other", F.explode(others)).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


ORDER = ["c", "key", "i", "j"]


def by_blocks(dealt: DataFrame, columns: list[str], solve: Callable[..., list[np.ndarray]], schema: str) -> DataFrame:
    """Run ``solve`` on whole block pairs: their keys, then ``columns`` as arrays; it returns columns of ``schema``."""
    parts, limit = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), BUCKET
    names = [f.split()[0] for f in schema.split(", ")]

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        out = [np.stack([batch.column(n).to_numpy().astype(np.int64) for n in ORDER], 1)]
        for n in columns:
            if n == "sim":
                out.append(np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint64).reshape(-1, WORDS))
            elif n == "z":
                out.append(np.array([*batch.column(n).to_pylist(), None], object)[:-1])
            else:
                out.append(batch.column(n).to_numpy().astype(np.int64))
        return out

    def done(held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in solve(*held)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = arrays(batch)
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            if len(held[0]) >= limit:
                on = (held[0] != held[0][-1]).any(1)
                end = int(np.nonzero(on)[0][-1]) + 1 if on.any() else 0
                if end:
                    yield done([h[:end] for h in held])
                    held = [h[end:] for h in held]
        if held and len(held[0]):
            yield done(held)

    return dealt.select(*ORDER, *columns).repartition(parts, *ORDER).sortWithinPartitions(*ORDER, "node").mapInArrow(run, schema).distinct()


def numbered(where: np.ndarray) -> np.ndarray:
    """Numbers of the block pairs, one for each row."""
    return np.cumsum(np.concatenate(([True], (where[1:] != where[:-1]).any(1)))) - 1


def block_links(rows: DataFrame, radius: int, texts: DataFrame | None = None, width: int = 5, least: float = 0.8) -> DataFrame:
    """Links of rows (c, key, node, sim) that share a bucket (c, key), as pairs (a, b) of nodes.

    With ``texts`` (node, digest, z; ``rows`` have the digest too) a pair within the
    radius links only if the shingle sets' similarity is ``least`` or more.  This is
    asked before two groups are joined, so a pair that fails hides no other.  Every
    pair of a bucket is compared, whatever the partitions, but for rows of one
    ``group``, a column that ``rows`` may have.
    """
    grouped, checked = "group" in rows.columns, texts is not None

    def solve(where: np.ndarray, node: np.ndarray, sim: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
        sets: dict[int, np.ndarray] = {}

        def set_of(row: int) -> np.ndarray:
            if row not in sets:
                sets[row] = shingle_set(unpacked(more[-1][row]), width)
            return sets[row]

        alike = (lambda x, y: at_least(set_of(x), set_of(y), least)) if checked else None
        a, b = forest(sim, numbered(where), radius, alike, more[0] if grouped else None)
        return [node[a], node[b]]

    return by_blocks(in_blocks(rows, texts), ["node", "sim", *["group"] * grouped, *["z"] * checked], solve, "a long, b long")


def crossing_rows(rows: DataFrame, radius: int) -> DataFrame:
    """The rows (c, key, node) with a row of another ``group`` within the radius in their bucket."""

    def solve(where: np.ndarray, node: np.ndarray, sim: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
        at = crossing(sim, numbered(where), radius, group)
        return [where[at, 0].astype(np.int32), where[at, 1], node[at]]

    return by_blocks(in_blocks(rows), ["node", "sim", "group"], solve, "c int, key long, node long")


def packed(text: str | None) -> bytes | None:
    return None if text is None else zstandard.ZstdCompressor(level=3).compress(text.encode("utf-8", "replace"))


def unpacked(z: bytes | None) -> str | None:
    return None if z is None else zstandard.ZstdDecompressor().decompress(z).decode("utf-8")


def nearest_pivots(shared: DataFrame, radius: int) -> DataFrame:
    """(node, digest, pivot, pivot_digest): for each row the least first row of its buckets that is within ``radius``.

    The firsts are written before the join, so that the skew join can split a hot bucket.
    """
    firsts = cut(shared.groupBy("c", "key").agg(F.min(F.struct("node", "digest", "sim")).alias("p")), "firsts")
    met = shared.join(firsts, ["c", "key"]).filter("node <> p.node or digest <> p.digest")
    met = met.select("node", "digest", "sim", F.col("p.node").alias("pivot"), F.col("p.digest").alias("pivot_digest"), F.col("p.sim").alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, WORDS) for c in ("sim", "other"))
            near_ = np.bitwise_count(x ^ y).sum(axis=1) <= radius
            yield b.select(["node", "digest", "pivot", "pivot_digest"]).filter(pa.array(near_))

    near_ = met.mapInArrow(run, "node long, digest binary, pivot long, pivot_digest binary")
    return near_.groupBy("node", "digest").agg(F.min(F.struct("pivot", "pivot_digest")).alias("p")).select("node", "digest", "p.*")


def verified(edges: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The (a, b) of edges (node, digest, pivot, pivot_digest) whose shingle sets are alike enough.

    A task holds one pivot's shingles while its members' texts stream past; a pivot
    of over ``STAR`` members is held by several tasks.  Every text comes once as a member.
    """
    star = ["pivot", "pivot_digest"]
    counts = cut(edges.groupBy(*star).agg(F.ceil(F.count("*") / STAR).cast("long").alias("tasks")), "stars")
    dealt = edges.join(counts, star).withColumn("task", F.pmod(F.xxhash64("node", "digest"), F.col("tasks")))
    came = dealt.join(texts, ["node", "digest"]).select(*star, "task", F.lit(1).alias("kind"), "node", "z")
    own = texts.select(F.col("node").alias("pivot"), F.col("digest").alias("pivot_digest"), "z")
    held = counts.join(own, star).select(*star, F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("kind"), F.col("pivot").alias("node"), "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = None
        for b in batches:
            links = []
            for kind, pivot, node, z in zip(*(b.column(c).to_pylist() for c in ("kind", "pivot", "node", "z")), strict=True):
                own = shingle_set(unpacked(z), width)
                if kind == 0:
                    shingles = own
                elif at_least(own, shingles, least):
                    links.append((node, pivot))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    order = [*star, "task"]
    return held.unionByName(came).repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order, "kind").mapInArrow(run, "a long, b long").filter("a <> b")


def near_groups(documents: DataFrame, width: int = 5, radius: int = 76, least: float = 0.8) -> DataFrame:
    """Rows (doc_id, component_id) of every document that is not the first of its group.

    Two texts link if their sets of ``width``-word shingles (as 64-bit hashes) have a
    Jaccard similarity of ``least`` or more; this is checked on the texts.  Only texts
    with a common bucket key (at 0.8 all but one in a thousand) and SimHashes within
    ``radius`` are checked: at 0.8 the expected distance of the 256 bits is 39 with a
    deviation of 6 (48 for texts of eight and nine words), far inside.  Equal shingle
    sets collapse first.  Null ids take no part.  Texts without words are equal to
    each other.  Repeated rows give repeated results, an empty table an empty one.

    Each text is first checked with one other: the least first row of its buckets
    that its SimHash comes near, so copies of a text join without meeting each other.
    In all buckets the SimHashes alone then show which rows come near a row of another
    group found so far, and only these are checked with their texts too.
    """

    def digest(h: np.ndarray) -> bytes:
        return xxhash.xxh3_128_digest(h.tobytes())

    def work(texts: list[str | None]) -> dict[str, list]:
        sets = [shingle_set(t, width) for t in texts]
        found = [sketch(h) for h in sets]
        return {"digest": [digest(h) for h in sets], "sim": [s for s, _ in found], "keys": [k for _, k in found]}

    def pack(texts: list[str | None]) -> dict[str, list]:
        return {"digest": [digest(shingle_set(t, width)) for t in texts], "z": [packed(t) for t in texts]}

    named_rows = documents.filter("doc_id is not null").select("doc_id", "text")

    def texts_of(rows: DataFrame) -> DataFrame:
        """The texts of rows' nodes; a repeated id's texts are told apart by their digest."""
        nodes = cut(rows.select(F.col("node").alias("doc_id")).distinct(), "nodes")
        firsts = named_rows.join(F.broadcast(nodes) if nodes.count() <= FEW else nodes, "doc_id", "left_semi")
        return map_texts(firsts, pack, "digest binary, z binary").withColumnRenamed("doc_id", "node").dropDuplicates(["node", "digest"])

    prints = cut(map_texts(named_rows, work, "digest binary, sim binary, keys array<bigint>"), "sketches")
    distinct = cut(prints.groupBy("digest", "sim", "keys").agg(F.min("doc_id").alias("node")), "distinct")
    rows = distinct.select("node", "digest", "sim", F.posexplode("keys").alias("c", "key"))
    # written before the join, so that the skew join can split a hot bucket
    met = cut(rows.groupBy("c", "key").agg(F.count("*").alias("n")).filter("n > 1").select("c", "key"), "buckets")
    shared = cut(rows.join(met, ["c", "key"]), "shared")
    edges = cut(nearest_pivots(shared, radius), "edges")
    ends = edges.select(F.explode(F.array("node", "pivot")).alias("node")).distinct()
    links = cut(verified(edges, cut(texts_of(ends), "texts"), width, least), "links")
    known = cut(components(links).select("node", F.col("root").alias("group")), "groups")
    late = shared.join(known, "node", "left").withColumn("group", F.coalesce("group", "node"))
    late = cut(late.join(cut(crossing_rows(late, radius), "near"), ["c", "key", "node"], "left_semi"), "crossing")
    roots = components(links.unionByName(block_links(late, radius, texts_of(late), width, least)))
    named = distinct.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    return prints.select("doc_id", "digest").join(named, "digest").filter("doc_id <> component_id").select("doc_id", "component_id")


def without_near_duplicates(documents: DataFrame, width: int = 5, radius: int = 76, least: float = 0.8) -> DataFrame:
    """The documents less all but the least doc_id of each group; rows without an id stay.

    Rows that repeat an id go together if one of their texts belongs to another's group.
    """
    gone = near_groups(documents, width, radius, least).select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti")
