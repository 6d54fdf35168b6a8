"""Vector near-dedup, filter audit and fill-in-the-middle against brute force."""

import hashlib
import itertools
import os
import random
import re

import duckdb
import numpy as np
import pytest

from listrec.llm import audit, cross_polytope, fim, queries

DIR = "/root/testdata/sf0.001"

# 11 --------------------------------------------------------------------------

VECTORS = "vec_id long, label int, embedding array<float>"


def linked_by_force(rows, least=0.93):
    """(vec_id, n_links, component_id, kept) of each row, from all pairs."""

    def usable(r):
        return r[1] is not None and bool(r[2]) and all(v is not None and np.isfinite(v) for v in r[2]) and any(r[2])

    units = [np.asarray(r[2], np.float32).astype(np.float64) if usable(r) else None for r in rows]
    near = [set() for _ in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        x, y = units[i], units[j]
        if x is not None and y is not None and rows[i][1] == rows[j][1] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
            near[i].add(j), near[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo = [k for k in {k for t in todo for k in near[t]} if k not in seen]
            seen |= set(todo)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        first = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), first, rows[i][0] is not None and rows[i][0] == first))
    return out


def some_vectors(seed=0, width=64):
    rng = np.random.default_rng(seed)
    rows = [(i, i % 2, rng.normal(size=width)) for i in range(120)]
    for k in range(100):  # near copies of two vectors, and vectors about the limit
        rows.append((1000 + k, k % 2, rows[k % 2][2] + rng.normal(size=width) * (0.05 if k < 60 else 0.28)))
    rows = [(i, label, v.astype(np.float32).tolist()) for i, label, v in rows]
    rows += [(2000 + k, 0, rows[4][2]) for k in range(30)]  # equal ones
    rows += [(2100, 1, rows[4][2]), (2101, None, rows[4][2]), (2102, 0, None), (2103, 0, [0.0] * width), (2104, 0, [float("nan")] + [1.0] * (width - 1)), (2105, 0, [None] + [1.0] * (width - 1))]
    rows += [(2106, 0, []), (2107, 0, [float("inf")] * width), (2108, 0, [1e30] + [0.0] * (width - 1)), (2109, 0, [2e-30] + [0.0] * (width - 1)), (2110, 0, [1.0]), (2111, 0, [2.0]), (2112, 0, [1.0, 2.0, 3.0])]
    return rows + [rows[4], (None, 0, rows[4][2]), (None, 1, rows[5][2]), (7, 0, rows[4][2])]


def near(spark, rows):
    got = cross_polytope.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    return sorted(map(tuple, got), key=str)


@pytest.mark.parametrize(("seed", "width"), [(0, 64), (1, 48)])
def test_vector_links_equal_brute_force(spark, seed, width):
    rows = some_vectors(seed, width)
    assert near(spark, rows) == sorted(linked_by_force(rows), key=str)


def test_large_groups_in_parts_and_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "GROUP", 20)
    monkeypatch.setattr(cross_polytope, "BLOCK", 12)
    rows = some_vectors(2)
    assert near(spark, rows) == sorted(linked_by_force(rows), key=str)


def test_oversized_groups_are_joined_by_a_shuffle_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "GROUP", 20)
    monkeypatch.setattr(cross_polytope, "FEW", 0)
    rows = some_vectors(3)
    assert near(spark, rows) == sorted(linked_by_force(rows), key=str)


def test_pairs_at_the_limit_are_settled_in_double_precision(spark):
    """Pairs whose cosine is off the limit by far less than the 16-bit error."""
    x, y = np.zeros(64), np.zeros(64)
    x[0] = y[1] = 1
    c = np.float64(0.93)
    rows = [(0, 0, x.tolist())]
    for k, e in enumerate((-3e-7, -1e-7, 1e-7, 3e-7), 1):
        rows.append((k, 0, ((c + e) * x + np.sqrt(1 - (c + e) ** 2) * y).astype(np.float32).tolist()))
    assert near(spark, rows) == sorted(linked_by_force(rows), key=str)


def test_candidates_find_pairs_at_the_limit():
    """The stated recall, on random pairs exactly at the limit."""
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=(2, 4000, 64))
    x = cross_polytope.unit(x)
    z = cross_polytope.unit(z - (z * x).sum(1, keepdims=True) * x)
    for c, least in ((0.93, 0.999), (0.95, 0.999), (0.99, 1)):
        (fx, rx), (fy, ry) = cross_polytope.probes(x), cross_polytope.probes(c * x + np.sqrt(1 - c * c) * z)
        met = (fx[:, :, None] == fy[:, None]).any((1, 2)) & (rx[:, :, None] == ry[:, None]).any((1, 2))
        assert met.mean() >= least


def test_vectors_empty_table_and_clashing_columns(spark):
    empty = cross_polytope.near_vectors(spark.createDataFrame([], VECTORS))
    assert empty.columns == ["vec_id", "n_links", "component_id", "kept"] and empty.count() == 0
    rows = [(1, 0, [1.0, 0.0], 5), (2, 0, [1.0, 0.1], 5)]
    df = spark.createDataFrame(rows, VECTORS + ", node long").withColumns({c: cross_polytope.F.lit(3) for c in ("n", "first", "least", "root", "d1", "q")})
    assert sorted(map(tuple, cross_polytope.near_vectors(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", ["op11_embedding_near_dedup", "op12_filter_interaction_audit", "op13_fill_in_middle"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    found = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, DIR).select(*found.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(found.fetchall(), key=str)


# 12 --------------------------------------------------------------------------


def audit_by_force(docs, labels):
    good, toxic = ({i for i, *l in labels if i is not None and l[k] == 1} for k in (0, 1))
    fails = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = ("A" if len(w) < 50 else "") + ("B" if 100 * len(set(w)) < 65 * len(w) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else "") + ("D" if re.search(r"[#$%&*|]", t) else "")
        f += "E" if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs) else ""
        fails.append((s or "", set(f), i))
    out = {}
    shapley = {}
    for part in {p for p, *_ in fails}:
        own = [(f, i) for p, f, i in fails if p == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                n_fail = sum(f in x[0] for x in own)
                out[part, "".join(order), step] = (len(left), len(removed), n_fail - len(removed), sum(x[0] == {f} for x in own), sum(x[1] in good for x in removed), sum(x[1] in toxic for x in removed))
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


def audit_docs():
    rng = random.Random(3)
    vocab = ["word%d" % k for k in range(300)] + ["LOUD", "É", "x|y"]
    long = lambda n, v=300: " ".join(rng.choice(vocab[:v]) for _ in range(n))
    docs = [(i, long(rng.randint(30, 90), rng.choice([10, 300, 303])), rng.choice(["a", "b", None])) for i in range(60)]
    docs += [(100 + i, docs[rng.randint(0, 59)][1], rng.choice(["a", "c"])) for i in range(60)]
    docs += [(200, None, "a"), (201, "", None), (202, "", ""), (203, "A" * 30, "a"), (204, long(20_000), "b"), (205, docs[0][1][:-1] + "~", "b"), (206, docs[0][1][:-1] + "^", "a")]
    return docs + [docs[5], docs[5], (None, docs[6][1], "a"), (None, None, None), (3, docs[7][1], "b"), (4, docs[0][1][:-1] + "^", "b")]


LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 160, 2)] + [(6, 1, 0), (8, None, 1), (None, 1, 1), (100, 0, 0), (100, 1, 1)]


@pytest.mark.parametrize("blocks", [audit.BLOCKS, (100_000, 200_000)])
def test_audit_equals_brute_force(spark, blocks, monkeypatch):
    """With the second blocks every hash is that of no bytes, so unequal texts stay in one class until compared."""
    docs = audit_docs()
    whole = audit.failures
    monkeypatch.setattr(audit, "failures", lambda d, part: whole(d, part, blocks))
    got = audit.interactions(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    got = got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    assert sorted(map(tuple, got)) == audit_by_force(docs, LABELS)


def test_audit_of_many_ids_joins_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(audit, "FEW", 0)
    docs = [(1, "a", "s"), (2, "a", "s"), (3, "b", "s"), (4, "a", "t")]
    got = audit.failures(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in got if r["mask"] & audit.BITS["E"]} == {2, 4} and len(got) == 4


def test_audit_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert audit.interactions(docs, labels).count() == 0
    docs = spark.createDataFrame([(1, "a", "s", 1, "m"), (2, "a", "s", 2, "m")], "doc_id long, text string, source string, mask int, cls string")
    got = audit.interactions(docs.withColumns({c: audit.F.lit(1) for c in ("part", "size", "hashes", "good", "toxic", "copy")}), labels)
    assert got.count() == 600 and got.filter("filter_order = 'EABCD' and step = 1").first().removed == 1


# 13 --------------------------------------------------------------------------


def middle_by_force(i, t, seed=7, rate=100, spm=50):
    t = t or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    n = len(u)
    x = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def middle_docs():
    rng = random.Random(9)
    bits = ["a", "é", "\n", "<", "P", ">", "S", "M", "😀", "\r\n", "<P", "<S>"]
    docs = [(i, "".join(rng.choice(bits[: rng.choice([3, 9, 12])]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    return docs + [(300, None), (301, ""), (302, "\n"), (303, "x" * 100_000 + "\n" + "é" * 50_000), (None, "a\nb\nc"), (5, docs[5][1]), (5, "other\ntext\n"), (304, "<P>"), (305, "a\n<P")]


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 20)])
def test_middle_equals_brute_force(spark, rate, spm):
    docs = middle_docs()
    made = fim.transform(spark.createDataFrame(docs, "doc_id long, text string"), rate=rate, spm=spm)
    got = made.withColumn("back", fim.restored(made["output"], made["form"])).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((middle_by_force(i, t, 7, rate, spm) for i, t in docs), key=str)
    assert sorted((r.back, str(r.doc_id)) for r in got) == sorted((t or "", str(i)) for i, t in docs)


def test_middle_kernel_is_the_same_in_any_batches():
    docs = middle_docs()
    batch = fim.pa.RecordBatch.from_pydict({"doc_id": fim.pa.array([i for i, _ in docs], fim.pa.int64()), "text": fim.pa.array([t for _, t in docs], fim.pa.string())})

    def all_of(together, part):
        out = []
        for first, data, offsets in fim.pieces_of(part, together):
            out += fim.solve(data, offsets, part.column("doc_id").slice(first, len(offsets) - 1).to_pylist(), 7, 100, 50)["output"]
        return out

    whole = all_of(fim.TOGETHER, batch)
    assert whole == all_of(1, batch) == all_of(100, batch) and whole[50:] == all_of(100, batch.slice(50))


def test_middle_empty_table_and_clashing_columns(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a\nb\n", "x", 3)], "doc_id long, text string, form string, n int")
    assert tuple(fim.transform(df).first()) == middle_by_force(1, "a\nb\n")
