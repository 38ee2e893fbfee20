"""Exact top-k search and hard negatives against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from telemill.llm import _meet, annuli, dualtree, queries
from telemill.llm._text import Tables

SCHEMA = "vec_id long, embedding array<float>, label int, score double, cell int"
ODD = [(9001, None, 1), (9002, [0.1, None], 1), (9003, [float("nan"), 0.1], 1), (9004, [float("inf"), 1.0], 1), (9005, [], 1), (None, [0.5, 0.5], 1), (9100, None, None)]


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 9.0, -1) for i, v, label in rows], SCHEMA)


def floored(rows, factor):
    for i, v, label in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            yield i, [int(np.floor(factor * float(np.float32(x)))) for x in v], label


def brute_top(rows, queries_of, k, factor=1024):
    rows = list(floored(rows, factor))
    asked: dict = {}
    for i, v, _ in rows:
        if queries_of(i):
            asked[i] = min(v, asked.get(i, v))
    out = []
    for q, w in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, v, _ in rows if i != q and len(v) == len(w))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def brute_negatives(rows, anchors_of):
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 and label is not None else label) for i, v, label in floored(rows, 256)]
    rows = [r for r in rows if r[2] is not None]
    asked: dict = {}
    for i, v, label in rows:
        if anchors_of(i):
            asked[i] = min((label, v), asked.get(i, (label, v)))
    out = []
    for a, (label, w) in asked.items():
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, kind) for i, v, kind in rows if i != a and len(v) == len(w)]
        for s, p in sorted((s, i) for s, i, kind in scored if kind == label)[:5]:
            fine = sorted((t, i) for t, i, kind in scored if kind != label and 50 * -s <= 100 * -t <= 95 * -s)
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(fine[:3])]
    return sorted(out)


def made(rng, n, width, kind):
    if kind == "ties":
        x = rng.integers(-2, 3, (n, width)) / 4
    elif kind == "clustered":
        x = rng.normal(size=(max(1, n // 40), width))[rng.integers(0, max(1, n // 40), n)] + rng.normal(size=(n, width)) * 0.05
    else:
        x = rng.normal(size=(n, width)) * rng.choice([0.1, 1, 5], (n, 1))
    x[rng.random(n) < 1 / 3] = x[0]
    rows = [(i, x[i].astype(np.float32).tolist(), int(rng.integers(0, 4)) if rng.random() < 0.95 else None) for i in range(n)]
    return rows + rows[: n // 10] + [(50, x[1].astype(np.float32).tolist(), 2), (100, x[2].astype(np.float32).tolist(), 0)]


@pytest.mark.parametrize(("kind", "width"), [("ties", 3), ("clustered", 8), ("scaled", 5)])
def test_both_are_brute_force(spark, tmp_path, kind, width):
    rng = np.random.default_rng(width)
    rows = made(rng, 600, width, kind) + ODD + [(20_000 + 100 * i, [0.5, 0.25 * i], i) for i in range(4)]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries.QUERIES["op12_top_k"](spark, str(tmp_path)).collect()))
    assert got == brute_top(rows, lambda i: i % 100 == 0, 10)
    got = sorted(map(tuple, queries.QUERIES["op11_hard_negatives"](spark, str(tmp_path)).collect()))
    assert got == brute_negatives(rows, lambda i: i % 50 == 0) and got


def test_small_groups_and_many_cells_give_the_same(spark, monkeypatch):
    """Blocks, chunks, annuli and leaves far smaller than usual, so that every path is taken."""
    for where, name, value in ((_meet, "BLOCK_ROWS", 40), (_meet, "CHUNK_ROWS", 5), (annuli, "ANNULUS_ROWS", 10), (annuli, "SECOND_ROWS", 64), (annuli, "EXPAND", 3), (dualtree, "LEAF_ROWS", 30), (dualtree, "LEAF_ANCHORS", 4), (annuli, "SAMPLE", 200), (dualtree, "SAMPLE", 200)):
        monkeypatch.setattr(where, name, value)
    rows = made(np.random.default_rng(9), 500, 6, "clustered")
    v = _meet.scaled(table(spark, rows), 1024)
    got = sorted(map(tuple, annuli.top_k(v, v.filter("vec_id % 20 = 0"), 4).collect()))
    assert got == brute_top(rows, lambda i: i % 20 == 0, 4)
    v = _meet.scaled(table(spark, rows), 256, "label").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    got = sorted(map(tuple, dualtree.hard_negatives(v, v.filter("vec_id % 20 = 0")).collect()))
    assert got == brute_negatives(rows, lambda i: i % 20 == 0)


def test_groups_hold_a_set_number_of_rows_on_either_side(spark, monkeypatch):
    """A cell of rows alike and one of many that ask: each pair meets once, in groups of bounded size."""
    monkeypatch.setattr(_meet, "BLOCK_ROWS", 500)
    monkeypatch.setattr(_meet, "CHUNK_ROWS", 50)
    rows = spark.createDataFrame([(0 if i % 3 else 1 + i % 4, 7) for i in range(6000)], "cell int, vec_id long")
    asked = spark.createDataFrame([(i % 2, 9) for i in range(800)] + [(77, 9)], "cell int, query_id long")

    def score(left, right):
        return pa.table({"cell": pa.array([(left if left.num_rows else right).column("cell")[0].as_py()], pa.int32()), "l": [left.num_rows], "r": [right.num_rows]})

    got = _meet.meet(rows, asked, ("cell",), score, "cell int, l long, r long", Tables(spark)).collect()
    assert max(r["l"] for r in got) <= 750 and max(r["r"] for r in got) <= 100 and len(got) > 40
    pairs = {c: sum(r["l"] * r["r"] for r in got if r["cell"] == c) for c in (0, 1)}
    assert pairs == {0: 4000 * 400, 1: rows.filter("cell = 1").count() * 400}


def test_clustered_vectors_are_scored_in_part(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 20_000)] + rng.normal(size=(20_000, 16)) * 0.02
    v = spark.createDataFrame([(i, [int(a) for a in np.floor(1024 * x[i])]) for i in range(len(x))], "vec_id long, vector array<long>")
    got = annuli.top_k(v, v.filter("vec_id % 1000 = 0"), count=True).collect()
    whole = np.floor(1024 * x).astype(np.int64)
    for q in range(0, 20_000, 1000):
        s = whole @ whole[q]
        s[q] = -(1 << 62)
        best = np.lexsort((np.arange(len(s)), -s))[:10]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(i, s[i]) for i in best.tolist()]
    assert np.mean([r["n_scored"] for r in got]) < 0.25 * len(x)


def test_bounds_of_annuli_hold():
    rng = np.random.default_rng(1)
    for scale in (1, 1000, 10**6):
        x = np.floor(rng.normal(size=(3000, 7)) * scale * rng.choice([0.01, 1], (3000, 1))).astype(np.int64)
        square = float((x.astype(float) ** 2).sum(1).max())
        model = annuli.learn(x[:500], len(x), square)
        cell, r = annuli.keys(model, x)
        own = np.unique(cell)
        directory = {"cell": own, "rows": np.bincount(cell)[own], "near": np.array([r[cell == c].min() for c in own]), "far": np.array([r[cell == c].max() for c in own])}
        q = np.floor(rng.normal(size=(20, 7)) * scale).astype(np.int64)
        bound, s = annuli.bounds(model, directory, q), _meet.products(q, x)
        assert all((s[:, cell == c].max(1) <= bound[:, k]).all() for k, c in enumerate(own))


def test_intervals_of_nodes_hold_and_no_pair_is_lost():
    rng = np.random.default_rng(2)
    x, a = (np.floor(rng.normal(size=(n, 5)) * 100 + rng.normal(size=5) * 200).astype(np.int64) for n in (2000, 300))
    ct, at = dualtree.grow(x[:400], 5), dualtree.grow(a[:200], 3)
    (lc, dc), (la, da) = dualtree.route(ct, x), dualtree.route(at, a)
    rc = dualtree.radii(ct, np.array([dc[lc == i].max(initial=-np.inf) for i in range(32)]))
    ra = dualtree.radii(at, np.array([da[la == i].max(initial=-np.inf) for i in range(8)]))
    s = _meet.products(a, x)
    low, high = np.sort(s, 1)[:, -20], np.sort(s, 1)[:, -3]
    leaves = lambda v, f: np.array([f(v[la == i]) if (la == i).any() else -np.inf for i in range(8)], float)
    lows = -dualtree.upward(at, leaves(-low, np.max), lambda i, c, v: v)
    highs = dualtree.upward(at, leaves(high, np.max), lambda i, c, v: v)
    got = set(zip(*map(np.ndarray.tolist, dualtree.leaf_pairs(at, ct, ra, rc, lows, highs, 0)), strict=True))
    assert {(int(la[i]), int(lc[j])) for i, j in zip(*np.nonzero((s >= low[:, None]) & (s <= high[:, None])), strict=True)} <= got
    assert len(got) < 8 * 32


def test_large_products_are_exact():
    a, b = np.array([[3_000_000_001, -5]]), np.array([[2_999_999_999, 7], [0, 1]])
    assert _meet.products(a, b).tolist() == [[3_000_000_001 * 2_999_999_999 - 35, -5]]


def test_empty_tables(spark, tmp_path):
    table(spark, ODD).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    table(spark, []).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    table(spark, [(100, [1.0, 0.0], 3)]).write.parquet(f"{tmp_path}/c/embeddings.parquet")
    for name in ("op11_hard_negatives", "op12_top_k"):
        for folder in "abc":
            assert queries.QUERIES[name](spark, f"{tmp_path}/{folder}").count() == 0
    with pytest.raises(ValueError):
        dualtree.hard_negatives(None, None, lower=95, upper=50)
