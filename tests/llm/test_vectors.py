"""Hard negatives and whitening against plain versions."""

import glob
import math
import os
import random
from fractions import Fraction

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def plain_negatives(rows, every=50, most=5, negatives=3, low=50, high=95):
    """All pairs, by the definition; rows are (id, vector, label)."""
    whole = [(i, [math.floor(256 * c) for c in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, x, lab) in enumerate(whole):
        if i is None or i % every:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), j is None, j or 0, other) for b, (j, y, other) in enumerate(whole) if b != a]
        name = lambda t: None if t[1] else t[2]
        for p in sorted(t for t in scored if t[3] == lab)[:most]:
            inside = sorted(t for t in scored if t[3] != lab and -low * p[0] <= -100 * t[0] <= -high * p[0])
            out += [(i, name(p), k + 1, name(t), -p[0], -t[0]) for k, t in enumerate(inside[:negatives])]
    return sorted(out, key=repr)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def hard_vectors(n, dims, labels, spread, seed):
    """Few different numbers, so scores tie; repeated rows and ids, null ids, and vectors that take no part."""
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-spread, spread + 1) / 256 for _ in range(dims)], rng.randrange(labels)) for i in range(n)]
    rows += rows[:3] + [(50, [0.5] * dims, 0)] * 4 + [(None, [0.25] * dims, 1), (None, [0.25] * dims, 0)]
    rows += [(100, None, 1), (150, [NAN] * dims, 1), (200, [INF] * dims, 1), (250, [None] * dims, 1), (300, [1.0] * dims, None)]
    rows += [(350, [1.0, 0.5], 2), (51, [], 2)]
    return rows


def table(spark, rows):
    kinds = "vec_id long, embedding array<double>, label int, place string, x string, id string, q string, n string, d string, score string"
    return spark.createDataFrame([(*r, *"abcdefg") for r in rows], kinds)


@pytest.mark.parametrize("dims, labels, spread, tree_rows, block_bytes", [(4, 3, 8, 64, 1 << 20), (8, 1, 100, 50, 300), (3, 40, 3, 7, 1 << 20), (6, 2, 1, 1000, 200)])
def test_hard_negatives_are_those_of_all_pairs(spark, dims, labels, spread, tree_rows, block_bytes):
    from tonearm.llm.hard_negatives import hard_negatives

    rows = hard_vectors(400, dims, labels, spread, dims)
    got = found(hard_negatives(table(spark, rows), tree_rows=tree_rows, block_bytes=block_bytes))
    assert got == plain_negatives(rows)
    assert got or labels == 1


def test_hard_negatives_query(spark):
    """The whole smallest table, by the plain version and by SQL."""
    import duckdb

    from tonearm.llm import queries

    got = found(queries.op11_hard_negatives(spark, SF))
    rows = [(r.vec_id, r.embedding, r.label if r.vec_id % 7 else (r.label + 1) % 10) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got == plain_negatives(rows) and got
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    q = c.execute(queries.oracle_sql()["op11_hard_negatives"])
    at = [[d[0] for d in q.description].index(k) for k in COLUMNS]
    assert got == sorted((tuple(r[i] for i in at) for r in q.fetchall()), key=repr)


def test_hard_negatives_of_little(spark):
    from tonearm.llm.hard_negatives import hard_negatives

    assert found(hard_negatives(table(spark, []))) == []
    assert found(hard_negatives(table(spark, [(1, [1.0], 0), (2, [1.0], 1)]))) == []
    assert found(hard_negatives(table(spark, [(50, [1.0], 0), (51, [], 0), (52, [0.6], 1)]))) == []
    big = [(0, [1e30, 1.0], 0), (1, [1e30, 1.0], 0), (2, [1e9, 1.0], 1), (3, [6e6, 0.0], 1)]
    assert [r[1:4:2] for r in found(hard_negatives(table(spark, big)))] == [(1, 3)]
    with pytest.raises(TypeError):
        hard_negatives(spark.createDataFrame([("a", [1.0], 0)], "vec_id string, embedding array<double>, label int"))


def test_boxes_bound_and_prune():
    """Every row's score lies in the intervals of all boxes that hold it, and clustered rows are found without looking at most leaves."""
    from tonearm.llm import rtree

    rng = np.random.default_rng(2)
    centres = rng.integers(-2000, 2000, (40, 6))
    x = centres[rng.integers(0, 40, 5000)] + rng.integers(-20, 20, (5000, 6))
    label = rng.integers(0, 3, 5000)
    order = rtree.str_order(x, label, list(range(6)), 32)
    assert sorted(order.tolist()) == list(range(5000))
    x, label = x[order].astype(float), label[order]
    tree = rtree.Tree(x, label, 32, 4)
    q = x[::500]
    low, high = tree.bounds(q)
    scores = q @ x.T
    for node in range(tree.nodes):
        below, leaves = [node], []
        while below:
            k = below.pop()
            (leaves.append(k) if k < tree.leaves else below.extend(tree.children[k]))
        held = np.concatenate([np.arange(k * 32, min(k * 32 + 32, 5000)) for k in leaves])
        assert (low[:, node] <= scores[:, held].min(axis=1)).all() and (scores[:, held].max(axis=1) <= high[:, node]).all()
    looked = []

    class Counted(np.ndarray):
        def __getitem__(self, k):
            looked.append(k)
            return super().__getitem__(k).view(np.ndarray)

    tree.x = x.view(Counted)
    held = [[] for _ in q]
    rtree.nearest(tree, rtree.Rows(np.arange(5000), np.zeros(5000, bool), np.arange(5000)), q, label[::500], np.arange(0, 5000, 500), held, 5)
    for k, own in enumerate(held):
        same = [j for j in range(5000) if label[j] == label[500 * k] and j != 500 * k]
        assert own == sorted((-int(scores[k, j]), False, j) for j in same)[:5]
    assert len(looked) < 0.2 * tree.leaves * len(q)


@pytest.mark.parametrize("low, high", [(-150, 150), (0, 0), (-5, -5), (-(1 << 63), (1 << 63) - 1), (-(1 << 40), 1 << 20)])
@pytest.mark.parametrize("rows", [1, 64, 137])
def test_cross_products_are_exact(low, high, rows):
    from tonearm.llm.whitening import LIMBS, cross_products, limbs

    x = np.random.default_rng(rows).integers(low, high, (rows, 5), endpoint=True)
    sums, both = cross_products(x)
    plain = x.astype(object)
    assert sums.tolist() == plain.sum(axis=0).tolist()
    assert both.tolist() == (plain.T @ plain).tolist()
    for value in [*sums.tolist(), *both.ravel().tolist()]:
        assert sum(part << (32 * k) for k, part in enumerate(limbs(int(value)))) == value and len(limbs(int(value))) == LIMBS


def plain_whitening(rows, keep=4):
    """{(row, component): (n, deviation, |whitened|, explained)} by exact fractions and numpy's eigh."""
    whole = [(k, v) for k, (_, v) in enumerate(rows) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in whole), default=0)
    if not dims:
        return {}
    x = {k: tuple([math.floor(256 * c) for c in v] + [0] * (dims - len(v))) for k, v in whole}
    fit = sorted(set(x.values()))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    cov = np.array([[float(Fraction(sum(v[d] * v[e] for v in fit) * n - s[d] * s[e], n * n)) for e in range(dims)] for d in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    out = {}
    for k, v in x.items():
        for c in range(min(keep, dims)):
            value, vector = values[dims - 1 - c], vectors[:, dims - 1 - c]
            flat = value <= cov.trace() * dims * 1e-15
            white = None if flat else abs(sum(float(Fraction(n * a - b, n)) * w for a, b, w in zip(v, s, vector))) / math.sqrt(value)
            out[k, c + 1] = (n, sum((n * a - b) ** 2 for a, b in zip(v, s)), white, value / cov.trace() if cov.trace() > 0 else None)
    return out


def check_whitening(spark, rows):
    from tonearm.llm.whitening import whiten

    docs = spark.createDataFrame([(k, v, "x", "y", "z") for k, (_, v) in enumerate(rows)], "vec_id long, embedding array<double>, x string, component string, n string")
    got = {(r.vec_id, r.component): r for r in whiten(docs).collect()}
    want = plain_whitening(rows)
    assert got.keys() == want.keys()
    for key, (n, deviation, white, explained) in want.items():
        r = got[key]
        assert r.n == n and r.deviation == (deviation if deviation < 10**38 else None)
        assert (r.whitened is None) == (white is None) and (white is None or abs(abs(r.whitened) - white) < 1e-6 * max(1, white))
        assert (r.explained is None) == (explained is None) and (explained is None or abs(r.explained - explained) <= 1e-9)
        assert r.identity_error is None or r.identity_error < 1e-8
    return got


def test_whitening_of_hard_rows(spark):
    rng = random.Random(4)
    rows = [(0, [rng.gauss(0, 3) * (d + 1) for d in range(6)]) for _ in range(200)]
    rows += rows[:40] * 2 + [(0, None), (0, [NAN] * 6), (0, [1.0, None]), (0, [INF]), (0, [1.0, 2.0]), (0, []), (0, [0.0])]
    check_whitening(spark, rows)
    flat = check_whitening(spark, [(0, [float(k), 2.0 * k, 1.0]) for k in range(30)])
    assert flat[0, 1].whitened is not None and flat[0, 2].whitened is None
    assert {r.whitened for r in check_whitening(spark, [(0, [1.0, 2.0])] * 5).values()} == {None}
    assert not check_whitening(spark, [(0, None), (0, [])])
    assert not check_whitening(spark, [])


def test_whitening_of_huge_numbers(spark):
    rng = random.Random(5)
    got = check_whitening(spark, [(0, [rng.random() * 1e13, -rng.random() * 1e9]) for _ in range(50)])
    assert any(r.deviation is not None for r in got.values())
    assert any(r.deviation is None for r in check_whitening(spark, [(0, [rng.random() * 1e16, 1.0]) for _ in range(2000)]).values())


def test_whitening_query(spark):
    from tonearm.llm import queries

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    out = queries.op13_whitening(spark, SF)
    assert dict(out.dtypes) | {"vec_id": ""} == {"vec_id": "", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    want = plain_whitening(rows)
    got = {(r.vec_id, r.component): r for r in out.collect()}
    assert len(got) == len(want) == 4 * len(rows)
    place = {i: k for k, (i, _) in enumerate(rows)}
    for (i, c), r in got.items():
        n, deviation, white, explained = want[place[i], c]
        assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - white) < 1e-9 and abs(r.explained - explained) < 1e-12 and r.identity_error < 1e-10
