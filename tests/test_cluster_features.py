"""Cluster features: what they keep when they merge, and trees against Ward over the rows themselves."""

import numpy as np
import pytest

from tonearm.operators import cluster as C
from tonearm.operators import cluster_features as CF
from tonearm.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain_ward(m, k):
    """Merge the pair of clusters whose sum of squares grows least until k are left."""
    groups = [[i] for i in range(len(m))]
    centre, size = m.astype(float).copy(), np.ones(len(m))
    while len(groups) > k:
        d = ((centre[:, None] - centre[None]) ** 2).sum(2) * (size[:, None] * size[None] / (size[:, None] + size[None]))
        d[np.tril_indices(len(d))] = np.inf
        a, b = np.unravel_index(d.argmin(), d.shape)
        centre[a] = (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
        size[a] += size[b]
        groups[a] += groups.pop(b)
        centre, size = np.delete(centre, b, 0), np.delete(size, b)
    return {frozenset(g) for g in groups}


def plain_silhouette(m, labels):
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    out = []
    for i, own in enumerate(labels):
        mates = [j for j in range(len(m)) if labels[j] == own and j != i]
        if not mates:
            out.append(0.0)
            continue
        a = d[i, mates].mean()
        b = min(d[i, labels == o].mean() for o in set(labels) - {own})
        out.append((b - a) / max(a, b))
    return np.mean(out)


def groups(labels):
    return {frozenset(np.flatnonzero(labels == x)) for x in set(labels)}


def plain_tree(m, target, least, children, depth):
    """Leaves of the recursion over rows, with the library's score of a split."""
    out = []

    def grow(at, level):
        labels = None
        if level < depth - 1 and len(at) > target and len(at) >= 2 * least:
            labels = C.best_split(m[at], target, least, children)
        if labels is None:
            out.append(frozenset(at))
            return
        for x in sorted(set(labels)):
            grow(at[labels == x], level + 1)

    grow(np.arange(len(m)), 0)
    return set(out)


def test_ward_is_ward():
    rng = np.random.default_rng(1)
    m = rng.normal(0, 1, (60, 3))
    for k in (2, 3, 7):
        assert groups(C.ward_labels(m, k)) == plain_ward(m, k)


def test_weights_stand_for_rows():
    """A row given three times, or once with the weight three, gives the same clusters and scores."""
    rng = np.random.default_rng(2)
    m, w = rng.normal(0, 1, (30, 2)), rng.integers(1, 4, 30)
    many = np.repeat(m, w, axis=0)
    back = np.repeat(np.arange(30), w)
    for k in (2, 3, 5):
        labels = C.cut(C.ward_merges(m, w), k)
        assert groups(labels[back]) == groups(C.ward_labels(many, k))
        assert C.silhouette(m, labels, w) == pytest.approx(plain_silhouette(many, labels[back]))
        assert C.separation(m, labels, w) == pytest.approx(C.separation(many, labels[back]))


def test_features_keep_sums():
    rng = np.random.default_rng(3)
    m, ids = rng.normal(5, 2, (500, 4)), rng.permutation(500)
    s = CF.Summary(20)
    for at in range(0, 500, 37):
        s.add(CF.of_rows(m[at : at + 37], ids[at : at + 37]))
    f = s.done()
    assert len(f.n) == 20 and f.n.sum() == 500 and f.first[0] == 0
    assert np.allclose(np.average(f.centre, axis=0, weights=f.n), m.mean(0))
    total = f.sse.sum() + (f.n * ((f.centre - m.mean(0)) ** 2).sum(1)).sum()
    assert total == pytest.approx(((m - m.mean(0)) ** 2).sum())
    one = CF.Summary(20)
    one.add(CF.of_rows(m[:20], ids[:20]))
    assert one.height is None and sorted(one.done().first) == sorted(ids[:20])


def test_repeated_rows_fold():
    s = CF.Summary(4)
    s.add(CF.of_rows(np.ones((50, 2)), np.arange(50)))
    f = s.done()
    assert len(f.n) == 4 and f.n.sum() == 50 and f.sse.max() == 0


def test_merging_rounds(spark):
    """Features of many parts merge to a bounded number without losing a row; paths stay apart."""
    rng = np.random.default_rng(4)
    m = rng.normal(0, 1, (900, 3))
    rows = spark.createDataFrame([(i, m[i].tolist(), "a" if i % 3 else "b") for i in range(900)], "id long, vector array<double>, path string")
    out = CF.cluster_features(rows.repartition(40, "id"), 40, 16).toPandas()
    for path, own in (("a", m[np.arange(900) % 3 != 0]), ("b", m[::3])):
        f = out[out.path == path]
        assert len(f) == 16 and f.n.sum() == len(own)
        assert np.allclose(np.average(np.stack(f.centre.to_numpy()), axis=0, weights=f.n), own.mean(0))


def test_tree_of_the_stored_rows_is_the_recursion_over_rows(spark):
    tree = catalogue.queries()["playlist_tree"](spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    m, ids = np.stack(rows["embedding"].to_numpy()).astype(float), rows["vec_id"].to_numpy()
    want = {frozenset(ids[list(g)]) for g in plain_tree(m, 24, 8, 4, 3)}
    assert {frozenset(g) for g in tree.groupby("path")["id"].apply(list)} == want


def test_large_clusters_split_like_their_rows_where_groups_are_plain(spark):
    """3,000 rows around twelve places in four regions, sixty features a cluster: the tree finds the regions, then the places."""
    rng = np.random.default_rng(5)
    place = rng.integers(0, 12, 3000)
    at = np.array([[100.0 * (p // 3), 10.0 * (p % 3)] for p in range(12)])
    m = at[place] + rng.normal(0, 0.3, (3000, 2))
    d = spark.createDataFrame([(i, m[i].tolist()) for i in range(3000)], "id long, vector array<double>")
    tree = CF.playlist_tree(d, target=250, least=20, most_children=4, max_depth=3, max_leaves=60).toPandas().sort_values("id")
    assert tree["id"].tolist() == list(range(3000)) and set(tree["depth"]) == {2}
    assert {frozenset(g) for g in tree.groupby("path")["id"].apply(list)} == {frozenset(np.flatnonzero(place == p)) for p in range(12)}


def test_empty_and_equal_rows(spark):
    schema = "id long, vector array<double>"
    assert CF.playlist_tree(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(100)], schema)
    out = CF.playlist_tree(same, max_leaves=16).collect()
    assert sorted(r.id for r in out) == list(range(100))
