"""Vector scaling, clustering, ordering and naming of playlist trees.

Scaling and summaries are DataFrame aggregates. The split search works on the rows of one cluster, or on what stands for them
(``operators/cluster_features.py``, which grows the trees); orders need all rows of one cluster at once and run per cluster in ``applyInPandas``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonearm.functions import numeric as N
from tonearm.operators.order_statistics import order_statistics

#: Fixed values of the split search.
WEAK_SILHOUETTE, WEAK_SEPARATION, FORCE_RATIO = 0.08, 1.0, 2.5
ARTIST_PENALTY, ALBUM_PENALTY = (0.35, 0.2, 0.1), (0.2, 0.1, 0.05)
DIVERSITY = {"loose": 0.0, "balanced": 1.0, "strict": 2.0}
#: Metric, label of its lowest, lower, higher and highest sibling, least spread, priority.
SIBLING_LABELS = (("tempo", "Slowest", "Slower", "Faster", "Fastest", 8.0, 0), ("energy", "Lowest Energy", "Lower Energy", "Higher Energy", "Highest Energy", 0.08, 1), ("brightness", "Warmest", "Warm", "Bright", "Brightest", 350.0, 3), ("density", "Sparsest", "Sparse", "Dense", "Densest", 350.0, 4), ("attack", "Smoothest", "Smooth", "Punchy", "Punchiest", 0.35, 5), ("percussion", "Smoothest", "Smooth", "Percussive", "Most Percussive", 0.02, 6), ("tone", "Most Open", "Open", "Tonal", "Most Tonal", 3.0, 7))


def robust_limits(x: DataFrame) -> DataFrame:
    """(pos, centre, scale) of (pos, x): median, and nearest-rank inter-quartile range, or half the range, or one. A position's values are in no task all at once, and none is written."""
    share = lambda p: lambda n: F.bround((n - 1) * F.lit(p))
    v = order_statistics(x, {"q1": share(0.25), "q3": share(0.75), "a": lambda n: F.floor((n - 1) / 2), "b": lambda n: F.ceil((n - 1) / 2)})
    iqr, half = F.col("q3") - F.col("q1"), (F.col("high") - F.col("low")) / 2
    return v.select("pos", (0.5 * F.col("a") + 0.5 * F.col("b")).alias("centre"), F.when(iqr > 1e-9, iqr).when(half > 1e-9, half).otherwise(1.0).alias("scale"))


def centroids(rows: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """(key, centroid): element-wise means, summed with map-side combine."""
    means = rows.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c")).select(key, F.transform("c", lambda v: v["m"]).alias("centroid"))


def pairwise(m: np.ndarray) -> np.ndarray:
    s = (m * m).sum(1)
    return np.sqrt(np.maximum(s[:, None] + s[None] - 2 * m @ m.T, 0))


def ward_merges(m: np.ndarray, weights: np.ndarray | None = None) -> list[tuple[float, int, int]]:
    """(height, a, b) of agglomerative clustering by least growth of within-cluster variance, lowest first, by nearest-neighbour chains.

    Row i stands for ``weights[i]`` rows (one, if none are given) at its place; a height is twice the growth of the sum of squares.
    """
    n = len(m)
    size = np.ones(n) if weights is None else weights.astype(float)
    d = pairwise(m) ** 2 * (2 * size[:, None] * size[None] / (size[:, None] + size[None]))
    np.fill_diagonal(d, np.inf)
    alive, merges, chain = np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            row = np.where(alive, d[chain[-1]], np.inf)
            best = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[best]:
                best = chain[-2]
            if len(chain) > 1 and best == chain[-2]:
                break
            chain.append(best)
        a, b = chain.pop(), chain.pop()
        merges.append((float(d[a, b]), a, b))
        total = size[a] + size[b] + size
        d[a] = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / total
        d[:, a], d[a, a] = d[a], np.inf
        size[a] += size[b]
        alive[b] = False
    return sorted(merges, key=lambda x: x[0])


def cut(merges: list[tuple[float, int, int]], k: int) -> np.ndarray:
    """Labels of the ``k`` clusters that all but the last merges leave, in order of first member."""
    n = len(merges) + 1
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for _, a, b in merges[: n - k]:
        parent[root(b)] = root(a)
    return pd.factorize(np.array([root(i) for i in range(n)]))[0]


def ward_labels(m: np.ndarray, k: int) -> np.ndarray:
    return cut(ward_merges(m), k)


def kmeans_labels(m: np.ndarray, k: int, seed: int, rounds: int = 50, weights: np.ndarray | None = None) -> np.ndarray:
    """Lloyd's rounds from a spread-out seeding; row i stands for ``weights[i]`` rows."""
    rng = np.random.default_rng(seed)
    w = np.ones(len(m)) if weights is None else weights.astype(float)
    picked = [int(rng.integers(len(m)))]
    for _ in range(1, k):
        d = w * ((m[:, None] - m[picked][None]) ** 2).sum(2).min(1)
        picked.append(int(rng.choice(len(m), p=d / d.sum())) if d.sum() > 0 else int(rng.integers(len(m))))
    c = m[picked].copy()
    labels = np.zeros(len(m), int)
    for _ in range(rounds):
        new = ((m[:, None] - c[None]) ** 2).sum(2).argmin(1)
        if (new == labels).all() and _:
            break
        labels = new
        for j in range(k):
            if (labels == j).any():
                c[j] = np.average(m[labels == j], axis=0, weights=w[labels == j])
    return pd.factorize(labels)[0]


def silhouette(m: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, spread: np.ndarray | None = None) -> float:
    """Mean silhouette. Where rows stand for several (``weights``) around them (``spread``, their mean squared distance), distances are root mean squares."""
    kinds = np.unique(labels)
    w = np.ones(len(m)) if weights is None else weights.astype(float)
    if not 1 < len(kinds) < w.sum():
        return 0.0
    v = np.zeros(len(m)) if spread is None else spread
    d = np.sqrt(pairwise(m) ** 2 + v[:, None] + v[None])
    np.fill_diagonal(d, np.sqrt(2 * v * w / np.maximum(w - 1, 1)) * (w - 1) / w)
    sums = np.stack([(d * w)[:, labels == j].sum(1) for j in kinds], 1)
    sizes = np.array([w[labels == j].sum() for j in kinds])
    own = np.searchsorted(kinds, labels)
    at = np.arange(len(m))
    inner = sums[at, own] / np.maximum(sizes[own] - 1, 1)
    other = sums / sizes
    other[at, own] = np.inf
    outer = other.min(1)
    s = np.where(sizes[own] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-12), 0)
    return float(np.average(s, weights=w))


def separation(m: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, spread: np.ndarray | None = None) -> float:
    kinds = np.unique(labels)
    if len(kinds) < 2:
        return 0.0
    w = np.ones(len(m)) if weights is None else weights.astype(float)
    v = np.zeros(len(m)) if spread is None else spread
    c = np.stack([np.average(m[labels == j], axis=0, weights=w[labels == j]) for j in kinds])
    inner = np.mean([np.average(np.sqrt(((m[labels == j] - c[k]) ** 2).sum(1) + v[labels == j]), weights=w[labels == j]) for k, j in enumerate(kinds)])
    gaps = pairwise(c)[np.triu_indices(len(kinds), 1)]
    return 0.0 if gaps.min() <= 1e-9 else float(gaps.min() / max(inner, 1e-9))


def target_fit(sizes, target: int) -> float:
    return float(np.mean([max(0.0, 1 - abs(s - target) / target) for s in sizes])) if target > 0 and len(sizes) else 0.0


def best_split(m: np.ndarray, target: int, least: int, most_children: int, weights: np.ndarray | None = None, spread: np.ndarray | None = None) -> np.ndarray | None:
    """Labels of the best Ward split in 2 to ``most_children`` parts of at least ``least`` rows, or None if all are weak."""
    best = None
    w = np.ones(len(m)) if weights is None else weights.astype(float)
    most = min(most_children, int(w.sum()) // max(least, 1), len(m))
    merges = ward_merges(m, w) if most > 1 else []
    for k in range(2, most + 1):
        labels = cut(merges, k)
        sizes = np.bincount(labels, weights=w)
        if len(sizes) != k or sizes.min() < least:
            continue
        sil, sep = silhouette(m, labels, w, spread), separation(m, labels, w, spread)
        score = max(0.0, (sil + 1) / 2) * 0.45 + (sep / (sep + 1) if sep > 0 else 0) * 0.2 + sizes.min() / sizes.max() * 0.15 + target_fit(sizes, target) * 0.2
        if best is None or score > best[0]:
            best = (score, sil, sep, labels)
    if best is None or (best[1] < WEAK_SILHOUETTE and best[2] < WEAK_SEPARATION and w.sum() < target * FORCE_RATIO):
        return None
    return best[3]


def chunk_labels(m: np.ndarray, k: int) -> np.ndarray:
    """Equal chunks in order of the first coordinate."""
    out = np.zeros(len(m), int)
    out[np.lexsort((np.arange(len(m)), m[:, 0]))] = np.minimum(k - 1, np.arange(len(m)) // max(1, math.ceil(len(m) / k)))
    return out


#: Fixed values of the seeded tie-break: multiplier, seed factor, 32 bits.
def seeded(ids: np.ndarray, seed: int) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(1103515245) + np.uint64(seed * 12345 & 0xFFFFFFFFFFFFFFFF)) & np.uint64(0xFFFFFFFF)


def medoid(m: np.ndarray, far, rank: np.ndarray, ids: np.ndarray, cells: int = 4_000_000) -> int:
    """The row of the least sum of distances, ties by rank, then id. Sums are first taken in blocks, whose rounding differs; those near the least are then taken row by row, once for equal rows."""
    squares = (m * m).sum(1)
    if not np.isfinite(squares).all():
        # No sum is a number then.
        return 0
    rough, chunk = np.empty(len(m)), max(1, cells // len(m))
    for lo in range(0, len(m), chunk):
        square = squares[lo : lo + chunk, None] + squares - 2 * (m[lo : lo + chunk] @ m.T)
        rough[lo : lo + chunk] = np.sqrt(np.maximum(square, 0, out=square), out=square).sum(1)
    # A square is off by some 1e-14 of the greatest one, so a distance by 1e-7 of its root at most.
    close = np.flatnonzero(rough <= rough.min() + 1e-6 * len(m) * np.sqrt(squares.max()))
    first, same = np.unique(m[close], axis=0, return_index=True, return_inverse=True)[1:]
    total = np.array([far(i).sum() for i in close[first]])[same.ravel()]
    return int(close[np.lexsort((ids[close], rank[close], total))[0]])


def rolling_order(m: np.ndarray, ids: np.ndarray, artists: list, albums: list, seed: int = 7, diversity: str = "balanced") -> list[int]:
    """From the medoid on, always the nearest row left, with a penalty for artists and albums of the last three; ties by seed, then id.

    Distances are worked out row by row: memory grows with the rows, not with their square. A step reads each row once and sorts ties only.
    """
    if len(m) <= 2:
        return list(range(len(m)))
    squares = (m * m).sum(1)
    far = lambda i: np.sqrt(np.maximum(squares[i] + squares - 2 * m @ m[i], 0))
    rank, scale = seeded(ids, seed), DIVERSITY.get(diversity, 1.0)
    fold = lambda xs: pd.factorize(pd.Series([x.casefold() if isinstance(x, str) and x else None for x in xs]))[0]
    members = lambda codes: dict(pd.Series(np.arange(len(codes))).groupby(codes).indices)
    artist, album = fold(artists), fold(albums)
    by_artist, by_album = members(artist), members(album)
    out = [medoid(m, far, rank, ids)]
    gone, none = np.zeros(len(m)), np.empty(0, int)
    gone[out[0]] = np.inf
    double = 2 * m
    while len(out) < len(m):
        near = double @ m[out[-1]]
        np.subtract(squares[out[-1]] + squares, near, out=near)
        np.sqrt(np.maximum(near, 0, out=near), out=near)
        cost = near + gone
        for p, x, y in zip(out[:-4:-1], ARTIST_PENALTY, ALBUM_PENALTY):
            one = by_artist[artist[p]] if artist[p] >= 0 else none
            other = by_album[album[p]] if album[p] >= 0 else none
            both = np.intersect1d(one, other, assume_unique=True)
            before = cost[both]
            cost[one] += scale * x
            cost[other] += scale * y
            cost[both] = before + scale * (x + y)
        least = cost.min()
        ties = np.flatnonzero(cost == least) if np.isfinite(least) else np.flatnonzero(gone == 0)
        pick = int(ties[np.lexsort((ids[ties], rank[ties], near[ties], cost[ties]))[0]])
        out.append(pick)
        gone[pick] = np.inf
    return out


def centre_out(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (id, key, vector) with ``position`` by distance from the key's centroid, then id."""
    far = rows.join(centroids(rows, key), key).withColumn("distance", N.distance(F.col("vector"), F.col("centroid")))
    return far.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy("distance", "id"))).drop("centroid")


def ordered_leaves(rows: DataFrame, seed: int = 7, diversity: str = "balanced") -> DataFrame:
    """(path, id, position) of (path, id, vector, artist, album), each leaf in rolling order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        order = rolling_order(np.stack(pdf["vector"].to_numpy()).astype(float), pdf["id"].to_numpy(), pdf["artist"].tolist(), pdf["album"].tolist(), seed, diversity)
        return pd.DataFrame({"path": pdf["path"], "id": pdf["id"].iloc[order].to_numpy(), "position": np.arange(1, len(pdf) + 1)})

    return rows.groupBy("path").applyInPandas(run, "path string, id long, position int")


def sibling_labels(summaries: DataFrame) -> DataFrame:
    """(parent, child, metric, label, score) of (parent, child, metric, value): extremes of each metric among siblings, up to three per child with distinct labels."""
    spec = summaries.sparkSession.createDataFrame([(m, low, lower, higher, high, spread, p) for m, low, lower, higher, high, spread, p in SIBLING_LABELS], "metric string, low string, lower string, higher string, high string, spread double, priority int")
    w = W.partitionBy("parent", "metric")
    x = summaries.where(F.col("value").isNotNull()).join(F.broadcast(spec), "metric")
    x = x.withColumn("k", F.row_number().over(w.orderBy("value", "child"))).withColumn("n", F.count("*").over(w)).withColumn("range", F.max("value").over(w) - F.min("value").over(w)).withColumn("mid", F.avg("value").over(w))
    label = F.when(F.col("k") == 1, F.col("low")).when(F.col("k") == F.col("n"), F.col("high")).when((F.col("n") >= 4) & (F.col("value") < F.col("mid")), F.col("lower")).when((F.col("n") >= 4) & (F.col("value") > F.col("mid")), F.col("higher"))
    score = F.when((F.col("k") == 1) | (F.col("k") == F.col("n")), 1.0).otherwise(F.abs(F.col("value") - F.col("mid")) / F.col("range"))
    named = x.where("n >= 2 AND range >= spread").withColumn("label", label).withColumn("score", F.bround(score, 3)).where("label IS NOT NULL AND score >= 0.12")
    first = named.withColumn("r", F.row_number().over(W.partitionBy("parent", "child", "label").orderBy(F.desc("score"), "priority"))).where("r = 1")
    return first.withColumn("r", F.row_number().over(W.partitionBy("parent", "child").orderBy(F.desc("score"), "priority", "label"))).where("r <= 3").select("parent", "child", "metric", "label", "score")


def unique_names(wanted: list[list[str]]) -> list[str]:
    """The first unused of each list, blind to case; else the last with the smallest free number."""
    used: set[str] = set()
    out = []
    for options in wanted:
        name = next((o for o in options if o.casefold() not in used), None)
        if name is None:
            k = 2
            while f"{options[-1]} {k}".casefold() in used:
                k += 1
            name = f"{options[-1]} {k}"
        used.add(name.casefold())
        out.append(name)
    return out


def adaptive_sizes(n: int) -> dict[str, int]:
    """Target size, least size, depth and children for ``n`` rows."""
    target = max(24, min(round(math.sqrt(max(n, 1)) * 2.2), 48))
    return {"target": target, "least": max(6, min(round(target * 0.35), 18)), "depth": 2 if n < 180 else 3, "children": 4 if n < 500 else 5}


def projected_shape(n: int, target: int, least: int, children: int, depth: int) -> dict:
    """What an even recursive split of ``n`` rows gives: playlists per depth and leaf sizes."""
    per_depth: dict[int, int] = {}
    leaves: list[int] = []

    def grow(size: int, at: int) -> None:
        per_depth[at] = per_depth.get(at, 0) + 1
        parts = min(children, max(2, round(size / target)), size // least) if least else children
        if at >= depth - 1 or size <= target or size < 2 * least or parts < 2:
            leaves.append(size)
            return
        for k in range(parts):
            grow(size // parts + (k < size % parts), at + 1)

    if n > 0:
        grow(n, 0)
    s = sorted(leaves)
    return {"per_depth": per_depth, "min": s[0] if s else 0, "median": float(np.median(s)) if s else 0.0, "max": s[-1] if s else 0}
