"""Trees of playlists at any size: mergeable cluster features, Ward over them, rows to the nearest.

A cluster feature stands for some rows by their number, mean, sum of squared distances from it and smallest id. Each task folds its rows into at most
``max_leaves`` features of each open cluster; features merge in rounds of groups of bounded size; Ward splits what is left. A cluster of at most
``max_leaves`` rows keeps a feature for every row, so its split is that of its rows themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.operators.cluster import best_split, cut, kmeans_labels, ward_merges

MAX_LEAVES = 1024
#: Parts whose features one task merges in a round.
FAN = 16
FEATURE = "path string, part long, n double, centre array<double>, sse double, first long"


class Features(NamedTuple):
    n: np.ndarray
    centre: np.ndarray
    sse: np.ndarray
    first: np.ndarray


def of_rows(m: np.ndarray, ids: np.ndarray) -> Features:
    return Features(np.ones(len(m)), m, np.zeros(len(m)), ids)


def joined(a: Features | None, b: Features) -> Features:
    return b if a is None else Features(*(np.concatenate(x) for x in zip(a, b)))


def folded(f: Features, labels: np.ndarray, k: int) -> Features:
    """One feature for each of ``k`` labels; numbers, means and sums of squares are those of the rows behind them."""
    n = np.bincount(labels, f.n, k)
    centre = np.zeros((k, f.centre.shape[1]))
    np.add.at(centre, labels, f.centre * f.n[:, None])
    centre /= n[:, None]
    sse = np.bincount(labels, f.sse + f.n * ((f.centre - centre[labels]) ** 2).sum(1), k)
    first = np.full(k, np.iinfo(np.int64).max)
    np.minimum.at(first, labels, f.first)
    return Features(n, centre, sse, first)


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T, 0)


class Summary:
    """At most twice ``limit`` features while rows come, ``limit`` in the end.

    Over one and a half times the limit, Ward merges features until ``limit`` are left; the height of its last merge is what a row may cost
    from then on to go into its nearest feature at once. Below the limit nothing is ever merged.
    """

    def __init__(self, limit: int):
        self.limit, self.held, self.height = limit, None, None

    def _condense(self) -> None:
        merges = ward_merges(self.held.centre, self.held.n)
        self.height = max(self.height or 0.0, merges[len(merges) - self.limit][0])
        self.held = folded(self.held, cut(merges, self.limit), self.limit)

    def add(self, f: Features) -> None:
        step = max(1, self.limit // 2)
        for at in range(0, len(f.n), step):
            part = Features(*(x[at : at + step] for x in f))
            if self.height is not None:
                d = squares(part.centre, self.held.centre)
                near = d.argmin(1)
                taken = d[np.arange(len(near)), near] * 2 * part.n * self.held.n[near] / (part.n + self.held.n[near]) <= self.height
                labels = np.concatenate([np.arange(len(self.held.n)), near[taken]])
                self.held = folded(joined(self.held, Features(*(x[taken] for x in part))), labels, len(self.held.n))
                part = Features(*(x[~taken] for x in part))
            self.held = joined(self.held, part)
            if len(self.held.n) > 1.5 * self.limit:
                self._condense()

    def done(self) -> Features:
        if len(self.held.n) > self.limit:
            self._condense()
        order = np.argsort(self.held.first, kind="stable")
        return Features(*(x[order] for x in self.held))


def _frame(path: str, part: int, f: Features) -> pd.DataFrame:
    return pd.DataFrame({"path": path, "part": part, "n": f.n, "centre": list(f.centre), "sse": f.sse, "first": f.first})


def _features(pdf: pd.DataFrame) -> Features:
    return Features(pdf["n"].to_numpy(float), np.stack(pdf["centre"].to_numpy()), pdf["sse"].to_numpy(float), pdf["first"].to_numpy(np.int64))


def cluster_features(rows: DataFrame, parts: int, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """(path, part, n, centre, sse, first): at most ``max_leaves`` features for each ``path`` of (id, vector, path), whose rows lie in ``parts`` partitions.

    A task holds its paths' features and one Arrow batch; a merge holds ``FAN`` times ``max_leaves`` features. So memory depends on the number of paths in
    a partition and not on rows; callers keep paths few (a tree's open clusters).
    """

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held: dict[str, Summary] = {}
        for pdf in batches:
            for path, own in pdf.groupby("path", sort=False):
                held.setdefault(path, Summary(max_leaves)).add(of_rows(np.stack(own["vector"].to_numpy()).astype(float), own["id"].to_numpy(np.int64)))
        for path, summary in held.items():
            yield _frame(path, TaskContext.get().partitionId(), summary.done())

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = Summary(max_leaves)
        for _, own in pdf.groupby("part"):
            out.add(_features(own.sort_values("first")))
        return _frame(key[0], key[1], out.done())

    found = rows.select("id", "vector", "path").mapInPandas(gather, FEATURE)
    # Few bytes, much work: adaptive execution would merge the paths into one task.
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        parts = -(-parts // FAN)
        found = found.withColumn("into", F.floor(F.col("part") / FAN)).repartition(spread, "path", "into").groupBy("path", "into").applyInPandas(merge, FEATURE)
    return found


def playlist_tree(rows: DataFrame, target: int = 24, least: int = 8, most_children: int = 4, max_depth: int = 3, seed: int = 7, method: str = "ward", max_leaves: int = MAX_LEAVES) -> DataFrame:
    """(id, path, depth): the leaf of each row of (id, vector); ``path`` names the branch at each level.

    A cluster over ``target`` and at least twice ``least`` is split while the tree is shallower than ``max_depth``: by Ward's best split, or by
    k-means, over its cluster features. Each row then goes to the child of its nearest feature. Clusters of at most ``max_leaves`` rows are so split as by
    their rows, but that equal rows stay together; of larger ones a child may get some rows more or fewer than its features counted, and so fall below ``least`` where it was near it.

    Rows are spread by id and sorted once, so the tree depends on ``spark.sql.shuffle.partitions`` and not on files. Every level is checkpointed. What
    goes to the driver and back to the tasks are the features of open clusters: most_children ** (depth - 1) times ``max_leaves`` vectors at most.
    Vectors have one length and no nulls; an empty table gives an empty tree.
    """
    from tonearm.storage import shared_dir

    spark = rows.sparkSession
    shared_dir(spark)
    schema = "id long, vector array<double>, path string, depth int, open boolean"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = rows.select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"), F.lit("root").alias("path"), F.lit(0).alias("depth"), F.lit(True).alias("open"))
    level = level.repartition(parts, "id").sortWithinPartitions("id").checkpoint()

    def decide(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f = _features(pdf.sort_values("first"))
        n, labels = int(f.n.sum()), None
        if n > target and n >= 2 * least:
            if method == "ward":
                labels = best_split(f.centre, target, least, most_children, f.n, f.sse / f.n)
            else:
                k = max(2, min(most_children, round(n / target), n // least))
                labels = kmeans_labels(f.centre, k, seed, weights=f.n)
        if labels is None:
            return pd.DataFrame(columns=["path", "centre", "label"], dtype=object)
        return pd.DataFrame({"path": key[0], "centre": list(f.centre), "label": labels})

    for _ in range(max_depth - 1):
        found = cluster_features(level.where("open"), parts, max_leaves).repartition(parts, "path").groupBy("path").applyInPandas(decide, "path string, centre array<double>, label int").toPandas()
        if found.empty:
            break
        splits = {path: (np.stack(own["centre"].to_numpy()), own["label"].to_numpy()) for path, own in found.groupby("path")}

        def assign(batches: Iterator[pd.DataFrame], splits: dict = splits) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for path, own in pdf.groupby("path", sort=False):
                    if path not in splits:
                        out.append(own.assign(open=False))
                        continue
                    centres, labels = splits[path]
                    m = np.stack(own["vector"].to_numpy()).astype(float)
                    near = np.concatenate([squares(m[at : at + 1024], centres).argmin(1) for at in range(0, len(m), 1024)])
                    out.append(own.assign(path=[f"{path}-{x + 1}" for x in labels[near]], depth=own["depth"] + 1))
                if out:
                    yield pd.concat(out, ignore_index=True)

        level = level.mapInPandas(assign, schema).checkpoint()
    return level.select("id", "path", "depth")
