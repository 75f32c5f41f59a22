"""Hard-negative mining: rows of other labels whose inner product with an anchor lies in a window below that of a positive.

All rows go into R-trees packed by sort-tile-recursive: Spark deals them to ranges of (label, widest coordinate), and each task packs its sorted
rows into trees of bounded size. Anchors are sent to all trees in blocks of bounded size; first their positives are searched, then the
windows that follow from the positives' scores. Each task returns no more than the first few rows of each anchor or window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm.rtree import Rows, Tree, in_windows, nearest, str_order
from tonearm.llm.vectors import fixed_point, matrix, whole
from tonearm.llm.worker import tidy
from tonearm.storage import drop_at_exit, fresh_path, materialize

#: Rows of one tree, and of one task's share of the table.
TREE_ROWS, TASK_ROWS = 1 << 12, 1 << 16
#: Bytes of anchors, as doubles, that go to all tasks at a time.
BLOCK_BYTES = 8 << 20
_TREE = "rows int, kind string, ids binary, none binary, place binary, label binary, x binary"


def _spread(rows: DataFrame) -> tuple[int, list[int], int]:
    """(dimensions, these by falling variance, the largest absolute entry) of the column x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            x = matrix(batch.column(0), int(sizes.max(initial=0)))
            # The absolute value of the least long has no long of its own; one less serves, as entries are cut to far smaller ones.
            most = np.abs(np.maximum(x, -(1 << 63) + 1)).max(axis=0, initial=0)
            f = x.astype(float)
            yield pa.record_batch([pa.array(np.arange(x.shape[1], dtype=np.int32)), pa.array(f.sum(axis=0)), pa.array((f * f).sum(axis=0)), pa.array(most)], names=["d", "s", "ss", "most"])

    n = rows.count()
    found = rows.select("x").mapInArrow(tidy(run), "d int, s double, ss double, most long").groupBy("d").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.max("most").alias("most")).collect()
    wide = sorted(found, key=lambda r: (-(r.ss / n - (r.s / n) ** 2), r.d))
    return len(found), [r.d for r in wide], max((r.most for r in found), default=0)


def packed(rows: DataFrame, dims: int, axes: list[int], limit: int, tree_rows: int = TREE_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per tree over all of ``rows`` (id, label, place, x)."""
    spark, n = rows.sparkSession, rows.count()
    parts = max(1, -(-n // task_rows), min(2 * spark.sparkContext.defaultParallelism, -(-n // tree_rows)))

    def pack(ids: np.ndarray, none: np.ndarray, place: np.ndarray, label: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        order = str_order(x, label, axes)
        x = x[order]
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= x.min(initial=0) and x.max(initial=0) <= np.iinfo(t).max)
        cells = [len(x), np.dtype(kind).name, ids[order].tobytes(), none[order].tobytes(), place[order].tobytes(), label[order].tobytes(), x.astype(kind).tobytes()]
        return pa.record_batch([pa.array([c], t) for c, t in zip(cells, (pa.int32(), pa.string(), *[pa.binary()] * 5))], names=["rows", "kind", "ids", "none", "place", "label", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, tree_rows):
                part = batch.slice(at, tree_rows)
                ids = part.column(0)
                held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column(2).to_numpy(), part.column(1).to_numpy(), np.clip(matrix(part.column(3), dims), -limit, limit)))
                size += part.num_rows
                if size >= tree_rows:
                    columns = [np.concatenate(c) for c in zip(*held)]
                    yield pack(*[c[:tree_rows] for c in columns])
                    held, size = [tuple(c[tree_rows:] for c in columns)], size - tree_rows
        if size:
            yield pack(*[np.concatenate(c) for c in zip(*held)])

    # Very many rows may be equal: the hash of their place spreads them over ranges.
    order = [F.col("label"), F.get("x", F.lit(axes[0])) if axes else F.lit(0), F.xxhash64("place")]
    return rows.select("id", "label", "place", "x").repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(tidy(run), _TREE)


def _tree(batch: pa.RecordBatch, k: int, dims: int, number: type) -> tuple[Tree, Rows]:
    cell = lambda name, t: np.frombuffer(batch.column(name)[k].as_buffer(), t)
    x = cell("x", np.dtype(batch.column("kind")[k].as_py())).reshape(batch.column("rows")[k].as_py(), dims)
    return Tree(x.astype(number), cell("label", np.int64)), Rows(cell("ids", np.int64), cell("none", bool), cell("place", np.int64))


def _firsts(found: DataFrame, of: list[str], most: int) -> DataFrame:
    """The ``most`` first rows of each group, ranked from 1; Spark cuts each task's rows to as many before the shuffle."""
    first = W.partitionBy(*of).orderBy(F.desc("score"), "none", "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block_bytes: int = BLOCK_BYTES, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Rows ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Scores are integer inner products of fixed-point vectors. Anchors are the rows whose id is divisible by ``every``; their positives the first ``positives`` other rows of
    the same label by falling score, then by id; for each positive the first ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``, ranked from 1. The result is exact: every row is searched, and no row that could
    count is pruned. Rows with a null label, or a null vector or one with a null or non-finite component, take no part. Rows with a null id do, but are no anchors and
    sort behind all ids; repeated rows are rows of their own. Of vectors of different lengths the shorter ones count as filled up with zeros; entries so large that
    a score would not fit a long (beyond sqrt(2^63 / dims)) count as that limit. Labels that are no integers are known by 64-bit hashes. Anchors without
    positives or negatives have no rows; an empty table gives none; other columns are not read. ``block_bytes`` bounds the anchors in a task at
    a time, ``tree_rows`` the rows of a tree; neither changes the result.
    """
    spark = vectors.sparkSession
    integral = lambda c: dict(vectors.dtypes)[c] in ("bigint", "int", "smallint", "tinyint")
    if not integral(id_col):
        raise TypeError(f"{id_col} must be of an integer type")
    label: Column = F.col(label_col).cast("long") if integral(label_col) else F.xxhash64(label_col)
    taken = vectors.where(F.col(label_col).isNotNull() & whole(F.col(vector_col)))
    rows = materialize(taken.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.monotonically_increasing_id().alias("place"), fixed_point(F.col(vector_col)).alias("x")), "negatives-rows")
    kind = T.StructType([T.StructField("anchor_id", vectors.schema[id_col].dataType), T.StructField("positive_id", vectors.schema[id_col].dataType), T.StructField("rank", T.IntegerType()), T.StructField("negative_id", vectors.schema[id_col].dataType), T.StructField("positive_score", T.LongType()), T.StructField("negative_score", T.LongType())])
    anchors = rows.where(F.col("id") % every == 0)
    count = anchors.count()
    if not count:
        return spark.createDataFrame([], kind)
    dims, axes, most = _spread(rows)
    limit = int(((1 << 63) - 1) // max(dims, 1)) ** 0.5
    limit = min(most, int(limit))
    # Doubles add up exactly below 2^53, and their products are the fastest.
    number = np.float64 if dims * limit * limit < 1 << 53 else np.int64
    trees = materialize(packed(rows, dims, axes, limit, tree_rows), "negatives-trees")
    blocks = -(-count * max(dims, 1) * 8 // block_bytes)
    place = fresh_path(spark, "negatives-anchors")
    drop_at_exit(spark, place)
    anchors.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int")).repartition("block").write.partitionBy("block").parquet(place)
    out = fresh_path(spark, "negatives-found")
    drop_at_exit(spark, out)
    for block in range(blocks):
        # A block of anchors of bounded size comes to the driver and goes to all tasks.
        got = spark.read.schema("id long, label long, place long, x array<long>, block int").parquet(place).where(F.col("block") == block).select("id", "label", "place", "x").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        x = np.clip(matrix(got.column("x").chunk(0), dims), -limit, limit).astype(number)
        asked = (x, got.column("label").to_numpy(), got.column("place").to_numpy(), got.column("id").to_numpy())
        near = _positives(trees, asked, dims, number, positives)
        found = _negatives(trees, asked, near, dims, number, negatives, low, high)
        found.write.parquet(f"{out}/block-{block}")
    plain = spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(f"{out}/block-*")
    return plain.select(*[F.col(f.name).cast(f.dataType) for f in kind.fields])


def _positives(trees: DataFrame, asked: tuple, dims: int, number: type, most: int) -> list[list[tuple[int, int | None]]]:
    """(score, id) of the positives of each anchor, in order."""
    sent = trees.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, label, place, _ = sent.value
        held: list[list] = [[] for _ in q]
        for batch in batches:
            for k in range(batch.num_rows):
                nearest(*_tree(batch, k, dims, number), q, label, place, held, most)
        flat = [(k, -s, n, i) for k, own in enumerate(held) for s, n, i in own]
        if flat:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*flat), (pa.int32(), pa.int64(), pa.bool_(), pa.int64()))], names=["q", "score", "none", "id"])

    firsts = _firsts(trees.mapInArrow(tidy(run), "q int, score long, none boolean, id long"), ["q"], most)
    near: list[list] = [[] for _ in asked[1]]
    for r in sorted(firsts.collect(), key=lambda r: (r.q, r.rank)):
        near[r.q].append((r.score, None if r.none else r.id))
    sent.unpersist()
    return near


def _negatives(trees: DataFrame, asked: tuple, near: list, dims: int, number: type, most: int, low: int, high: int) -> DataFrame:
    """The ranked rows of each anchor and positive."""
    # Whole-number ends of low * p <= 100 * s <= high * p; positives whose window is empty ask for nothing.
    own = [[(p, -(-low * p[0] // 100), high * p[0] // 100) for p in group] for group in near]
    own = [[(k, p, lo, hi) for k, (p, lo, hi) in enumerate(group) if lo <= hi] for group in own]
    sent = trees.sparkSession.sparkContext.broadcast((*asked, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, label, _, ids, own = sent.value
        windows = [[(lo, hi) for _, _, lo, hi in group] for group in own]
        held: list[list[list]] = [[[] for _ in group] for group in own]
        for batch in batches:
            for k in range(batch.num_rows):
                in_windows(*_tree(batch, k, dims, number), q, label, windows, held, most)
        flat = [(k, w, int(ids[k]), p[1], p[0], -s, n, i) for k, group in enumerate(own) for (w, p, _, _), h in zip(group, held[k]) for s, n, i in h]
        if flat:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*flat), kinds)], names=["q", "w", "anchor_id", "positive_id", "positive_score", "score", "none", "id"])

    found = trees.mapInArrow(tidy(run), "q int, w int, anchor_id long, positive_id long, positive_score long, score long, none boolean, id long")
    first = _firsts(found, ["q", "w"], most)
    return first.select("anchor_id", "positive_id", "rank", F.when(~F.col("none"), F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
