"""A bounded, deterministic sample of labelled texts, and scoring of all texts; shared by the learned classifiers."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.llm.features import hashed
from tonearm.llm.worker import tidy

#: Texts turned into features at a time.
CHUNK = 256
#: Bytes of text that a sample holds at most; the driver holds their features, of about the same size.
MAX_SAMPLE_BYTES = 128 << 20


def held_out(id_col: str, folds: int) -> Column:
    """True for the fold of ids that no label is learnt from: crc32 of the id as text, modulo ``folds``, is zero. Null ids are false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, folds: int, limit: int, bits: int, with_structure: bool, normal: bool, max_bytes: int = MAX_SAMPLE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features and labels of at most ``limit`` labelled rows outside the held-out fold, the first in an order fixed by the ids, as many as have ``max_bytes`` of text.

    Rows with a null label or id are left out; an id labelled twice counts with its smallest label; of documents that share an id one is taken.
    """
    named = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.min(label).cast("int").alias("__y"))
    picked = named.where(~held_out(id_col, folds)).orderBy(F.xxhash64(id_col), id_col).limit(limit)
    rows = docs.select(id_col, text_col).join(F.broadcast(picked), id_col)
    # Sizes by hash, at most ``limit`` of them, say up to which hash the sample goes.
    sizes = rows.groupBy(F.xxhash64(id_col).alias("h")).agg(F.max(F.octet_length(text_col)).alias("n")).collect()
    last, total = -(1 << 63), 0
    for r in sorted(sizes):
        total += r.n or 0
        if total > max_bytes:
            break
        last = r.h
    rows = rows.where(F.xxhash64(id_col) <= last).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), "__y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                starts, idx, val = hashed(part.column(1).cast(pa.binary()).to_pylist(), bits, with_structure, normal)
                ends = np.append(starts[1:], len(idx))
                yield pa.record_batch([part.column(0), part.column(2), pa.array([idx[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), pa.array([val[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], names=["id", "y", "idx", "val"])

    got = rows.mapInArrow(tidy(run), "id string, y int, idx binary, val binary").toArrow()
    if not got.num_rows:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.float32), np.empty(0, np.int64)
    # One row per id, in an order that does not depend on how the rows arrived; buffers are taken over without a copy per row.
    ids, idx = got.column("id").to_pylist(), got.column("idx")
    keys = sorted(range(got.num_rows), key=lambda i: (ids[i], zlib.crc32(idx[i].as_buffer())))
    first = [i for k, i in enumerate(keys) if not k or ids[i] != ids[keys[k - 1]]]
    got = got.select(["y", "idx", "val"]).take(pa.array(first)).combine_chunks()
    sizes = pc.binary_length(got.column("idx")).to_numpy().astype(np.int64) // 4
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    flat = lambda name, kind: np.concatenate([_values(c, kind) for c in got.column(name).chunks])
    return starts, flat("idx", np.int32), flat("val", np.float32), got.column("y").to_numpy().astype(np.int64)


def _values(cells: pa.Array, kind) -> np.ndarray:
    """The bytes of a binary array, end to end, as numbers."""
    ends = np.frombuffer(cells.buffers()[1], np.int64 if pa.types.is_large_binary(cells.type) else np.int32)[cells.offset : cells.offset + len(cells) + 1]
    return np.frombuffer(cells.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)


def rows_of(starts: np.ndarray, nnz: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry numbers of the rows in ``order``, and where each row starts among them."""
    ends = np.append(starts[1:], nnz)
    sizes = (ends - starts)[order]
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.repeat(starts[order] - begin, sizes) + np.arange(sizes.sum()), begin


def score_all(docs: DataFrame, columns: list[str], text_col: str, model, scores: Callable, names: list[str], bits: int, with_structure: bool, normal: bool) -> DataFrame:
    """``columns`` of every row of ``docs`` with what ``scores(model, starts, idx, val)`` gives, a list of float arrays named ``names``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)], F.col(text_col).alias("text"))
    schema = ", ".join([*[f"k{i} {t}" for i, (_, t) in enumerate(own.dtypes[:-1])], *[f"{n} double" for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                found = scores(held.value, *hashed(part.column(part.num_columns - 1).cast(pa.binary()).to_pylist(), bits, with_structure, normal))
                yield pa.record_batch([*part.columns[:-1], *[pa.array(np.asarray(x, np.float64)) for x in found]], names=[*part.schema.names[:-1], *names])

    out = own.mapInArrow(tidy(run), schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(columns)], *names)
