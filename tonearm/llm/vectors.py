"""Vectors in fixed point, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components are multiplied by this and rounded down.
SCALE = 256
#: The long's limits as doubles; what lies beyond becomes the limit.
_LOW, _HIGH = float(-(1 << 63)), float((1 << 63) - 1024)


def whole(vector: Column) -> Column:
    """True where the vector and all its components are there and finite."""
    infinite = F.lit(float("inf"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == infinite)
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def fixed_point(vector: Column) -> Column:
    """floor(256 c) of each component, taken as double, as longs."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.lit(_LOW), F.least(F.lit(_HIGH), c.cast("double") * SCALE))).cast("long"))


def matrix(cells: pa.Array, dims: int) -> np.ndarray:
    """A list column of longs without nulls as rows of ``dims`` numbers; shorter vectors are filled up with zeros."""
    sizes = np.diff(cells.offsets.to_numpy())
    values = cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(sizes) and (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out
