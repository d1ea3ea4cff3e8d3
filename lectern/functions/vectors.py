"""Vector functions over arrays, in double precision, and kernels over whole Arrow batches of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, within [0, 2]; 1 if either vector is zero."""
    size = norm(a) * norm(b)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))
    return F.when(size == 0, F.lit(1.0)).otherwise(1.0 - cosine)


def similarity(distance: Column) -> Column:
    return 1 - distance


def matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(float64[rows, width], which rows are vectors of that width without nulls); other rows are zero."""
    n = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    good = n == width
    flat = vectors.filter(pa.array(good)).flatten()
    inner = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    out = np.zeros((len(n), width))
    out[good] = inner
    good &= np.isfinite(out).all(axis=1)
    out[~good] = 0
    return out, good


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def distances(vectors: pa.Array, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cosine distances [rows, queries], good rows) by one matrix product; 1 where a vector is zero."""
    m, good = matrix(vectors, queries.shape[1])
    return 1.0 - np.clip(unit(m) @ unit(queries).T, -1.0, 1.0), good
