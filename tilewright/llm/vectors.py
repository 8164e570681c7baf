"""Vectors on an integer grid: floor(1024 * c) of each component, exact whatever its size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024
#: Integers below this in absolute value keep their squared distances over parts of up to 2^12 components inside 64 bits.
NARROW = 1 << 24
LIMB = 40


def whole(column: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return column.isNotNull() & F.coalesce(finite, F.lit(False))


def common_length(df: DataFrame, column: str) -> int:
    """The length that most vectors have, the least of several; 0 for an empty table. One row comes to the driver."""
    top = df.groupBy(F.size(F.col(f"`{column}`")).alias("d")).count().orderBy(F.desc("count"), "d").head(1)
    return int(top[0]["d"]) if top else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a list column, a row each, as float64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def _grid_number(c: float) -> int:
    return int(c) * SCALE if abs(c) >= 2.0**53 else math.floor(c * SCALE)


def on_grid(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * c): int64 where all are narrow, else Python's integers."""
    if not vectors.size or np.abs(vectors).max() * SCALE < NARROW - 1:
        return np.floor(vectors * SCALE).astype(np.int64)
    return np.array([_grid_number(c) for c in vectors.ravel().tolist()], object).reshape(vectors.shape)


def limbs(values: np.ndarray) -> list[np.ndarray]:
    """int64 arrays whose sum, each shifted by 40 bits more than the one before, is ``values``; the last one carries the sign.

    Sums of limbs over up to 2^23 tasks stay inside 64 bits.
    """
    out, rest = [], values
    while True:
        if not rest.size or (rest.max() < 1 << LIMB and rest.min() >= -(1 << LIMB)):
            return [*out, rest.astype(np.int64)]
        out.append((rest & ((1 << LIMB) - 1)).astype(np.int64))
        rest = rest >> LIMB


def from_limbs(parts: dict[int, int]) -> int:
    return sum(int(value) << (LIMB * k) for k, value in parts.items())
