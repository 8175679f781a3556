"""Integer vectors from arrays of floating numbers, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components beyond this have squared distances that a long can't hold; meeting one is an error, not a wrong number.
LARGEST = 1 << 27


def whole(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers; never null."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def integers(vector: Column, scale: int = 64, shift: int = 0) -> Column:
    """floor(scale * x) + shift of each entry x, taken as a double.  Entries beyond ``LARGEST`` raise an error."""
    scaled = lambda x: x.cast("double") * F.lit(float(scale))
    far = F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("long")
    return F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < F.lit(float(LARGEST)), F.floor(scaled(x)) + F.lit(shift)).otherwise(far))


def matrix(column: pa.ListArray, size: int) -> np.ndarray:
    """The rows of an Arrow list column without nulls, each of ``size`` entries, as an int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), size)
