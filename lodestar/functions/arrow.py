"""Arrow batches as numpy matrices and back: the kernels' side of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def matrix(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """A list column whose lists have one length, as rows of a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype).reshape(len(column), -1)


def rows_of(m: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    n, d = m.shape
    return pa.ListArray.from_arrays(np.arange(0, n * d + 1, max(d, 1), dtype=np.int32)[: n + 1], pa.array(m.ravel()))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], ddl: str) -> DataFrame:
    """fn turns every batch into columns; they come out as the DDL says."""
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got = fn(batch)
                columns = [got[f.name] if isinstance(got[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(got[f.name]) for f in arrow]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def half_away(x: np.ndarray) -> np.ndarray:
    """Rounds halves away from zero, as SQL does."""
    return np.sign(x) * np.floor(np.abs(x) + 0.5)
