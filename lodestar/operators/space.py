"""Vectors made ready: unusable rows left out, the mean, int8 codes of the raw and of the centred unit vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.arrow import half_away, map_batches, matrix, rows_of

FLOOR = 1e-9


def usable(df: DataFrame, column: str = "embedding", size: int | None = None) -> DataFrame:
    """Rows whose vector is there, has the wanted length (that of some row by default) and only finite components."""
    if size is None:
        some = df.where(F.col(column).isNotNull()).select(F.size(column).alias("d")).first()
        size = some.d if some else 0
    finite = F.forall(column, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return df.where(F.col(column).isNotNull() & (F.size(column) == size) & finite)


@dataclass(frozen=True)
class Space:
    """n: rows. mean: of each component. top: the largest absolute component."""

    n: int
    mean: np.ndarray
    top: float

    def quantise(self, x: np.ndarray) -> np.ndarray:
        """One global scale: the largest component becomes 127."""
        return np.clip(half_away(x * 127 / (self.top or 1.0)), -127, 127).astype(np.int8)

    def unit(self, x: np.ndarray) -> np.ndarray:
        """Centred, of length one; the length is at least a floor, so that the mean itself becomes zero."""
        c = x - self.mean
        return c / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), FLOOR)

    def normalise(self, x: np.ndarray) -> np.ndarray:
        return np.clip(half_away(127 * self.unit(x)), -127, 127).astype(np.int8)


def fit_space(rows: DataFrame, column: str = "x") -> Space:
    """One pass: every partition sends one row of sums, added up by component."""

    def sums(batches):
        n, total, top = 0, None, 0.0
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch.column(0))
                n, total, top = n + len(m), m.sum(0) + (0 if total is None else total), max(top, float(np.abs(m).max(initial=0)))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"n": [n], "total": [total.tolist()], "top": [top]}, schema=pa.schema([("n", pa.int64()), ("total", pa.list_(pa.float64())), ("top", pa.float64())]))

    parts = rows.select(column).mapInArrow(sums, "n long, total array<double>, top double")
    got = parts.select("n", "top", F.posexplode("total").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.max("top").alias("top")).orderBy("i").collect()
    if not got:
        return Space(0, np.zeros(0), 0.0)
    return Space(got[0].n, np.array([r.v for r in got]) / got[0].n, max(r.top for r in got))


def coded(rows: DataFrame, space: Space, keep: str = "vec_id", ddl: str = "vec_id long") -> DataFrame:
    """keep, x, q (int8 of the raw vector), nx (int8 of the centred unit vector)."""

    def run(batch):
        x = matrix(batch.column("x"))
        return {keep: batch.column(keep), "x": batch.column("x"), "q": rows_of(space.quantise(x)), "nx": rows_of(space.normalise(x))}

    return map_batches(rows.select(keep, "x"), run, f"{ddl}, x array<float>, q array<tinyint>, nx array<tinyint>")
