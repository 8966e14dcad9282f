"""Routers: which cells a vector belongs to and which cells a query looks at.

Cells are bounded in number by a parameter, so their centroids are sent to the executors with the kernels; rows are scored
against them in matrix products. Routing is in the space of centred unit int8 vectors under L2, whatever the metric of the
search. Scores are whole numbers where they can be; ties go to the lower cell.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.arrow import half_away, map_batches, matrix

#: The most cells whose centroids are sent with a kernel.
MOST_CELLS = 1 << 20


@dataclass(frozen=True)
class Cells:
    """Centroids of each level, coarsest first; parent[l][i] is the cell of level l - 1 above cell i of level l."""

    levels: list[np.ndarray]
    parents: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        if sum(map(len, self.levels)) > MOST_CELLS:
            raise ValueError(f"more than {MOST_CELLS} cells")

    @property
    def finest(self) -> np.ndarray:
        return self.levels[-1]


def pivots(rows: DataFrame, n: int, column: str = "nx") -> np.ndarray:
    """The vectors of n rows, those whose ids have the least md5: a bounded sample, the same at every run."""
    got = rows.select("vec_id", column, F.md5(F.col("vec_id").cast("string").cast("binary")).alias("h")).orderBy("h", "vec_id").limit(n).collect()
    return np.array([r[column] for r in got], np.float64)


def under_nearest(coarse: np.ndarray, fine: np.ndarray) -> Cells:
    """Two levels: every fine cell under its nearest coarse cell."""
    return Cells([coarse, fine], [np.empty(0, int), np.argmin(l2(fine, coarse), 1)])


def l2(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids by norms and one product."""
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)


def first_k(scores: np.ndarray, k: int) -> np.ndarray:
    return np.argsort(scores, axis=1, kind="stable")[:, :k]


def _chosen(rows: DataFrame, column: str, keep: str, choose, extra: str = "") -> DataFrame:
    """(keep, rank, cell, score, ..): choose gives, for a matrix, a list of columns (n by k; cells below 0 are absent)."""

    def run(batch):
        got = choose(matrix(batch.column(column)))
        cell = got["cell"]
        here = cell >= 0
        rank = np.cumsum(here, 1)
        ids = np.repeat(np.asarray(batch.column(keep)), here.sum(1))
        return {keep: ids, "rank": rank[here]} | {name: v[here] for name, v in got.items()}

    return map_batches(rows.select(keep, column), run, f"{keep} long, rank int, cell int, score double{extra}")


def flat(rows: DataFrame, cells: Cells, k: int, keep: str = "vec_id", column: str = "nx", gamma: float = 1.0) -> DataFrame:
    """The k nearest cells. gamma != 1 adds (gamma - 1) * |c|^2, rounded, to a cell's score; for searching only."""
    c = cells.finest
    bias = half_away((gamma - 1) * (c * c).sum(1))

    def choose(x):
        s = l2(x, c) + bias
        best = first_k(s, k)
        return {"cell": best, "score": np.take_along_axis(s, best, 1)}

    return _chosen(rows, column, keep, choose)


def spilled(rows: DataFrame, cells: Cells, k: int, rule: str = "soar", weight: float = 1.0, keep: str = "vec_id", column: str = "nx") -> DataFrame:
    """The nearest cell, then k - 1 others of least loss.

    soar: distance plus weight times the squared share of the residual along the first one. rair: distance minus weight
    times the inner product of the first residual and the centroid.
    """
    c = cells.finest

    def choose(x):
        s = l2(x, c)
        first = s.argmin(1)
        r = x - c[first]
        if rule == "soar":
            r = r / np.maximum(np.sqrt((r * r).sum(1, keepdims=True)), 1e-9)
            loss = s + weight * ((x * r).sum(1, keepdims=True) - r @ c.T) ** 2
        elif rule == "rair":
            loss = s - weight * (r @ c.T)
        else:
            raise ValueError(f"rule must be 'soar' or 'rair', not {rule!r}")
        loss = np.round(loss, 6)
        loss[np.arange(len(x)), first] = -np.inf
        best = first_k(loss, k)
        return {"cell": best, "score": np.take_along_axis(s, best, 1)}

    return _chosen(rows, column, keep, choose)


def product(rows: DataFrame, c0: np.ndarray, c1: np.ndarray, k: int, keep: str = "vec_id", column: str = "nx") -> DataFrame:
    """Cells (i, j) of two codebooks, numbered i * |c1| + j, of least |c0_i + c1_j|^2 - 2 x (c0_i + c1_j)."""
    cross = 2 * c0 @ c1.T + (c0 * c0).sum(1)[:, None] + (c1 * c1).sum(1)[None, :]

    def choose(x):
        s = (cross[None] - 2 * (x @ c0.T)[:, :, None] - 2 * (x @ c1.T)[:, None, :]).reshape(len(x), -1)
        best = first_k(s, k)
        return {"cell": best, "score": np.take_along_axis(s, best, 1)}

    return _chosen(rows, column, keep, choose)


def product_assigned(rows: DataFrame, c0: np.ndarray, c1: np.ndarray, k: int, keep: str = "vec_id", column: str = "nx") -> DataFrame:
    """The k best cells of the first codebook, each with its best cell of the second."""
    cross = 2 * c0 @ c1.T + (c1 * c1).sum(1)[None, :]

    def choose(x):
        s0 = (c0 * c0).sum(1)[None] - 2 * x @ c0.T
        i = first_k(s0, k)
        s1 = cross[i] - 2 * (x @ c1.T)[:, None, :]
        j = s1.argmin(2)
        return {"cell": i * len(c1) + j, "score": np.take_along_axis(s0, i, 1) + s1.min(2)}

    return _chosen(rows, column, keep, choose)


def descended(rows: DataFrame, cells: Cells, beams: list[int], k: int, keep: str = "vec_id", column: str = "nx", gamma: float = 1.0) -> DataFrame:
    """Beam descent: the best cells of a level open their children; of the finest level k are kept."""
    bias = half_away((gamma - 1) * (cells.finest**2).sum(1))

    def choose(x):
        allowed = np.ones((len(x), len(cells.levels[0])), bool)
        for level, c in enumerate(cells.levels):
            last = level == len(cells.levels) - 1
            if level:
                allowed = kept[:, cells.parents[level]]
            s = np.where(allowed, l2(x, c) + (bias if last else 0), np.inf)
            best = first_k(s, k if last else beams[level])
            kept = np.zeros(s.shape, bool)
            np.put_along_axis(kept, best, True, 1)
            kept &= allowed
        score = np.take_along_axis(s, best, 1)
        return {"cell": np.where(np.isfinite(score), best, -1), "score": np.where(np.isfinite(score), score, 0)}

    return _chosen(rows, column, keep, choose)


def margin(ranked: DataFrame, p: int, by: str = "qid") -> DataFrame:
    """(by, margin): the gap between the scores of rank p and p + 1."""
    ends = ranked.where(F.col("rank").isin(p, p + 1)).groupBy(by)
    return ends.agg((F.max(F.when(F.col("rank") == p + 1, F.col("score"))) - F.max(F.when(F.col("rank") == p, F.col("score")))).alias("margin"))


def features(routed: DataFrame, rows: DataFrame, cells: Cells, occupancy: DataFrame, by: str = "qid", column: str = "nx") -> DataFrame:
    """(by, rank, cell, parent, fine_score, parent_score, fine_norm, parent_norm, occupancy) of every routed cell of a two-level tree."""
    fine, coarse, parent = cells.levels[1], cells.levels[0], cells.parents[1]

    def run(batch):
        x, cell = matrix(batch.column(column)), np.asarray(batch.column("cell"))
        up = parent[cell]
        return {by: batch.column(by), "rank": batch.column("rank"), "cell": cell, "parent": up, "fine_score": ((x - fine[cell]) ** 2).sum(1), "parent_score": ((x - coarse[up]) ** 2).sum(1), "fine_norm": (fine[cell] ** 2).sum(1), "parent_norm": (coarse[up] ** 2).sum(1)}

    both = routed.select(by, "rank", "cell").join(rows.select(by, column), by)
    got = map_batches(both, run, f"{by} long, rank int, cell int, parent int, fine_score double, parent_score double, fine_norm double, parent_norm double")
    return got.join(occupancy.select("cell", "occupancy"), "cell", "left").withColumn("occupancy", F.coalesce("occupancy", F.lit(0).cast("long")))
