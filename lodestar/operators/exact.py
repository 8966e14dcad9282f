"""Exact nearest neighbours in blocks, top-k and the scoring of given pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.arrow import map_batches, matrix

QUERY_BLOCK, ROW_BLOCK = 1024, 8192


def top_k(scored: DataFrame, k: int, by: str = "qid", order: str = "score", tie: str = "vec_id") -> DataFrame:
    """The k smallest scores of each query, ranked from 1; equal scores go by id.

    The filter on row_number lets Spark cut each partition to k rows before the shuffle.
    """
    w = Window.partitionBy(by).orderBy(F.col(order).asc_nulls_last(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All scores of the rows of a against those of b, smaller is better: squared L2 or minus the inner product."""
    if metric == "ip":
        return -(a @ b.T)
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def _packed(df: DataFrame, id_col: str, column: str, size: int, names: tuple[str, str]) -> DataFrame:
    """Blocks of at most `size` rows, each one row of ids and one flat array."""
    schema = pa.schema([(names[0], pa.list_(pa.int64())), (names[1], pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                yield pa.RecordBatch.from_pydict({names[0]: [part.column(0).to_pylist()], names[1]: [matrix(part.column(1)).ravel()]}, schema=schema)

    return df.select(F.col(id_col).cast("long"), column).mapInArrow(run, f"{names[0]} array<long>, {names[1]} array<double>")


def exact_knn(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "ip", column: str = "x", own: bool = False) -> DataFrame:
    """(qid, rank, vec_id, score): every query (qid, and the vector under `column`) against every row but its own.

    Blocks of queries meet blocks of rows; each pair of blocks is one matrix product that gives k rows for each query,
    and these are ranked once more. The query set may grow: no side is broadcast or gathered.
    """
    if metric not in ("ip", "l2"):
        raise ValueError(f"metric must be 'ip' or 'l2', not {metric!r}")
    blocks = _packed(rows, "vec_id", column, ROW_BLOCK, ("ids", "m"))
    asked = _packed(queries, "qid", column, QUERY_BLOCK, ("qids", "qm"))

    def run(batch):
        out: dict[str, list] = {"qid": [], "vec_id": [], "score": []}
        for ids, m, qids, qm in zip(*(batch.column(c) for c in ("ids", "m", "qids", "qm")), strict=True):
            ids, qids = np.array(ids.as_py()), np.array(qids.as_py())
            s = distances(qm.values.to_numpy().reshape(len(qids), -1), m.values.to_numpy().reshape(len(ids), -1), metric)
            if not own:
                s[qids[:, None] == ids[None, :]] = np.inf
            order = np.lexsort((np.broadcast_to(ids, s.shape), s), axis=1)[:, :k]
            best = np.take_along_axis(s, order, 1)
            here = np.isfinite(best)
            out["qid"].append(np.repeat(qids, here.sum(1)))
            out["vec_id"].append(ids[order][here])
            out["score"].append(best[here])
        return {c: np.concatenate(v) for c, v in out.items()}

    pairs = blocks.join(asked.hint("shuffle_replicate_nl"))
    return top_k(map_batches(pairs, run, "qid long, vec_id long, score double"), k).select("qid", "rank", "vec_id", "score")


def score_pairs(pairs: DataFrame, a: str, b: str, metric: str, kind: str = "double") -> DataFrame:
    """Adds the score of the two vectors of each row and drops them; int8 vectors give whole numbers."""
    keep = [c for c in pairs.columns if c not in (a, b)]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if f.name in keep)

    def run(batch):
        x, y = matrix(batch.column(a)), matrix(batch.column(b))
        s = -(x * y).sum(1) if metric == "ip" else ((x - y) ** 2).sum(1)
        return {c: batch.column(c) for c in keep} | {"score": s}

    return map_batches(pairs, run, f"{ddl}, score {kind}")
