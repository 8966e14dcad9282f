"""Approximate nearest neighbours by cosine: one hierarchical navigable small-world graph per shard.

Rows go to shards by hash, so no value can fill a shard; each shard keeps one graph whose layers are flat arrays of
neighbours. Points enter in growing batches and queries walk in lock step, so that every step is one array operation for
all of them. Blocks of queries pass by each shard's graph, which is read once for every SLICE blocks, and the shards' results
are merged by rank. Every query is asked of every shard, so the work at a fixed share of queries grows with the square of the rows.

Equal vectors of a shard are one point of the graph and are expanded to their ids at the end, smallest first. Vectors that
are null, zero or hold null or non-finite components take no part, as rows or as queries; rows without an id neither.
Vectors meet only those of their own length. Scores are cosines of the original vectors in double precision; ties go to
the smaller id. Repeated rows are separate candidates; a query's own row is every row of its id. An id with several vectors is one
query: the best rows for any of its vectors. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import stored

SHARD_ROWS, LEAST_SHARDS, BLOCK = 8192, 8, 1024
#: Blocks of queries that one copy of a shard's graph answers; a task's memory is a graph and so many blocks.
SLICE = 64
LINKS, WIDTH, SPREAD = 16, 64, 16


def _distance(points: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """1 - cosine of each query to its row of ids; infinite where the id is -1."""
    d = 1 - np.einsum("qmd,qd->qm", points[ids], q)
    return np.where(ids < 0, np.inf, d)


def walk(points: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for all queries at once: (ids, distances), nearest first, `width` wide."""
    n = len(q)
    ids = np.full((n, width), -1)
    start = start.reshape(n, -1)[:, :width]
    ids[:, : start.shape[1]] = start
    dist = _distance(points, q, ids)
    done = ids < 0
    seen = np.zeros((n, len(points)), bool)
    rows = np.arange(n)
    r, c = np.nonzero(ids >= 0)
    seen[r, ids[r, c]] = True
    active = rows
    while len(active):
        open_ = np.where(done[active], np.inf, dist[active])
        best = open_.argmin(1)
        going = np.isfinite(open_[np.arange(len(active)), best])
        active, best = active[going], best[going]
        if not len(active):
            break
        done[active, best] = True
        near = links[ids[active, best]]
        old = (near < 0) | seen[active[:, None], near]
        near = np.where(old, -1, near)
        r, c = np.nonzero(near >= 0)
        seen[active[r], near[r, c]] = True
        every = np.concatenate([ids[active], near], 1)
        d = np.concatenate([dist[active], _distance(points, q[active], near)], 1)
        flags = np.concatenate([done[active], near < 0], 1)
        order = np.argsort(d, 1, kind="stable")[:, :width]
        ids[active], dist[active], done[active] = (np.take_along_axis(x, order, 1) for x in (every, d, flags))
    return ids, dist


class Graph:
    """layers[0] has every point; layers[l] only those whose level reaches l. Missing neighbours are -1."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        n = len(points)
        random = np.random.default_rng(n)
        level = np.minimum((-np.log(1 - random.random(n)) / np.log(SPREAD)).astype(int), 6)
        self.layers = [np.full((n, LINKS * 2 if k == 0 else LINKS), -1, np.int32) for k in range(level.max() + 1)]
        order = np.argsort(-level, kind="stable")  # high levels first, so that every layer has its entries
        self.entry = int(order[0])
        at = 1
        while at < n:
            batch = order[at : at + max(1, min(at, 512))]
            starts = np.full((len(batch), 1), self.entry)
            for k in range(len(self.layers) - 1, -1, -1):
                member = level[batch] >= k
                ids, dist = walk(points, self.layers[k], points[batch], starts, WIDTH if member.any() else 1)
                own = batch[member]
                if len(own):
                    self._connect(self.layers[k], own, ids[member], dist[member])
                starts = ids[:, :4]
            at += len(batch)

    def _connect(self, links: np.ndarray, own: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        among = 1 - self.points[own] @ self.points[own].T
        np.fill_diagonal(among, np.inf)
        few = min(len(own), WIDTH // 2)
        close = np.argpartition(among, few - 1, 1)[:, :few]
        among = np.take_along_axis(among, close, 1)
        every = np.concatenate([ids, np.where(np.isfinite(among), own[close], -1)], 1)
        links[own] = self._chosen(own, every, np.concatenate([dist, among], 1), links.shape[1])
        src, c = np.nonzero(links[own] >= 0)
        to, back = links[own][src, c], own[src]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        extra = np.full((len(targets), int(count.max(initial=0))), -1)
        place = np.arange(len(to)) - np.repeat(first, count)
        extra[np.repeat(np.arange(len(targets)), count), place] = back
        for a in range(0, len(targets), 512):
            t = targets[a : a + 512]
            all_ids = np.concatenate([links[t], extra[a : a + 512]], 1)
            links[t] = self._chosen(t, all_ids, _distance(self.points, self.points[t], all_ids), links.shape[1])

    def _chosen(self, own: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Nearest first, skipping those nearer to a chosen one than to the point; the skipped fill what stays free."""
        order = np.argsort(dist, 1, kind="stable")[:, : most * 2]
        ids, dist = np.take_along_axis(ids, order, 1).copy(), np.take_along_axis(dist, order, 1)
        same = (ids[:, :, None] == ids[:, None, :]) & (np.arange(ids.shape[1])[:, None] > np.arange(ids.shape[1]))
        ids[same.any(2) | (ids == own[:, None]) | ~np.isfinite(dist)] = -1
        p = self.points[ids]
        between = 1 - np.einsum("nid,njd->nij", p, p)
        picked = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            hidden = (picked[:, :j] & (between[:, j, :j] < dist[:, j, None])).any(1)
            picked[:, j] = (ids[:, j] >= 0) & ~hidden
        order = np.argsort(np.where(ids < 0, 2, np.where(picked, 0, 1)), 1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, order, 1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        starts = np.full((len(q), 1), self.entry)
        for k in range(len(self.layers) - 1, 0, -1):
            starts = walk(self.points, self.layers[k], q, starts, 4)[0]
        return walk(self.points, self.layers[0], q, starts, width)[0]


def usable(v: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.coalesce(F.forall(v, fine), F.lit(False)) & F.exists(v, lambda x: x != 0)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def build(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row: a shard's distinct vectors, its graph's arrays and which ids share a vector."""
    import pickle

    pdf = pdf.sort_values("vec_id")
    vectors = np.array(pdf.v.tolist(), np.float64)
    distinct, member = np.unique(vectors, axis=0, return_inverse=True)
    graph = Graph(_unit(distinct).astype(np.float32))
    data = pickle.dumps((graph, distinct, pdf.vec_id.to_numpy(), member.reshape(-1)))
    return pd.DataFrame({"dim": [pdf.dim.iloc[0]], "shard": [pdf.shard.iloc[0]], "data": [data]})


def _answers(frames, k: int, width: int):
    """Rows come shard by shard: the shard's index first, then blocks of queries, each answered and let go."""
    import pickle

    of = None
    for pdf in frames:
        for r in pdf.itertuples():
            if r.data is not None:
                graph, vectors, ids, member = pickle.loads(r.data)
                of = r.dim, r.shard
                order = np.argsort(member, kind="stable")
                first, exact = np.searchsorted(member[order], np.arange(len(vectors) + 1)), _unit(vectors)
                continue
            if of != (r.dim, r.shard):
                continue  # no rows of this length in the shard
            unit = _unit(np.array([list(x) for x in r.vs], np.float64))
            found = graph.search(unit.astype(np.float32), width)
            out = []
            for i, (qid, row) in enumerate(zip(r.qids, found, strict=True)):
                row = row[row >= 0]
                hits = []
                for s, x in zip((exact[row] @ unit[i]).tolist(), row.tolist(), strict=True):
                    same = ids[order[first[x] : first[x + 1]]]
                    hits += [(-s, int(v)) for v in same[same != qid][:k]]
                out += [(int(qid), v, -s) for s, v in sorted(hits)[:k]]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, every: int = 50, k: int = 5, width: int = WIDTH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: queries are the rows whose id `every` divides, candidates all rows but the query's."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col(id_col).isNotNull())
    rows = rows.withColumn("dim", F.size("v"))
    asks = F.col("vec_id") % every == 0
    n, n_asked = rows.agg(F.count("*"), F.count(F.when(asks, 1))).first()
    shards, blocks = max(LEAST_SHARDS, -(-n // SHARD_ROWS)), max(1, -(-n_asked // BLOCK))
    slices = -(-blocks // SLICE)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    index = stored(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, data binary"))
    # Blocks are numbered by hash and a block's rows by hash again, so that many rows of one id do not make one block.
    asked = rows.where(asks).distinct().withColumn("block", F.pmod(F.xxhash64("v", "vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.groupBy("dim", "block").agg(F.collect_list("vec_id").alias("qids"), F.collect_list("v").alias("vs"))
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), (F.col("block") % slices).cast("int").alias("slice"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("data"), "qids", "vs")
    graphs = index.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "data", F.lit(None).cast("array<bigint>").alias("qids"), F.lit(None).cast("array<array<double>>").alias("vs"))
    met = graphs.union(asked).repartition(max(1, min(shards * slices, 100_000)), "dim", "shard", "slice").sortWithinPartitions("dim", "shard", "slice", "kind").select("dim", "shard", "data", "qids", "vs")
    found = met.mapInPandas(lambda frames: _answers(frames, k, width), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
