"""Neighbour graphs (src, pos, dst): building, pruning, expanding and walking them by joins.

A walk or a cascade has a fixed number of rounds, so its plan is static; every round is a join of the frontier with the
graph, an anti-join with what was seen and a window. No graph is gathered or broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.arrow import matrix
from lodestar.operators.exact import exact_knn, score_pairs, top_k
from lodestar.operators.ivf import rescored, scanned
from lodestar.operators.scratch import Scratch


def from_ranked(knn: DataFrame) -> DataFrame:
    return knn.select(F.col("qid").alias("src"), F.col("rank").alias("pos"), F.col("vec_id").alias("dst"))


def exact_graph(rows: DataFrame, k: int, metric: str = "ip", column: str = "q") -> DataFrame:
    """Every row's k nearest others; all pairs in blocks, so for small tables and for measuring the others."""
    return from_ranked(exact_knn(rows, rows.withColumnRenamed("vec_id", "qid"), k, metric, column))


def neighbours(frontier: DataFrame, graph: DataFrame, edges: int) -> DataFrame:
    """(qid, vec_id): the first `edges` neighbours of the frontier, once each, the query's own row left out."""
    on = graph.where(F.col("pos") <= edges).select(F.col("src").alias("vec_id"), "dst")
    return frontier.select("qid", "vec_id").join(on, "vec_id").select("qid", F.col("dst").alias("vec_id")).where("vec_id <> qid").distinct()


def scored(pool: DataFrame, rows: DataFrame, queries: DataFrame, metric: str = "ip", column: str = "q", kind: str = "long") -> DataFrame:
    return scanned(pool.select("qid", "vec_id").join(rows.select("vec_id", column), "vec_id"), queries, column, metric, kind)


def fresh(found: DataFrame, seen: DataFrame) -> DataFrame:
    return found.join(seen.select("qid", "vec_id"), ["qid", "vec_id"], "left_anti")


def round_walk(entries: DataFrame, graph: DataFrame, rows: DataFrame, queries: DataFrame, rounds: int, beam: int, keep: int, edges: int, metric: str = "ip") -> DataFrame:
    """(qid, rank, vec_id, score): the best `keep` rows ever seen. Each round expands the best `beam` of the rows that the last one found."""
    seen = scored(entries.distinct(), rows, queries, metric)
    frontier = top_k(seen, beam)
    for _ in range(rounds):
        new = scored(fresh(neighbours(frontier, graph, edges), seen), rows, queries, metric)
        seen, frontier = seen.unionByName(new), top_k(new, beam)
    return top_k(seen, keep).select("qid", "rank", "vec_id", "score")


def cascade(pool: DataFrame, graph: DataFrame, rows: DataFrame, queries: DataFrame, hops: int, width: int, edges: int, seeds: DataFrame | None = None, best_first: bool = False, metric: str = "ip") -> DataFrame:
    """(qid, vec_id, score) of a pool (with scan scores) grown along the graph.

    By cohort: the best `width` rows of the pool are expanded; then, hops - 1 times, the best of the cohort just scored. Best
    first: every hop expands the best rows of all that are not yet expanded.
    """
    union = pool.select("qid", "vec_id")
    if best_first:
        if seeds is not None:
            union = union.union(seeds.select("qid", "vec_id")).distinct()
        known = scored(union, rows, queries, metric)
        expanded = None
        for _ in range(hops):
            front = top_k(known if expanded is None else fresh(known, expanded), width).select("qid", "vec_id")
            expanded = front if expanded is None else expanded.union(front)
            known = known.unionByName(scored(fresh(neighbours(front, graph, edges), known), rows, queries, metric))
        return known
    cohort = fresh(neighbours(top_k(pool, width), graph, edges), union)
    if seeds is not None:
        cohort = cohort.union(fresh(seeds.select("qid", "vec_id"), union)).distinct()
    known, cohort = scored(union, rows, queries, metric), scored(cohort, rows, queries, metric)
    known = known.unionByName(cohort)
    for _ in range(hops - 1):
        cohort = scored(fresh(neighbours(top_k(cohort, width), graph, edges), known), rows, queries, metric)
        known = known.unionByName(cohort)
    return known


def finished(known: DataFrame, rows: DataFrame, queries: DataFrame, keep: int, k: int = 10, metric: str = "ip") -> DataFrame:
    """The best `keep` by int8, then k by floats."""
    return rescored(top_k(known, keep), rows, queries, "x", metric, k)


def pruned(candidates: DataFrame, rows: DataFrame, degree: int, alpha: float = 1.2, column: str = "nx", most: int = 512) -> DataFrame:
    """(src, pos, dst): robust pruning under L2. The nearest candidate that is left is taken and removes those to which it is near
    enough, alpha^2 d(p, q) <= d(v, q); what was removed fills up to `degree`, nearest first.

    At most `most` candidates of a source are looked at, the nearest ones, so a group is bounded.
    """
    a = rows.select(F.col("vec_id").alias("src"), F.col(column).alias("_v"))
    b = rows.select(F.col("vec_id").alias("dst"), F.col(column).alias("_c"))
    both = candidates.select("src", "dst").where("src <> dst").distinct().join(a, "src").join(b, "dst")
    near = both.withColumn("_keep", F.col("_c"))
    near = top_k(score_pairs(near, "_v", "_c", "l2", "double"), most, "src", "score", "dst")

    def prune(key, table):
        order = np.lexsort((table.column("dst").to_numpy(), table.column("score").to_numpy()))
        x, d, ids = matrix(table.column("_keep").combine_chunks())[order], table.column("score").to_numpy()[order], table.column("dst").to_numpy()[order]
        left, taken, removed = np.ones(len(ids), bool), [], []
        for i in range(len(ids)):
            if len(taken) == degree:
                break
            if left[i]:
                taken.append(i)
                gone = left & (alpha * alpha * ((x - x[i]) ** 2).sum(1) <= d)
                gone[: i + 1] = False
                removed += np.nonzero(gone)[0].tolist()
                left &= ~gone
        taken += sorted(removed)[: degree - len(taken)]
        return pa.Table.from_pydict({"src": [key[0].as_py()] * len(taken), "pos": pa.array(range(1, len(taken) + 1), pa.int32()), "dst": ids[taken]}, schema=pa.schema([("src", pa.int64()), ("pos", pa.int32()), ("dst", pa.int64())]))

    return near.groupBy("src").applyInArrow(prune, "src long, pos int, dst long")


def with_reverse(graph: DataFrame, rows: DataFrame, degree: int, alpha: float = 1.2, column: str = "nx") -> DataFrame:
    """Reverse edges, 6 * degree of a node at most by order of hash, are added and all is pruned again."""
    w = Window.partitionBy("src").orderBy(F.xxhash64("dst"), "dst")
    back = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 6 * degree)
    return pruned(graph.select("src", "dst").union(back.select("src", "dst")), rows, degree, alpha, column)


def nn_descent(rows: DataFrame, k: int, rounds: int = 6, metric: str = "ip", column: str = "q", width: int | None = None, frozen: DataFrame | None = None, stop: float = 0.001) -> DataFrame:
    """(src, pos, dst): k neighbours of every row by local joins, without all pairs.

    It starts from rows near in an order by id hash. Each round joins a row's neighbours, forward and back, with theirs. It
    works on `width` neighbours (3 k by default) and as many back edges, the first by order of hash, which bounds a hub's
    share. Only pairs with a changed edge are looked at. With `frozen`, a graph of older rows, those rows keep their edges
    and only new rows' ones are looked for.
    """
    store, wide = Scratch(rows.sparkSession), width or 3 * k
    ids = rows.select("vec_id")
    new = ids if frozen is None else ids.join(frozen.select(F.col("src").alias("vec_id")).distinct(), "vec_id", "left_anti")
    # Rows in order of hash within buckets: some of them follow each row.
    buckets = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, ids.count() // 4096)))
    w = Window.partitionBy("_b").orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id")
    placed = ids.withColumn("_b", buckets).withColumn("_n", F.row_number().over(w)).withColumn("_m", F.count("*").over(Window.partitionBy("_b")))
    steps = placed.join(new, "vec_id").select(F.col("vec_id").alias("src"), "_b", F.explode(F.transform(F.sequence(F.lit(1), F.lit(wide)), lambda i: (F.col("_n") - 1 + i) % F.col("_m") + 1)).alias("_n"))
    start = steps.join(placed.select("_b", "_n", F.col("vec_id").alias("dst")), ["_b", "_n"]).select("src", "dst").where("src <> dst").distinct()

    def ranked(pairs: DataFrame) -> DataFrame:
        a = rows.select(F.col("vec_id").alias("src"), F.col(column).alias("_a"))
        b = rows.select(F.col("vec_id").alias("dst"), F.col(column).alias("_b"))
        s = score_pairs(pairs.join(a, "src").join(b, "dst").select("src", "dst", "_a", "_b"), "_a", "_b", metric)
        return top_k(s, wide, "src", "score", "dst").select("src", F.col("rank").alias("pos"), "dst", "score")

    graph = store(ranked(start).withColumn("is_new", F.lit(True)))
    n = graph.count()
    for turn in range(rounds):
        whole = graph.select("src", "dst", "is_new")
        if frozen is not None:
            whole = whole.union(frozen.select("src", "dst", F.lit(False)))
        cap = Window.partitionBy("dst").orderBy(F.xxhash64("src", F.lit(turn)), "src")
        back = whole.withColumn("_n", F.row_number().over(cap)).where(F.col("_n") <= wide).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "is_new")
        edges = whole.union(back).groupBy("src", "dst").agg(F.max("is_new").alias("is_new"))
        edges = store(edges)
        second = edges.select(F.col("src").alias("mid"), F.col("dst").alias("far"), F.col("is_new").alias("far_new"))
        pairs = edges.withColumnRenamed("dst", "mid").join(second, "mid").where("(is_new or far_new) and src <> far").select("src", F.col("far").alias("dst"))
        pairs = pairs.union(back.select("src", "dst")).join(new.select(F.col("vec_id").alias("src")), "src", "left_semi").distinct()
        better = ranked(pairs.union(graph.select("src", "dst")).distinct())
        before = graph.select("src", "dst", F.lit(False).alias("was"))
        graph = store(better.join(before, ["src", "dst"], "left").select("src", "pos", "dst", "score", F.coalesce("was", F.lit(True)).alias("is_new")))
        if graph.where("is_new").count() < stop * n:
            break
    out = graph.where(F.col("pos") <= k).select("src", "pos", "dst")
    out = store(out if frozen is None else out.union(frozen.select("src", "pos", "dst")))
    store.delete_all_but_last()
    return out


def co_retrieved(results: DataFrame, most: int) -> DataFrame:
    """(src, pos, dst, n): rows found by the same query, counted; the `most` commonest of each row, ties to the lower id. Results are top-k, so a query's pairs are bounded."""
    a, b = results.select("qid", F.col("vec_id").alias("src")), results.select("qid", F.col("vec_id").alias("dst"))
    n = a.join(b, "qid").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    w = Window.partitionBy("src").orderBy(F.desc("n"), "dst")
    return n.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).select("src", "pos", "dst", "n")


def hybrid(first: DataFrame, second: DataFrame, edges: int) -> DataFrame:
    """Edges of the first graph, then those of the second that are new, `edges` of a source at most."""
    both = first.select("src", "dst", F.struct(F.lit(0).alias("g"), "pos").alias("o")).union(second.select("src", "dst", F.struct(F.lit(1).alias("g"), "pos").alias("o")))
    one = both.groupBy("src", "dst").agg(F.min("o").alias("o"))
    return one.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy("o", "dst"))).where(F.col("pos") <= edges).select("src", "pos", "dst")


def best_first(c: np.ndarray, edges: np.ndarray, entries: list[int], q: np.ndarray, ef: int) -> list[int]:
    """Nodes of a graph in memory, nearest first: the best unexpanded one is expanded until it is worse than the ef-th found."""
    dist = lambda i: float(((c[i] - q) ** 2).sum())
    start = min(entries, key=lambda i: (dist(i), i))
    seen, open_ = {start: dist(start)}, {start}
    while open_:
        at = min(open_, key=lambda i: (seen[i], i))
        found = sorted(seen.items(), key=lambda p: (p[1], p[0]))
        if len(found) >= ef and seen[at] > found[ef - 1][1]:
            break
        open_.discard(at)
        for j in edges[at]:
            if j >= 0 and j not in seen:
                seen[j] = dist(j)
                open_.add(j)
    return [i for i, _ in sorted(seen.items(), key=lambda p: (p[1], p[0]))[:ef]]


def through_cells(rows: DataFrame, c: np.ndarray, edges: np.ndarray, entries: list[int], k: int, ef: int = 192, keep: str = "qid", column: str = "nx") -> DataFrame:
    """(keep, rank, cell): routing by a walk over a graph of centroids, which are bounded in number."""
    from lodestar.functions.arrow import map_batches

    def run(batch):
        found = [best_first(c, edges, entries, x, max(ef, k))[:k] for x in matrix(batch.column(column))]
        return {keep: np.repeat(np.asarray(batch.column(keep)), [len(f) for f in found]), "rank": np.concatenate([np.arange(1, len(f) + 1) for f in found]), "cell": np.concatenate(found)}

    return map_batches(rows.select(keep, column), run, f"{keep} long, rank int, cell int")


def cell_graph(c: np.ndarray, k: int) -> np.ndarray:
    """Each centroid's k nearest others; -1 where there are fewer."""
    d = ((c[:, None] - c[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    out = np.argsort(d, 1, kind="stable")[:, : min(k, len(c) - 1)]
    return out if out.shape[1] == k else np.pad(out, ((0, 0), (0, k - out.shape[1])), constant_values=-1)
