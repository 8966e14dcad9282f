"""The inverted file: lists by cell, pools of candidates, their reranking and what is said of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.exact import score_pairs, top_k


def build(assigned: DataFrame, rows: DataFrame) -> DataFrame:
    """(cell, vec_id, copy_no, ..): every row under each of its cells, with the columns that a scan reads."""
    lists = assigned.select("vec_id", "cell", (F.col("rank") - 1).alias("copy_no"))
    return lists.join(rows, "vec_id")


def occupancy(lists: DataFrame) -> DataFrame:
    return lists.groupBy("cell").agg(F.count("*").alias("occupancy"))


def cell_stats(lists: DataFrame) -> DataFrame:
    return occupancy(lists).agg(F.count("*").alias("n_cells"), F.max("occupancy").alias("largest"), F.round(F.avg("occupancy"), 6).alias("mean"))


def gather(probes: DataFrame, lists: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """(qid, vec_id, ..): the lists of the probed cells, without the query's own row and deleted rows; a join on the cell."""
    pool = probes.select("qid", "cell").join(lists, "cell").where("vec_id <> qid")
    return pool if deleted is None else pool.join(deleted.select("vec_id").distinct(), "vec_id", "left_anti")


def scanned(pool: DataFrame, queries: DataFrame, column: str, metric: str, kind: str = "long") -> DataFrame:
    """(qid, vec_id, score) of every place in the pool; the rows come with their vectors."""
    both = pool.select("qid", "vec_id", F.col(column).alias("_row")).join(queries.select("qid", F.col(column).alias("_query")), "qid")
    return score_pairs(both, "_query", "_row", metric, kind)


def dedup(pool: DataFrame) -> DataFrame:
    """One place of each row, that of least score; always before a cut."""
    return pool.groupBy("qid", "vec_id").agg(F.min("score").alias("score"))


def pool_size(p: int, times: int = 30, floor: int = 0) -> int:
    return max(p * times, floor)


def rescored(pool: DataFrame, rows: DataFrame, queries: DataFrame, column: str, metric: str, k: int, kind: str = "double") -> DataFrame:
    """(qid, rank, vec_id, score): the pool's rows fetched by id, scored anew and cut to k."""
    both = pool.select("qid", "vec_id").join(rows.select("vec_id", column), "vec_id")
    return top_k(scanned(both, queries, column, metric, kind), k).select("qid", "rank", "vec_id", "score")


def cascade(pool: DataFrame, rows: DataFrame, queries: DataFrame, metric: str, keep: int, k: int) -> DataFrame:
    """int8 scores first; the best `keep` rows are scored by their floats."""
    return rescored(rescored(pool, rows, queries, "q", metric, keep, "long"), rows, queries, "x", metric, k)


def recall(found: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(n_queries, hits, recall): the share of the true k that is found, over all queries of the truth."""
    wanted = truth.where(F.col("rank") <= k).select("qid", "vec_id")
    hits = wanted.join(found.select("qid", "vec_id").distinct().withColumn("hit", F.lit(1)), ["qid", "vec_id"], "left")
    out = hits.agg(F.countDistinct("qid").alias("n_queries"), F.count("hit").alias("hits"), F.count("*").alias("wanted"))
    return out.select("n_queries", "hits", F.round(F.col("hits") / F.col("wanted"), 6).alias("recall"))


def live_recall(found: DataFrame, truth: DataFrame, deleted: DataFrame, k: int = 10) -> DataFrame:
    """Recall where the truth, ranked to sufficient depth, loses its deleted rows; the divisor is the live ones, k at most."""
    live = top_k(truth.drop("rank").join(deleted.select("vec_id").distinct(), "vec_id", "left_anti"), k)
    per_query = live.join(found.select("qid", "vec_id").distinct().withColumn("hit", F.lit(1)), ["qid", "vec_id"], "left").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("r"))
    every = truth.select("qid").distinct().join(per_query, "qid", "left")
    return every.agg(F.count("*").alias("n_queries"), F.round(F.avg(F.coalesce("r", F.lit(0.0))), 6).alias("recall"))


def same_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_first, only_second): rows in which two results differ, both ways."""
    one, two = F.lit(1).alias("one"), F.lit(0).alias("two")
    both = a.exceptAll(b).select(one, two).union(b.exceptAll(a).select(two, one))
    return both.agg(F.coalesce(F.sum("one"), F.lit(0)).alias("only_first"), F.coalesce(F.sum("two"), F.lit(0)).alias("only_second"))
