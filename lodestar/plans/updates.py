"""Updates: an index of the lower half of the ids, the upper half inserted, every fifth row of the lower half deleted."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import exact, ivf, routing
from lodestar.plans.catalog import query
from lodestar.plans.tables import COPIES, EVERY, PROBES, Tables, l2, ranked, sql
from lodestar.streaming import updates

_HALF = "vec_id < (select count(*) // 2 from embeddings)"
_LIVE = f"live as (select vec_id from e where not ({_HALF} and vec_id % 5 = 0))"
_FOUND = "found as " + ranked(f"(select distinct p.qid, l.vec_id, {l2('qx', 'x')} as score from probes p join lists l using (cell) join live using (vec_id) join qs using (qid) join e using (vec_id) where l.vec_id <> p.qid)", "qid", "score, vec_id", 10)


class _Workload:
    def __init__(self, spark, sf_dir) -> None:
        n = Tables(spark, sf_dir).raw.count()
        self.t = Tables(spark, sf_dir, f"vec_id < {n // 2}")
        self.main = self.t.raw.where(F.col("vec_id") < n // 2)
        inserted = self.t.raw.where(F.col("vec_id") >= n // 2).select(F.col("vec_id").alias("seq"), F.lit("I").alias("op"), "vec_id", "x")
        gone = self.main.where(F.col("vec_id") % 5 == 0).select((F.col("vec_id") + n).alias("seq"), F.lit("D").alias("op"), "vec_id", F.lit(None).cast("array<float>").alias("x"))
        self.log = inserted.unionByName(gone)

    def found(self):
        queries = self.t.raw.where(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "qid")
        return updates.search(updates.live(self.main, self.log), queries, self.t.space, self.t.cells, COPIES, PROBES)


@query("stream_insert", sql(f"select vec_id, cell, copy_no from lists where not ({_HALF})", fit=_HALF))
def stream_insert(spark, sf_dir):
    """Inserted rows under the cells of the frozen router."""
    w = _Workload(spark, sf_dir)
    from lodestar.operators.space import coded

    new = coded(w.log.where("op = 'I'"), w.t.space)
    return routing.flat(new, w.t.cells, COPIES).select("vec_id", "cell", (F.col("rank") - 1).alias("copy_no"))


@query("stream_delete", sql(f"select vec_id, true as known from e where {_HALF} and vec_id % 5 = 0"))
def stream_delete(spark, sf_dir):
    w = _Workload(spark, sf_dir)
    return updates.effective_deletes(w.main, w.log)


@query("stream_live", sql("select vec_id from live", _LIVE))
def stream_live(spark, sf_dir):
    w = _Workload(spark, sf_dir)
    return updates.live(w.main, w.log).select("vec_id")


@query("stream_search", sql("select qid, rank::int as rank, vec_id, round(score, 6) as score from found", _LIVE, _FOUND, fit=_HALF))
def stream_search(spark, sf_dir):
    return _Workload(spark, sf_dir).found().withColumn("score", F.round("score", 6))


_TRUE = "lt as " + ranked(f"(select qid, vec_id, {l2('qx', 'x')} as score from qs, e join live using (vec_id) where vec_id <> qid)", "qid", "score, vec_id", 10)


@query("stream_recall_live", sql("select count(*) as n_queries, round(avg(r), 6) as recall from (select lt.qid, count(found.vec_id) / count(*) as r from lt left join found using (qid, vec_id) group by lt.qid)", _LIVE, _FOUND, _TRUE, fit=_HALF))
def stream_recall_live(spark, sf_dir):
    """Recall against the live part of a truth that was ranked before the deletes."""
    w = _Workload(spark, sf_dir)
    queries = w.t.raw.where(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "qid")
    truth = exact.exact_knn(w.t.raw, queries, 200, "l2")
    return ivf.live_recall(w.found(), truth, updates.effective_deletes(w.main, w.log))
