"""Pools, reranking, whole searches and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import exact, ivf, routing
from lodestar.plans.catalog import query
from lodestar.plans.tables import EVERY, KEEP, N_CELLS, POOL, Tables, ip, l2, ranked, sql


def _truth(t: Tables, k: int = 10, metric: str = "l2"):
    return exact.exact_knn(t.raw, t.raw.where(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "qid"), k, metric)


def _rescore_sql(frame: str, score: str, k: int) -> str:
    return ranked(f"(select qid, vec_id, {score} as score from {frame} join qs using (qid) join r using (vec_id))", "qid", "score, vec_id", k, "qid, rank, vec_id, score")


_I8L2, _I8IP, _FIP, _FL2 = l2("qq", "q") + "::bigint", f"(-{ip('qq', 'q')})::bigint", "-" + ip("qx", "x"), l2("qx", "x")


@query("scan_pool", sql("select qid, vec_id, score from places"))
def scan_pool(spark, sf_dir):
    """Every place in the probed lists with its int8 score."""
    t = Tables(spark, sf_dir)
    return ivf.scanned(ivf.gather(t.probes, t.lists), t.queries, "q", "l2")


@query("pool_dedup_min", sql("select qid, vec_id, score from pool"))
def pool_dedup_min(spark, sf_dir):
    return Tables(spark, sf_dir).pool


@query("pool_topt", sql("select qid, vec_id, score, rank::int as rank from pool_t"))
def pool_topt(spark, sf_dir):
    return exact.top_k(Tables(spark, sf_dir).pool, POOL)


for _name, _score, _column, _metric, _kind in (("rerank_i8_l2", _I8L2, "q", "l2", "long"), ("rerank_i8_ip", _I8IP, "q", "ip", "long"), ("rerank_float_ip", f"round({_FIP}, 9)", "x", "ip", "double"), ("rerank_float_l2", f"round({_FL2}, 9)", "x", "l2", "double")):

    @query(_name, sql(f"select qid, rank::int as rank, vec_id, round(score, 6) as score from {_rescore_sql('pool_t', _score, 10)}"))
    def _rerank(spark, sf_dir, column=_column, metric=_metric, kind=_kind):
        t = Tables(spark, sf_dir)
        return ivf.rescored(exact.top_k(t.pool, POOL), t.rows, t.queries, column, metric, 10, kind).withColumn("score", F.round("score", 6))


_KEPT = f"kept as {_rescore_sql('pool_t', _I8IP, KEEP)}"


@query("cascade_i8_float", sql(f"select qid, rank::int as rank, vec_id, round(score, 6) as score from {_rescore_sql('(select qid, vec_id from kept)', _FIP, 10)}", _KEPT))
def cascade_i8_float(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ivf.cascade(exact.top_k(t.pool, POOL), t.rows, t.queries, "ip", KEEP, 10).withColumn("score", F.round("score", 6))


def _ivf(t: Tables, probes=None):
    lists = ivf.build(t.assigned, t.rows.select("vec_id", "x"))
    pool = ivf.dedup(ivf.scanned(ivf.gather(probes or t.probes, lists), t.queries, "x", "l2", "double"))
    return exact.top_k(pool, 10).select("qid", "rank", "vec_id", "score")


_IVF = f"found as {_rescore_sql('(select qid, vec_id from pool)', _FL2, 10)}"


@query("ivf_search", sql("select qid, rank::int as rank, vec_id, round(score, 6) as score from found", _IVF))
def ivf_search(spark, sf_dir):
    """Flat inverted file: the rows of the nearest cells, ranked by float L2."""
    return _ivf(Tables(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("ivf_all_probes", sql("select qid, rank::int as rank, vec_id, round(score, 6) as score from truth"))
def ivf_all_probes(spark, sf_dir):
    """With every cell probed an inverted file is exact."""
    t = Tables(spark, sf_dir)
    return _ivf(t, routing.flat(t.queries, t.cells, N_CELLS, "qid")).withColumn("score", F.round("score", 6))




@query("recall_at_10", sql("select count(distinct t.qid) as n_queries, count(f.vec_id) as hits, round(count(f.vec_id) / count(*), 6) as recall from truth t left join found f on f.qid = t.qid and f.vec_id = t.vec_id", _IVF))
def recall_at_10(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ivf.recall(_ivf(t), _truth(t))


@query("result_dump", sql("select qid, list(vec_id order by rank)[1]::bigint as first, count(*) as n from found group by qid", _IVF))
def result_dump(spark, sf_dir):
    return _ivf(Tables(spark, sf_dir)).groupBy("qid").agg(F.min_by("vec_id", "rank").alias("first"), F.count("*").alias("n"))


@query("result_verify", sql("select 0::bigint as only_first, 0::bigint as only_second"))
def result_verify(spark, sf_dir):
    """Two forms of the flat router, cell sets compared both ways."""
    t = Tables(spark, sf_dir)
    wide = routing.descended(t.queries, t.tree, [len(t.tree.levels[0])], 4, "qid")
    return ivf.same_results(t.probes.select("qid", "cell"), wide.select("qid", "cell"))


@query("containment", sql("select round(avg(h), 6) as contained from (select t.qid, count(k.vec_id) / 10 as h from truth t left join cheap k on k.qid = t.qid and k.vec_id = t.vec_id group by t.qid)", f"uu as {ranked(f'(select qid, vec_id, {_FL2} as s from qs, r where vec_id <> qid)', 'qid', 's, vec_id', 100, 'qid, vec_id')}", f"cheap as {ranked(f'(select qid, vec_id, {_I8IP} as s from uu join qs using (qid) join r using (vec_id))', 'qid', 's, vec_id', 30, 'qid, vec_id')}"))
def containment(spark, sf_dir):
    """The share of the true ten within the 30 best by int8 product of an exact top 100."""
    t = Tables(spark, sf_dir)
    union = _truth(t, 100)
    cheap = ivf.rescored(union, t.rows, t.queries, "q", "ip", 30, "long")
    return ivf.recall(cheap, union).select(F.col("recall").alias("contained"))


@query("hit_coverage", sql("select b::int as b, round(avg(case when rank <= b then 1 else 0 end), 6) as covered from (select t.qid, t.vec_id, min(a.rank) as rank from truth t join ra h on h.vec_id = t.vec_id and h.rank <= 2 join ra a on a.vec_id = t.qid and a.cell = h.cell group by t.qid, t.vec_id), (values (1), (2), (4), (8)) v(b) group by b"))
def hit_coverage(spark, sf_dir):
    """The share of true neighbours within the first b routed cells."""
    t = Tables(spark, sf_dir)
    routed = routing.flat(t.queries, t.cells, N_CELLS, "qid").select("qid", "cell", F.col("rank").alias("place"))
    at = _truth(t).select("qid", "vec_id").join(t.assigned.select("vec_id", "cell"), "vec_id").join(routed, ["qid", "cell"]).groupBy("qid", "vec_id").agg(F.min("place").alias("place"))
    by_b = at.select("place", F.explode(F.array(*map(F.lit, (1, 2, 4, 8)))).alias("b"))
    return by_b.groupBy("b").agg(F.round(F.avg(F.when(F.col("place") <= F.col("b"), 1).otherwise(0)), 6).alias("covered"))


@query("cell_radii", sql(f"select cell, round(max(sqrt({l2('nx', 'cx')})), 6) as radius from lists join n8 using (vec_id) join cells using (cell) group by cell"))
def cell_radii(spark, sf_dir):
    """The largest distance of a cell's members from its centroid."""
    t = Tables(spark, sf_dir)
    return t.assigned.groupBy("cell").agg(F.round(F.sqrt(F.max("score")), 6).alias("radius"))


@query("sphere_bound", sql(f"select qid, cell, round({ip('qn', 'cx')} + radius * sqrt({ip('qn', 'qn')}), 6) as bound from qs, cells join (select cell, max(sqrt({l2('nx', 'cx')})) as radius from lists join n8 using (vec_id) join cells using (cell) group by cell) using (cell)"))
def sphere_bound(spark, sf_dir):
    """What no product of the query with a member of the cell can exceed."""
    from lodestar.functions.arrow import map_batches, matrix

    t = Tables(spark, sf_dir)
    radii = t.assigned.groupBy("cell").agg(F.sqrt(F.max("score")).alias("radius"))
    c = t.cells.finest
    all_cells = routing.flat(t.queries, t.cells, len(c), "qid").join(radii, "cell").join(t.queries.select("qid", "nx"), "qid").select("qid", "cell", "radius", "nx")

    def run(batch):
        q, cell = matrix(batch.column("nx")), batch.column("cell").to_numpy()
        return {"qid": batch.column("qid"), "cell": cell, "bound": (q * c[cell]).sum(1) + batch.column("radius").to_numpy() * (q * q).sum(1) ** 0.5}

    return map_batches(all_cells, run, "qid long, cell int, bound double").withColumn("bound", F.round("bound", 6))


@query("partial_bound", sql(f"select qid, vec_id, round({ip('x', 'x')} + {ip('qx', 'qx')} - 2 * ({ip('x[1:16]', 'qx[1:16]')} + sqrt({ip('x[17:]', 'x[17:]')} * {ip('qx[17:]', 'qx[17:]')})), 6) as bound from pool join qs using (qid) join e using (vec_id)"))
def partial_bound(spark, sf_dir):
    """A lower bound of L2 from the first 16 components and the norms of the others."""
    import numpy as np

    from lodestar.functions.arrow import map_batches, matrix

    t = Tables(spark, sf_dir)
    both = t.pool.select("qid", "vec_id").join(t.raw, "vec_id").join(t.queries.select("qid", F.col("x").alias("qx")), "qid")

    def run(batch):
        x, q = matrix(batch.column("x")), matrix(batch.column("qx"))
        tail = np.sqrt((x[:, 16:] ** 2).sum(1) * (q[:, 16:] ** 2).sum(1))
        return {"qid": batch.column("qid"), "vec_id": batch.column("vec_id"), "bound": (x * x).sum(1) + (q * q).sum(1) - 2 * ((x[:, :16] * q[:, :16]).sum(1) + tail)}

    return map_batches(both, run, "qid long, vec_id long, bound double").withColumn("bound", F.round("bound", 6))


@query("pareto_frontier", sql("select p::int as p, score, cost from (select *, max(cost) over (order by score desc, cost desc, p rows between unbounded preceding and 1 preceding) as before from (select rank as p, sum(score)::bigint as score, (count(*) * (rank * 7 % 23))::bigint as cost from ra group by rank)) where before is null or cost > before"))
def pareto_frontier(spark, sf_dir):
    """Of points ordered by one measure, those that rise in the other; here made of the ranks of all cells."""
    from lodestar.operators.evaluate import frontier

    t = Tables(spark, sf_dir)
    points = routing.flat(t.rows, t.cells, N_CELLS).groupBy(F.col("rank").alias("p")).agg(F.sum(F.col("score").cast("long")).alias("score"), (F.count("*") * F.max(F.col("rank") * 7 % 23)).alias("cost"))
    return frontier(points, "score", "cost", "p")
