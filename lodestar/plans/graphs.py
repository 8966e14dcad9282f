"""Graphs of neighbours: built, expanded, walked and pruned."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import adaptive, codecs, evaluate, exact, graph, ivf, routing
from lodestar.plans.catalog import query
from lodestar.plans.searches import _truth
from lodestar.plans.tables import GRAPH_SQL, KEEP, N_CELLS, POOL, Tables, ip, ranked, sql

_WIDTH, _EDGES = 16, 4
_S = f"(-{ip('qq', 'q')})::bigint"
_F = "-" + ip("qx", "x")


def _scored(frame: str, score: str = _S) -> str:
    return f"(select distinct qid, vec_id, {score} as score from {frame} join qs using (qid) join r using (vec_id))"


def _next(front: str, seen: str) -> str:
    """Neighbours of a frontier that are not seen yet."""
    return f"(select distinct f.qid, g.dst as vec_id from {front} f join g on g.src = f.vec_id and g.pos <= {_EDGES} where g.dst <> f.qid and not exists (select 1 from {seen} s where s.qid = f.qid and s.vec_id = g.dst))"


def _final(frame: str) -> str:
    kept = ranked(frame, "qid", "score, vec_id", KEEP, "qid, vec_id")
    return "select qid, rank::int as rank, vec_id, round(score, 6) as score from " + ranked(_scored(kept, _F), "qid", "score, vec_id", 10)


def _best(frame: str, n: int) -> str:
    return ranked(frame, "qid", "score, vec_id", n, "qid, vec_id, score")


@query("graph_exact_knn", sql("select src, pos::int as pos, dst from g", GRAPH_SQL))
def graph_exact_knn(spark, sf_dir):
    return Tables(spark, sf_dir).graph


@query("graph_expand_1hop", sql(f"select qid, vec_id from {_next(_best('pool', _WIDTH), 'pool')}", GRAPH_SQL))
def graph_expand_1hop(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.fresh(graph.neighbours(exact.top_k(t.pool, _WIDTH), t.graph, _EDGES), t.pool)


_SEEDS = "seeds as (select qid, seed as vec_id from qs, pv where seed <> qid)"
_COHORT = [GRAPH_SQL, f"p0 as {_best('pool', POOL)}", f"n1 as {_scored(_next(_best('p0', _WIDTH), 'p0'))}", f"k1 as (select * from {_scored('(select qid, vec_id from p0)')} union all select * from n1)", f"n2 as {_scored(_next(_best('n1', _WIDTH), 'k1'))}", "k2 as (select * from k1 union all select * from n2)"]


@query("graph_cascade", sql(_final("k2"), *_COHORT))
def graph_cascade(spark, sf_dir):
    """Pool, two hops by cohort, int8 cut, float finish."""
    t = Tables(spark, sf_dir)
    known = graph.cascade(exact.top_k(t.pool, POOL).select("qid", "vec_id", "score"), t.graph, t.rows, t.queries, 2, _WIDTH, _EDGES)
    return graph.finished(known, t.rows, t.queries, KEEP).withColumn("score", F.round("score", 6))


_BEST = [GRAPH_SQL, f"k0 as {_scored('(select qid, vec_id from ' + _best('pool', POOL) + ')')}", f"f1 as {_best('k0', _WIDTH)}", f"k1 as (select * from k0 union all select * from {_scored(_next('f1', 'k0'))})", f"f2 as {_best('(select * from k1 where not exists (select 1 from f1 where f1.qid = k1.qid and f1.vec_id = k1.vec_id))', _WIDTH)}", f"k2 as (select * from k1 union all select * from {_scored(_next('f2', 'k1'))})"]


@query("graph_cascade_best_first", sql(_final("k2"), *_BEST))
def graph_cascade_best_first(spark, sf_dir):
    t = Tables(spark, sf_dir)
    known = graph.cascade(exact.top_k(t.pool, POOL).select("qid", "vec_id", "score"), t.graph, t.rows, t.queries, 2, _WIDTH, _EDGES, best_first=True)
    return graph.finished(known, t.rows, t.queries, KEEP).withColumn("score", F.round("score", 6))


@query("pool_sources", sql(_final(f"(select * from k1 union all select * from {_scored('(select qid, vec_id from seeds s where not exists (select 1 from k1 where k1.qid = s.qid and k1.vec_id = s.vec_id))')})"), *_COHORT[:4], _SEEDS))
def pool_sources(spark, sf_dir):
    """Rows of the scan, of the graph and of a table of seeds, each once."""
    t = Tables(spark, sf_dir)
    known = graph.cascade(exact.top_k(t.pool, POOL).select("qid", "vec_id", "score"), t.graph, t.rows, t.queries, 1, _WIDTH, _EDGES, seeds=t.directory())
    return graph.finished(known, t.rows, t.queries, KEEP).withColumn("score", F.round("score", 6))


@query("seed_join", sql(f"select qid, vec_id, score from {_scored('seeds')}", _SEEDS))
def seed_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.scored(t.directory(), t.rows, t.queries)


_WALK = [GRAPH_SQL, _SEEDS, f"s0 as {_scored('seeds')}", f"f0 as {_best('s0', 8)}", f"w1 as {_scored(_next('f0', 's0'))}", "s1 as (select * from s0 union all select * from w1)", f"f1 as {_best('w1', 8)}", f"w2 as {_scored(_next('f1', 's1'))}", "s2 as (select * from s1 union all select * from w2)"]


@query("round_walk_2", sql("select qid, rank::int as rank, vec_id, score from " + ranked("s2", "qid", "score, vec_id", KEEP), *_WALK))
def round_walk_2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.round_walk(t.directory(), t.graph, t.rows, t.queries, 2, 8, KEEP, _EDGES)


@query("walk_search", sql(_final("s2"), *_WALK))
def walk_search(spark, sf_dir):
    """The walk, then floats."""
    t = Tables(spark, sf_dir)
    walked = graph.round_walk(t.directory(), t.graph, t.rows, t.queries, 2, 8, KEEP, _EDGES)
    return ivf.rescored(walked, t.rows, t.queries, "x", "ip", 10).withColumn("score", F.round("score", 6))


@query("medoid", sql(f"select vec_id, round(score, 6) as score from (select vec_id, {ip('mu', 'x')} as score from e, mu) order by round(score, 9) desc, vec_id limit 1"))
def medoid(spark, sf_dir):
    """The row of largest product with the mean."""
    from lodestar.functions.vectors import dot

    t = Tables(spark, sf_dir)
    s = dot(F.col("x"), F.array(*map(F.lit, t.space.mean.tolist())))
    return t.raw.select("vec_id", F.round(s, 9).alias("score")).orderBy(F.desc("score"), "vec_id").limit(1).withColumn("score", F.round("score", 6))


@query("graph_prune")
def graph_prune(spark, sf_dir):
    """The exact graph, diversified, with reverse edges."""
    t = Tables(spark, sf_dir)
    return graph.with_reverse(graph.pruned(t.graph, t.rows, 4), t.rows, 4)


@query("graph_nn_descent")
def graph_nn_descent(spark, sf_dir):
    return graph.nn_descent(Tables(spark, sf_dir).rows, DEGREE_OF_DESCENT)


DEGREE_OF_DESCENT = 10


@query("probe_centroid_graph", sql("select qid, rank::int as rank, cell from probes"))
def probe_centroid_graph(spark, sf_dir):
    """A walk over the cells' graph; with room for every cell it finds what the flat router finds."""
    from lodestar.operators.training import landmarks

    t = Tables(spark, sf_dir)
    c = t.cells.finest
    return graph.through_cells(t.queries, c, graph.cell_graph(c, 16), landmarks(c, 4), 4)


_FOUND = f"found as {ranked('(select qid, vec_id, ' + _S + ' as score from pool join qs using (qid) join r using (vec_id))', 'qid', 'score, vec_id', 10)}"


def _found(t: Tables):
    return ivf.rescored(t.pool, t.rows, t.queries, "q", "ip", 10, "long")


_CO = f"co as {ranked('(select a.vec_id as src, b.vec_id as dst, count(*) as n from found a join found b on a.qid = b.qid and a.vec_id <> b.vec_id group by 1, 2)', 'src', 'n desc, dst', 4)}"


@query("co_retrieval_edges", sql("select src, rank::int as pos, dst, n from co", _FOUND, _CO))
def co_retrieval_edges(spark, sf_dir):
    return graph.co_retrieved(_found(Tables(spark, sf_dir)), 4)


@query("graph_hybrid", sql("select src, pos::int as pos, dst from (select src, dst, row_number() over (partition by src order by o, pos, dst) as pos from (select src, dst, min(o) as o, arg_min(pos, o) as pos from (select src, dst, 0 as o, rank as pos from co union all select src, dst, 1, pos from g) group by src, dst)) where pos <= 8", GRAPH_SQL, _FOUND, _CO))
def graph_hybrid(spark, sf_dir):
    """Edges of rows found together come first, then neighbours."""
    t = Tables(spark, sf_dir)
    return graph.hybrid(graph.co_retrieved(_found(t), 4), t.graph, 8)


@query("cell_co_retrieval", sql("select src, rank::int as pos, dst, n from " + ranked("(select p.cell as src, l.cell as dst, count(*) as n from probes p join found f using (qid) join lists l on l.vec_id = f.vec_id where p.cell <> l.cell group by 1, 2)", "src", "n desc, dst", 4), _FOUND))
def cell_co_retrieval(spark, sf_dir):
    """From a routed cell to the cells of what the query found, counted."""
    from pyspark.sql import Window

    t = Tables(spark, sf_dir)
    targets = _found(t).select("qid", "vec_id").join(t.assigned.select("vec_id", F.col("cell").alias("dst")), "vec_id")
    n = t.probes.select("qid", F.col("cell").alias("src")).join(targets, "qid").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))).where("pos <= 4").select("src", "pos", "dst", "n")


@query("layout_keys", sql("select vec_id, min(cell) as low, max(cell) as high from lists group by vec_id"))
def layout_keys(spark, sf_dir):
    """The unordered pair of a row's cells, by which a file is sorted."""
    return Tables(spark, sf_dir).assigned.groupBy("vec_id").agg(F.min("cell").alias("low"), F.max("cell").alias("high"))


@query("pages_touched", sql("select qid, count(distinct floor(vec_id * 64 / 4096)) as pages from pool group by qid"))
def pages_touched(spark, sf_dir):
    return evaluate.touched(Tables(spark, sf_dir).pool, 64)


@query("query_cohorts", sql("select cell as cohort, count(*) as n_places, count(distinct pool.vec_id) as n_rows, round(count(distinct pool.vec_id) / count(*), 6) as distinct_share from pool join probes using (qid) where rank = 1 group by cell"))
def query_cohorts(spark, sf_dir):
    """Queries of one nearest cell: how far their pools are the same rows."""
    t = Tables(spark, sf_dir)
    return evaluate.cohorts(t.pool, t.probes.where("rank = 1").select("qid", F.col("cell").alias("cohort")))


@query("escalation", sql(_final("(select qid, vec_id, score from " + ranked(_scored("(select qid, vec_id from " + ranked(f"(select qid, vec_id, round(-sum(n * step * qv) - sum(qv * lo), 4) as score from pool join sc using (vec_id) join sq using (qid, i) group by qid, vec_id)", "qid", "score, vec_id", 2 * KEEP) + ")"), "qid", "score, vec_id", KEEP) + ")"), "uq as (select vec_id, unnest(q) as v, generate_subscripts(q, 1) as i from q8)", "rng as (select i, quantile_cont(v, 0.005) as lo, greatest(quantile_cont(v, 0.995) - quantile_cont(v, 0.005), 1) / 15 as step from uq group by i)", "sc as (select vec_id, i, greatest(0, least(15, round((v - lo) / step)))::int as n, lo, step from uq join rng using (i))", "sq as (select qid, unnest(qq) as qv, generate_subscripts(qq, 1) as i from qs)"))
def escalation(spark, sf_dir):
    """Scores from 4-bit codes first, int8 for the best 2 * keep, floats for the best `keep`."""
    from lodestar.functions.arrow import map_batches, matrix

    t = Tables(spark, sf_dir)
    s = codecs.fit_scalar(t.rows, 4, 0.005, 0.995)
    both = t.pool.select("qid", "vec_id").join(codecs.encoded(t.rows, s), "vec_id").join(t.queries.select("qid", "q"), "qid")

    def run(batch):
        score = -(s.decode(matrix(batch.column("code"))) * matrix(batch.column("q"))).sum(1)
        return {"qid": batch.column("qid"), "vec_id": batch.column("vec_id"), "score": score}

    nav = map_batches(both, run, "qid long, vec_id long, score double").withColumn("score", F.round("score", 4))
    known = ivf.rescored(exact.top_k(nav, 2 * KEEP), t.rows, t.queries, "q", "ip", KEEP, "long")
    return graph.finished(known.select("qid", "vec_id", "score"), t.rows, t.queries, KEEP).withColumn("score", F.round("score", 6))


def _places(t: Tables):
    """(qid, place, vec_id, score) of all cells in the order of the router."""
    routed = routing.flat(t.queries, t.cells, N_CELLS, "qid").select("qid", F.col("rank").alias("place"), "cell")
    both = routed.join(t.lists.select("cell", "vec_id", "q"), "cell").where("vec_id <> qid").join(t.queries.select("qid", F.col("q").alias("_q")), "qid").select("qid", "place", "vec_id", "q", "_q")
    return exact.score_pairs(both, "_q", "q", "l2", "long")


@query("adaptive_probe")
def adaptive_probe(spark, sf_dir):
    return adaptive.search(_places(Tables(spark, sf_dir)))


@query("cell_cover")
def cell_cover(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return adaptive.cover(_truth(t).select("qid", "vec_id").join(t.assigned.select("vec_id", "cell"), "vec_id"))


@query("portal_scan")
def portal_scan(spark, sf_dir):
    """(qid, rank, vec_id, score): buckets of the routed cells ranked by their centroids, the best 8 scored by floats."""
    from lodestar.operators.training import portals

    t = Tables(spark, sf_dir)
    members = portals(t.lists).select("cell", "vec_id", "portal", "portal_centroid")
    books = members.groupBy("cell", "portal").agg(F.first("portal_centroid").alias("c"))
    tiles = t.probes.select("qid", "cell").join(books, "cell").join(t.queries.select("qid", "nx"), "qid")
    best = exact.top_k(exact.score_pairs(tiles.select("qid", (F.col("cell").cast("long") * 100 + F.col("portal")).alias("vec_id"), "nx", "c"), "nx", "c", "ip", "long"), 8)
    pool = best.select("qid", "vec_id").join(members.select((F.col("cell").cast("long") * 100 + F.col("portal")).alias("tile"), F.col("vec_id").alias("row")), F.col("vec_id") == F.col("tile")).select("qid", F.col("row").alias("vec_id")).where("vec_id <> qid").distinct()
    return ivf.rescored(pool, t.rows, t.queries, "x", "l2", 10)


@query("edge_sketch", sql("select src, pos::int as pos, dst, list_max(list_transform(d, lambda v: abs(v)))::int as scale from (select src, pos, dst, list_transform(list_zip(a.q, b.q), lambda p: p[2] - p[1]) as d from g join q8 a on a.vec_id = src join q8 b on b.vec_id = dst)", GRAPH_SQL))
def edge_sketch(spark, sf_dir):
    """The largest displacement along each edge, the scale of a 4-bit sketch of it."""
    t = Tables(spark, sf_dir)
    a, b = t.rows.select(F.col("vec_id").alias("src"), F.col("q").alias("a")), t.rows.select(F.col("vec_id").alias("dst"), F.col("q").alias("b"))
    return t.graph.join(a, "src").join(b, "dst").select("src", "pos", "dst", F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(y.cast("int") - x))).alias("scale"))
