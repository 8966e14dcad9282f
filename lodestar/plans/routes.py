"""Routers, assignment and the inverted lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import ivf, routing, training
from lodestar.plans.catalog import query
from lodestar.plans.tables import COPIES, N_COARSE, PROBES, Tables, ip, l2, ranked, sql

_LONG = "cast(score as long) as score"


@query("assign_top1", sql("select vec_id, cell, score from ra where rank = 1"))
def assign_top1(spark, sf_dir):
    """The nearest pivot of every row."""
    t = Tables(spark, sf_dir)
    return routing.flat(t.rows, t.cells, 1).selectExpr("vec_id", "cell", _LONG)


@query("assign_topa0", sql("select vec_id, cell, copy_no from lists"))
def assign_topa0(spark, sf_dir):
    """What is written of an assignment: a row for each stored copy."""
    return Tables(spark, sf_dir).assigned.select("vec_id", "cell", (F.col("rank") - 1).alias("copy_no"))


def _spill_sql(loss: str) -> str:
    first = "fst as (select ra.vec_id, ra.cell as c0, nx, list_transform(list_zip(nx, cx), lambda p: p[1] - p[2]) as r0 from ra join n8 using (vec_id) join cells using (cell) where rank = 1)"
    r = "rr as (select *, list_transform(r0, lambda v: v / greatest(sqrt(list_inner_product(r0, r0)), 1e-9)) as ru from fst)"
    losses = f"ls as (select vec_id, cell, case when cell = c0 then '-inf'::double else round({loss}, 6) end as loss, {l2('nx', 'cx')}::bigint as score from rr, cells)"
    return sql("select vec_id, cell, rank::int as rank, score from " + ranked("ls", "vec_id", "loss, cell", 3), first, r, losses)


for _rule, _loss in (("soar", f"{l2('nx', 'cx')} + ({ip('nx', 'ru')} - {ip('cx', 'ru')}) ** 2"), ("rair", f"{l2('nx', 'cx')} - {ip('r0', 'cx')}")):

    @query(f"assign_{_rule}", _spill_sql(_loss))
    def _assign(spark, sf_dir, rule=_rule):
        t = Tables(spark, sf_dir)
        return routing.spilled(t.rows, t.cells, 3, rule).selectExpr("vec_id", "cell", "rank", _LONG)


@query("probe_flat", sql("select qid, cell from probes"))
def probe_flat(spark, sf_dir):
    return Tables(spark, sf_dir).probes.select("qid", "cell")


@query("probe_ranked", sql("select qid, rank::int as rank, cell, score from probes"))
def probe_ranked(spark, sf_dir):
    return Tables(spark, sf_dir).probes.selectExpr("qid", "rank", "cell", _LONG)


@query("probe_gamma", sql("select qid, rank::int as rank, cell, score::bigint as score from " + ranked(f"(select qid, cell, {l2('qn', 'cx')} + round((1.25::double - 1) * {ip('cx', 'cx')}) as score from qs, cells)", "qid", "score, cell", PROBES)))
def probe_gamma(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return routing.flat(t.queries, t.cells, PROBES, "qid", gamma=1.25).selectExpr("qid", "rank", "cell", _LONG)


@query("probe_margin", sql(f"select qid, (max(case when rank = {PROBES + 1} then score end) - max(case when rank = {PROBES} then score end))::bigint as margin from ra join qs on qid = vec_id group by qid"))
def probe_margin(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return routing.margin(routing.flat(t.queries, t.cells, PROBES + 1, "qid"), PROBES).withColumn("margin", F.col("margin").cast("long"))


_BEAM = 2
_HIER = f"top as (select qid, cell as parent from {ranked('(select qid, cell, ' + l2('qn', 'cx') + f' as s from qs, cells where cell < {N_COARSE})', 'qid', 's, cell', _BEAM)})"


def _hier_sql(bias: str = "") -> str:
    return sql("select qid, rank::int as rank, cell, score::bigint as score from " + ranked(f"(select qid, cell, {l2('qn', 'cx')}{bias} as score from top join tree using (parent) join qs using (qid))", "qid", "score, cell", PROBES), _HIER)


for _name, _gamma, _bias in (("probe_hier2", 1.0, ""), ("probe_hier2_gamma", 1.25, f" + round((1.25::double - 1) * {ip('cx', 'cx')})")):

    @query(_name, _hier_sql(_bias))
    def _hier(spark, sf_dir, gamma=_gamma):
        t = Tables(spark, sf_dir)
        return routing.descended(t.queries, t.tree, [_BEAM], PROBES, "qid", gamma=gamma).selectExpr("qid", "rank", "cell", _LONG)


@query("probe_beam_override", sql("select qid, rank::int as rank, cell, score from probes"))
def probe_beam_override(spark, sf_dir):
    """A beam as wide as the coarse level gives what the flat router gives."""
    t = Tables(spark, sf_dir)
    return routing.descended(t.queries, t.tree, [N_COARSE], PROBES, "qid").selectExpr("qid", "rank", "cell", _LONG)


_MID = 10
_PARENT = f"arg_min(c.cell, {l2('f.cx', 'c.cx')} * 100 + c.cell)::int as parent"
_TREE3 = [
    f"t1 as (select f.cell, f.cx, {_PARENT} from cells f, cells c where f.cell < {_MID} and c.cell < {N_COARSE} group by f.cell, f.cx)",
    f"t2 as (select f.cell, f.cx, {_PARENT} from cells f, cells c where c.cell < {_MID} group by f.cell, f.cx)",
    _HIER,
    f"mid as (select qid, cell as parent from {ranked('(select qid, t1.cell, ' + l2('qn', 't1.cx') + ' as s from top join t1 using (parent) join qs using (qid))', 'qid', 's, cell', 3)})",
]


@query("probe_hier3", sql("select qid, rank::int as rank, cell, score::bigint as score from " + ranked(f"(select qid, t2.cell, {l2('qn', 't2.cx')} as score from mid join t2 using (parent) join qs using (qid))", "qid", "score, cell", PROBES), *_TREE3))
def probe_hier3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    fine = t.cells.finest
    two, three = routing.under_nearest(fine[:N_COARSE], fine[:_MID]), routing.under_nearest(fine[:_MID], fine)
    cells = routing.Cells([*two.levels, fine], [*two.parents, three.parents[1]])
    return routing.descended(t.queries, cells, [_BEAM, 3], PROBES, "qid").selectExpr("qid", "rank", "cell", _LONG)


@query("assign_soar_hier", _spill_sql(f"{l2('nx', 'cx')} + ({ip('nx', 'ru')} - {ip('cx', 'ru')}) ** 2"))
def assign_soar_hier(spark, sf_dir):
    """Spilling below a tree: with every leaf a candidate it is the flat rule on the finest cells."""
    t = Tables(spark, sf_dir)
    return routing.spilled(t.rows, t.tree, 3, "soar").selectExpr("vec_id", "cell", "rank", _LONG)


_BOOKS = [f"c0 as (select cell as i, cx as a from cells where cell < {N_COARSE})", f"c1 as (select cell - {N_COARSE} as j, cx as b from cells where cell >= {N_COARSE} and cell < {2 * N_COARSE})"]
_AVQ = "({0} - 2 * {1} + {2} - 2 * {3} + 2 * {4})".format(ip("a", "a"), ip("{x}", "a"), ip("b", "b"), ip("{x}", "b"), ip("a", "b"))


@query("probe_avq", sql("select qid, rank::int as rank, cell, score::bigint as score from " + ranked(f"(select qid, (i * {N_COARSE} + j)::int as cell, {_AVQ.format(x='qn')} as score from qs, c0, c1)", "qid", "score, cell", PROBES), *_BOOKS))
def probe_avq(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = t.cells.finest
    return routing.product(t.queries, c[:N_COARSE], c[N_COARSE : 2 * N_COARSE], PROBES, "qid").selectExpr("qid", "rank", "cell", _LONG)


_A0 = "a0 as " + ranked(f"(select vec_id, nx, i, a, {ip('a', 'a')} - 2 * {ip('nx', 'a')} as s from n8, c0)", "vec_id", "s, i", COPIES)
_A1 = f"a1 as (select vec_id, rank, (i * {N_COARSE} + j)::int as cell, {_AVQ.format(x='nx')} as score, row_number() over (partition by vec_id, i order by {_AVQ.format(x='nx')}, j) as n from a0, c1)"


@query("assign_avq", sql("select vec_id, rank::int as rank, cell, score::bigint as score from a1 where n = 1", *_BOOKS, _A0, _A1))
def assign_avq(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = t.cells.finest
    return routing.product_assigned(t.rows, c[:N_COARSE], c[N_COARSE : 2 * N_COARSE], COPIES).selectExpr("vec_id", "rank", "cell", _LONG)


@query("cell_occupancy", sql("select cell, count(*) as occupancy from lists group by cell"))
def cell_occupancy(spark, sf_dir):
    return ivf.occupancy(Tables(spark, sf_dir).assigned)


@query("cell_stats", sql("select count(*) as n_cells, max(n) as largest, round(avg(n), 6) as mean from (select count(*) as n from lists group by cell)"))
def cell_stats(spark, sf_dir):
    return ivf.cell_stats(Tables(spark, sf_dir).assigned)


@query("route_features", sql(f"select qid, p.rank::int as rank, p.cell, t.parent, {l2('qn', 't.cx')} as fine_score, {l2('qn', 'c.cx')} as parent_score, {ip('t.cx', 't.cx')} as fine_norm, {ip('c.cx', 'c.cx')} as parent_norm, coalesce(o.n, 0) as occupancy from probes p join qs using (qid) join tree t on t.cell = p.cell join cells c on c.cell = t.parent left join (select cell, count(*) as n from lists group by cell) o on o.cell = p.cell"))
def route_features(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return routing.features(t.probes, t.queries, t.tree, ivf.occupancy(t.assigned)).select("qid", "rank", "cell", "parent", "fine_score", "parent_score", "fine_norm", "parent_norm", "occupancy")


@query("router_meta", sql("select cell, parent, (generate_subscripts(cx, 1) - 1)::int as dim, unnest(cx)::int as v, coalesce(n, 0) as occupancy from tree left join (select cell, count(*) as n from lists group by cell) o using (cell)"))
def router_meta(spark, sf_dir):
    """Each cell's parent, centroid and occupancy."""
    t = Tables(spark, sf_dir)
    cells = spark.createDataFrame([(i, int(t.tree.parents[1][i]), c.astype(int).tolist()) for i, c in enumerate(t.tree.finest)], "cell int, parent int, centroid array<int>")
    out = cells.join(ivf.occupancy(t.assigned), "cell", "left").withColumn("occupancy", F.coalesce("occupancy", F.lit(0).cast("long")))
    return out.select("cell", "parent", F.posexplode("centroid").alias("dim", "v"), "occupancy")


@query("probe_gather", sql("select qid, vec_id, cell, copy_no from gathered"))
def probe_gather(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ivf.gather(t.probes, t.lists).select("qid", "vec_id", "cell", "copy_no")


@query("residual_centroids", sql("select cell, (i - 1)::int as dim, round(avg(v))::int as v from (select cell, unnest(q) as v, generate_subscripts(q, 1) as i from lists join q8 using (vec_id)) group by cell, i"))
def residual_centroids(spark, sf_dir):
    """Rounded int8 mean of each cell's rows."""
    t = Tables(spark, sf_dir)
    return t.lists.select("cell", F.posexplode("q").alias("dim", "v")).groupBy("cell", "dim").agg(F.round(F.avg("v")).cast("int").alias("v"))


@query("lloyd_step", sql("select cell, count(distinct vec_id) as n, (i - 1)::int as dim, round(avg(v), 6) as v from (select cell, vec_id, unnest(nx) as v, generate_subscripts(nx, 1) as i from ra join n8 using (vec_id) where rank = 1) group by cell, i"))
def lloyd_step(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c, n, _ = training.lloyd_step(t.rows, t.cells.finest)
    rows = [(i, int(n[i]), [round(v, 9) for v in c[i].tolist()]) for i in range(len(c)) if n[i]]
    return spark.createDataFrame(rows, "cell int, n long, v array<double>").select("cell", "n", F.posexplode("v").alias("dim", "v")).withColumn("v", F.round("v", 6))


@query("train_tree", sql("select cell, parent from tree"))
def train_tree(spark, sf_dir):
    """A tree of pivots: each under its nearest coarse pivot."""
    t = Tables(spark, sf_dir)
    return spark.createDataFrame([(i, int(p)) for i, p in enumerate(t.tree.parents[1])], "cell int, parent int")


@query("train_kmeans")
def train_kmeans(spark, sf_dir):
    """(step, inertia): it never grows."""
    _, inertia = training.k_means(Tables(spark, sf_dir).rows, 20, 5)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(inertia)], "step int, inertia double")


@query("train_hier_kmeans")
def train_hier_kmeans(spark, sf_dir):
    """(level, cell, parent, centroid) of a trained tree whose levels are then refitted together."""
    t = Tables(spark, sf_dir)
    cells = training.tree_em(t.rows, training.tree(t.rows, [4, 16], 3), 1)
    rows = [(level, i, int(up[i]) if level else -1, c[i].tolist()) for level, (c, up) in enumerate(zip(cells.levels, cells.parents)) for i in range(len(c))]
    return spark.createDataFrame(rows, "level int, cell int, parent int, centroid array<double>")


@query("landmarks")
def landmarks(spark, sf_dir):
    """Farthest cells in turn, from the first."""
    t = Tables(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(training.landmarks(t.cells.finest, 5))), "pos int, cell int")


@query("cell_portals")
def cell_portals(spark, sf_dir):
    return training.portals(Tables(spark, sf_dir).lists)
