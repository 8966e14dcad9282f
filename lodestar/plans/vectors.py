"""Exact neighbours and functions of vectors, each over the whole table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestar.functions import vectors as V
from lodestar.functions.arrow import map_batches, matrix, rows_of
from lodestar.operators import codecs, exact, routing, training
from lodestar.plans.catalog import query
from lodestar.plans.tables import EVERY, Tables, ip, l2, ranked, sql


def _knn_sql(score: str, a: str, k: int = 10) -> str:
    return sql("select qid, rank::int as rank, vec_id, round(score, 6) as score from " + ranked(f"(select qid, vec_id, {score} as score from qs, r where vec_id <> qid)", "qid", "score, vec_id", k))


def _knn(name: str, column: str, asked: str, metric: str, k: int = 10) -> None:
    @query(name, _knn_sql(("-" + ip(asked, column)) if metric == "ip" else l2(asked, column), column, k))
    def run(spark, sf_dir):
        t = Tables(spark, sf_dir)
        rows = t.raw if column == "x" else t.rows
        queries = rows.where(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "qid")
        return exact.exact_knn(rows, queries, k, metric, column).withColumn("score", F.round("score", 6))


for _name, _column, _asked, _metric, _k in (("exact_knn_ip", "x", "qx", "ip", 10), ("exact_knn_l2", "x", "qx", "l2", 10), ("exact_knn_i8_ip", "q", "qq", "ip", 10), ("exact_knn_i8_l2", "q", "qq", "l2", 10), ("exact_top_u", "x", "qx", "ip", 100)):
    _knn(_name, _column, _asked, _metric, _k)


def _with_first(name: str, sql_value: str, value) -> None:
    """A function of every row's vector and that of the first cell's pivot, which is a constant of the plan."""

    @query(name, sql(f"select r.vec_id, {sql_value} as value from r, cells where cell = 0"))
    def run(spark, sf_dir):
        t = Tables(spark, sf_dir)
        first = {c: F.array(*map(F.lit, routing.pivots(t.rows, 1, c)[0].tolist())) for c in ("x", "q", "nx")}
        return t.rows.select("vec_id", value(first).alias("value"))


_with_first("fn_l2_i8", l2("nx", "cx") + "::int", lambda c: V.l2(F.col("nx"), c["nx"], "int"))
_with_first("fn_dot_i8", ip("nx", "cx") + "::int", lambda c: V.dot(F.col("nx"), c["nx"], "int"))
_with_first("fn_negdot_i8", f"(-{ip('nx', 'cx')})::int", lambda c: -V.dot(F.col("nx"), c["nx"], "int"))
_with_first("fn_l2_f32", f"round({l2('x', 'cq')}, 6)", lambda c: F.round(V.l2(F.col("x"), c["q"]), 6))
_with_first("fn_dot_f32", f"round({ip('x', 'cq')}, 6)", lambda c: F.round(V.dot(F.col("x"), c["q"]), 6))
_with_first("fn_sqnorm", ip("nx", "nx") + "::int", lambda c: V.sqnorm(F.col("nx"), "int"))


@query("fn_l2_block", sql("select vec_id, cell, score from da"))
def fn_l2_block(spark, sf_dir):
    """All distances to the cells by norms and one product."""
    t = Tables(spark, sf_dir)
    return routing.flat(t.rows, t.cells, len(t.cells.finest)).select("vec_id", "cell", F.col("score").cast("long").alias("score"))


_ITEMS = "select vec_id, (generate_subscripts({0}, 1) - 1)::int as dim, unnest({0}) as v from {1}"


@query("fn_quantize", sql("select vec_id, dim, v::int as v from (" + _ITEMS.format("q", "q8") + ")"))
def fn_quantize(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.raw.select("vec_id", F.posexplode(V.quantise(F.col("x"), t.space.top)).alias("dim", "v")).withColumn("v", F.col("v").cast("int"))


@query("fn_normalize", sql("select vec_id, dim, v::int as v from (" + _ITEMS.format("nx", "n8") + ")"))
def fn_normalize(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.rows.select("vec_id", F.posexplode("nx").alias("dim", "v")).withColumn("v", F.col("v").cast("int"))


@query("fn_normalize_f32", sql("select vec_id, dim, round(v, 6) as v from (" + _ITEMS.format("nf", "nf") + ")"))
def fn_normalize_f32(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.raw.select("vec_id", F.posexplode(V.unit(F.col("x"), t.space.mean.tolist())).alias("dim", "v")).withColumn("v", F.round("v", 6))


@query("agg_mean", sql("select (i - 1)::int as dim, round(avg(v), 6) as mean from u group by i"))
def agg_mean(spark, sf_dir):
    mean = Tables(spark, sf_dir).space.mean
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(mean)], "dim int, mean double").withColumn("mean", F.round("mean", 6))


_V = "list_transform(range(1, len(x) + 1), lambda i: i::double)"


@query("fn_rotate", sql(f"select vec_id, dim, round(v, 6) as v from (select vec_id, (generate_subscripts(y, 1) - 1)::int as dim, unnest(y) as v from (select vec_id, list_transform(x, lambda a, i: a - 2 * {ip('x', _V)} * i / {ip(_V, _V)}) as y from e))"))
def fn_rotate(spark, sf_dir):
    """The orthogonal map that reflects along (1, 2, .., d)."""
    t = Tables(spark, sf_dir)

    def run(batch):
        x = matrix(batch.column("x"))
        return {"vec_id": batch.column("vec_id"), "y": rows_of(codecs.Reflection(np.arange(1.0, x.shape[1] + 1))(x))}

    return map_batches(t.raw, run, "vec_id long, y array<double>").select("vec_id", F.posexplode("y").alias("dim", "v")).withColumn("v", F.round("v", 6))


@query("fn_f16")
def fn_f16(spark, sf_dir):
    """(vec_id, code, largest_error): halves of floats as bytes, and how far they are off."""

    def run(batch):
        x = matrix(batch.column("x"))
        h = x.astype("<f2")
        return {"vec_id": batch.column("vec_id"), "code": [row.tobytes() for row in h], "largest_error": np.abs(h.astype(float) - x).max(1)}

    return map_batches(Tables(spark, sf_dir).raw, run, "vec_id long, code binary, largest_error double")


def _ranges(bits: int, low: float, high: float) -> str:
    return f"rng as (select i, quantile_cont(v, {low}) as lo, greatest(quantile_cont(v, {high}) - quantile_cont(v, {low}), 1) / {2**bits - 1} as step from uq group by i)"


_UQ = "uq as (select vec_id, unnest(q) as v, generate_subscripts(q, 1) as i from q8)"


def _scalar(bits: int, low: float, high: float) -> None:
    code = f"sc as (select vec_id, i, greatest(0, least({2**bits - 1}, round((v - lo) / step)))::int as n, lo, step from uq join rng using (i))"

    @query(f"sq{bits}_ranges", sql("select (i - 1)::int as dim, round(lo, 6) as lo, round(step, 6) as step from rng", _UQ, _ranges(bits, low, high)))
    def ranges(spark, sf_dir):
        s = codecs.fit_scalar(Tables(spark, sf_dir).rows, bits, low, high)
        return spark.createDataFrame([(i, round(float(a), 6), round(float(b), 6)) for i, (a, b) in enumerate(zip(s.lo, s.step))], "dim int, lo double, step double")

    @query(f"sq{bits}_encode", sql("select vec_id, (i - 1)::int as dim, n as code from sc", _UQ, _ranges(bits, low, high), code))
    def encode(spark, sf_dir):
        t = Tables(spark, sf_dir)
        got = codecs.encoded(t.rows, codecs.fit_scalar(t.rows, bits, low, high))
        return got.select("vec_id", F.posexplode("code").alias("dim", "code")).withColumn("code", F.col("code").cast("int"))

    asked = "sq as (select qid, unnest(qq) as qv, generate_subscripts(qq, 1) as i from qs)"

    @query(f"sq{bits}_score", sql("select qid, vec_id, round(-sum(n * step * qv), 4) as folded, round(-sum(n * step * qv) - sum(qv * lo), 4) as score from pool join sc using (vec_id) join sq using (qid, i) group by qid, vec_id", _UQ, _ranges(bits, low, high), code, asked))
    def score(spark, sf_dir):
        """Products of codes and folded queries order a pool as products with the reconstructions do."""
        t = Tables(spark, sf_dir)
        s = codecs.fit_scalar(t.rows, bits, low, high)
        both = t.pool.join(codecs.encoded(t.rows, s), "vec_id").join(t.queries.select("qid", "q"), "qid").select("qid", "vec_id", "q", "code")

        def run(batch):
            q, n = matrix(batch.column("q")), matrix(batch.column("code"))
            return {"qid": batch.column("qid"), "vec_id": batch.column("vec_id"), "folded": -(n * s.fold(q)).sum(1), "score": -(s.decode(n) * q).sum(1)}

        return map_batches(both, run, "qid long, vec_id long, folded double, score double").select("qid", "vec_id", F.round("folded", 4).alias("folded"), F.round("score", 4).alias("score"))


_scalar(4, 0.005, 0.995)
_scalar(2, 0.02, 0.98)


@query("fn_lowrank_fold")
def fn_lowrank_fold(spark, sf_dir):
    """(vec_id, code): the 16 leading directions, in int8 under one scale."""
    t = Tables(spark, sf_dir)
    mean, p = training.principal(t.raw, 16)

    def run(batch):
        y = (matrix(batch.column("x")) - mean) @ p
        return {"vec_id": batch.column("vec_id"), "code": rows_of(np.clip(np.round(y * 127), -127, 127).astype(np.int8))}

    return map_batches(t.raw, run, "vec_id long, code array<tinyint>")
