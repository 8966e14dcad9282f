"""Product codes and what is scored by them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestar.functions.arrow import map_batches, matrix, rows_of
from lodestar.operators import codecs, exact, ivf, training
from lodestar.plans.catalog import query
from lodestar.plans.tables import KEEP, N_BOOK, POOL, Tables, l2, ranked, sql

_SUB = 2
_PARTS = "{0} as (select {1}, s, [{2}[2 * s + 1], {2}[2 * s + 2]] as {3} from {4}, range((select len(q) // 2 from q8 limit 1)) t(s))"
_BOOK = f"book as (select cell as c, s, [cq[2 * s + 1], cq[2 * s + 2]] as cent from cells, range((select len(q) // 2 from q8 limit 1)) t(s) where cell < {N_BOOK})"
_SV = _PARTS.format("sv", "vec_id", "q", "v", "q8")
_CODES = f"cd as (select vec_id, s, arg_min(c, ({l2('v', 'cent')})::bigint * 100 + c)::int as code from sv join book using (s) group by vec_id, s)"
_QV = _PARTS.format("qv", "qid", "qq", "v", "qs")
_ETA = 4.0


def _book(t: Tables, eta: float = 1.0) -> codecs.Product:
    return codecs.Product(training.fixed_book(t.rows, _SUB, N_BOOK).book, eta)


@query("pq_encode", sql("select vec_id, s::int as sub, code from cd", _BOOK, _SV, _CODES))
def pq_encode(spark, sf_dir):
    t = Tables(spark, sf_dir)
    got = codecs.encoded(t.rows, _book(t))
    return got.select("vec_id", F.posexplode("code").alias("sub", "code")).withColumn("code", F.col("code").cast("int"))


_UNIT = "nv as (select vec_id, list_transform(q, lambda v: v / greatest(sqrt(list_inner_product(q, q)), 1e-9)) as w from q8)"
_WV = _PARTS.format("wv", "vec_id", "w", "d", "nv")
_ANISO = f"ca as (select vec_id, s, arg_min(c, {{'l': round({l2('v', 'cent')} + {_ETA - 1} * (list_inner_product(v, d) - list_inner_product(cent, d)) ** 2, 6), 'c': c}})::int as code from sv join wv using (vec_id, s) join book using (s) group by vec_id, s)"


@query("apq_encode", sql("select vec_id, s::int as sub, code from ca", _BOOK, _SV, _UNIT, _WV, _ANISO))
def apq_encode(spark, sf_dir):
    """Errors along the vector count eta times."""
    t = Tables(spark, sf_dir)
    got = codecs.encoded(t.rows, _book(t, _ETA))
    return got.select("vec_id", F.posexplode("code").alias("sub", "code")).withColumn("code", F.col("code").cast("int"))


@query("pq_decode", sql("select vec_id, (2 * cd.s + k - 1)::int as dim, cent[k]::int as v from cd join book on book.s = cd.s and c = code, (values (1), (2)) t(k)", _BOOK, _SV, _CODES))
def pq_decode(spark, sf_dir):
    t = Tables(spark, sf_dir)
    codec = _book(t)

    def run(batch):
        return {"vec_id": batch.column("vec_id"), "v": rows_of(codec.decode(matrix(batch.column("code"), np.int64)).astype(np.int32))}

    return map_batches(codecs.encoded(t.rows, codec), run, "vec_id long, v array<int>").select("vec_id", F.posexplode("v").alias("dim", "v"))


@query("pq_pack", sql("select vec_id, (a.s // 2)::int as byte, a.code + 16 * b.code as v from cd a join cd b using (vec_id) where a.s % 2 = 0 and b.s = a.s + 1", _BOOK, _SV, _CODES))
def pq_pack(spark, sf_dir):
    """Two codes a byte."""
    t = Tables(spark, sf_dir)

    def run(batch):
        return {"vec_id": batch.column("vec_id"), "v": rows_of(codecs.pack(matrix(batch.column("code"), np.int64)).astype(np.int32))}

    return map_batches(codecs.encoded(t.rows, _book(t)), run, "vec_id long, v array<int>").select("vec_id", F.posexplode("v").alias("byte", "v"))


_LUT = {"ip": "-list_inner_product(v, cent)", "l2": l2("v", "cent")}
for _metric, _value in _LUT.items():

    @query(f"pq_table_{_metric}", sql(f"select qid, s::int as sub, c::int as code, ({_value})::bigint as value from qv join book using (s)", _BOOK, _QV))
    def _table(spark, sf_dir, metric=_metric):
        """What each code of a sub-space adds to a query's scores."""
        t = Tables(spark, sf_dir)
        codec = _book(t)

        def run(batch):
            got = codec.table(matrix(batch.column("q")), metric)
            n, m, c = got.shape
            return {"qid": np.repeat(np.asarray(batch.column("qid")), m * c), "sub": np.tile(np.repeat(np.arange(m), c), n), "code": np.tile(np.arange(c), n * m), "value": got.ravel()}

        return map_batches(t.queries.select("qid", "q"), run, "qid long, sub int, code int, value long")

    @query(f"pq_adc_{_metric}", sql("select qid, vec_id, sum(value)::bigint as score from pool join cd using (vec_id) join lut using (qid, s, code) group by qid, vec_id", _BOOK, _SV, _CODES, _QV, f"lut as (select qid, s, c as code, {_value} as value from qv join book using (s))"))
    def _adc(spark, sf_dir, metric=_metric):
        t = Tables(spark, sf_dir)
        codec = _book(t)
        both = t.pool.select("qid", "vec_id").join(codecs.encoded(t.rows, codec), "vec_id")
        return codecs.code_scores(both, t.queries, codec, metric).withColumn("score", F.col("score").cast("long"))


_SCAN = "select qid, vec_id, sum(value)::bigint as score from gathered join cd using (vec_id) join lut using (qid, s, code) group by qid, vec_id, cell, copy_no"


@query("pq_search", sql("select qid, rank::int as rank, vec_id, score from fin", _BOOK, _SV, _CODES, _QV, f"lut as (select qid, s, c as code, {_LUT['l2']} as value from qv join book using (s))", f"sc as ({_SCAN})", "sd as (select qid, vec_id, min(score) as score from sc group by qid, vec_id)", f"st as {ranked('sd', 'qid', 'score, vec_id', POOL, 'qid, vec_id')}", f"fin as {ranked('(select qid, vec_id, ' + l2('qq', 'q') + '::bigint as score from st join qs using (qid) join q8 using (vec_id))', 'qid', 'score, vec_id', 10)}"))
def pq_search(spark, sf_dir):
    """Cells, codes in their lists, the best of the pool by code scores, then exact int8 L2."""
    t = Tables(spark, sf_dir)
    codec = _book(t)
    pool = ivf.gather(t.probes, ivf.build(t.assigned, codecs.encoded(t.rows, codec)))
    best = exact.top_k(ivf.dedup(codecs.code_scores(pool, t.queries, codec, "l2")), POOL)
    return ivf.rescored(best, t.rows, t.queries, "q", "l2", 10, "long")


@query("pq_nav_table", sql("select qid, s::int as sub, c::int as code, round(0.5 * list_inner_product(cent, cent) - list_inner_product(v, cent))::bigint as value from qv join book using (s)", _BOOK, _QV))
def pq_nav_table(spark, sf_dir):
    t = Tables(spark, sf_dir)
    codec = _book(t)

    def run(batch):
        got = codec.nav_table(matrix(batch.column("q")))
        n, m, c = got.shape
        return {"qid": np.repeat(np.asarray(batch.column("qid")), m * c), "sub": np.tile(np.repeat(np.arange(m), c), n), "code": np.tile(np.arange(c), n * m), "value": got.ravel()}

    return map_batches(t.queries.select("qid", "q"), run, "qid long, sub int, code int, value long")


_RES = [
    "cm as (select cell, list(v order by i) as cc from (select cell, i, round(avg(v)) as v from (select cell, unnest(q) as v, generate_subscripts(q, 1) as i from lists join q8 using (vec_id)) group by cell, i) group by cell)",
    "rs as (select vec_id, cell, copy_no, list_transform(list_zip(q, cc), lambda p: p[1] - p[2]) as z from lists join q8 using (vec_id) join cm using (cell))",
    _PARTS.format("rv", "vec_id, cell", "z", "v", "rs"),
    f"cr as (select vec_id, cell, s, arg_min(c, ({l2('v', 'cent')})::bigint * 100 + c)::int as code from rv join book using (s) group by vec_id, cell, s)",
]


@query("residual_score", sql("select qid, vec_id, cell, (sum(value) - list_inner_product(any_value(qq), any_value(cc)))::bigint as score from gathered join cr using (vec_id, cell) join lut using (qid, s, code) join qs using (qid) join cm using (cell) group by qid, vec_id, cell", _BOOK, *_RES, _QV, f"lut as (select qid, s, c as code, {_LUT['ip']} as value from qv join book using (s))"))
def residual_score(spark, sf_dir):
    """Codes of rows less their cell's mean; a score adds the query's product with that mean."""
    t = Tables(spark, sf_dir)
    codec = _book(t)
    means = t.lists.select("cell", F.posexplode("q").alias("i", "v")).groupBy("cell", "i").agg(F.round(F.avg("v")).cast("int").alias("v")).groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("mean"))
    residuals = t.lists.join(means, "cell").withColumn("z", F.zip_with("q", "mean", lambda a, b: a.cast("int") - b))
    lists = codecs.encoded(residuals, codec, "z", ("cell", "vec_id", "mean"))
    both = ivf.gather(t.probes, lists).join(t.queries.select("qid", "q"), "qid")

    def run(batch):
        q = matrix(batch.column("q"))
        score = codecs.adc(codec.table(q, "ip"), matrix(batch.column("code"), np.int64)) - (q * matrix(batch.column("mean"))).sum(1)
        return {"qid": batch.column("qid"), "vec_id": batch.column("vec_id"), "cell": batch.column("cell"), "score": score}

    return map_batches(both, run, "qid long, vec_id long, cell int, score long")


def _distortions(spark, rows) -> object:
    return spark.createDataFrame([(a, float(b)) for a, b in rows], "codec string, distortion double")


@query("pq_train")
def pq_train(spark, sf_dir):
    """(codec, distortion): fixed and trained codebooks, a learned rotation, an anisotropic codebook."""
    t = Tables(spark, sf_dir)
    trained = training.train_product(t.rows, _SUB, N_BOOK, 4)
    rotation, turned = training.train_rotation(t.rows, _SUB, 2)
    aniso = training.train_product(t.rows, _SUB, N_BOOK, 3, _ETA)
    return _distortions(spark, [("fixed", training.distortion(t.rows, _book(t))), ("trained", training.distortion(t.rows, trained)), ("rotated", training.distortion(t.rows, turned, rotation=rotation)), ("anisotropic", training.distortion(t.rows, aniso))])


def _binary(bits: int) -> None:
    @query(f"rabitq{bits}_search")
    def run(spark, sf_dir):
        """(qid, rank, vec_id, score): the best of all probed rows by binary codes, then by int8 products."""
        t = Tables(spark, sf_dir)
        codec = codecs.Binary(codecs.random_rotation(len(t.space.mean)), bits)

        def encode(batch):
            u, cadd, cmul = codec.encode(matrix(batch.column("q")))
            return {"vec_id": batch.column("vec_id"), "code": rows_of(u), "cadd": cadd, "cmul": cmul}

        codes = map_batches(t.rows.select("vec_id", "q"), encode, "vec_id long, code array<tinyint>, cadd double, cmul double")
        both = ivf.gather(t.probes, ivf.build(t.assigned, codes)).join(t.queries.select("qid", "q"), "qid")

        def score(batch):
            s = codec.score(matrix(batch.column("q")), matrix(batch.column("code")), np.asarray(batch.column("cadd")), np.asarray(batch.column("cmul")), "ip")
            return {"qid": batch.column("qid"), "vec_id": batch.column("vec_id"), "score": s}

        pool = exact.top_k(ivf.dedup(map_batches(both, score, "qid long, vec_id long, score double")), POOL)
        return ivf.rescored(pool, t.rows, t.queries, "q", "ip", 10, "long")


_binary(1)
_binary(4)


@query("opq_search")
def opq_search(spark, sf_dir):
    """A learned rotation before product codes; int8 products rank the pool."""
    t = Tables(spark, sf_dir)
    rotation, codec = training.train_rotation(t.rows, _SUB, 1)

    def turn(batch):
        return {"vec_id": batch.column("vec_id"), "z": rows_of(matrix(batch.column("q")) @ rotation.T)}

    turned = map_batches(t.rows.select("vec_id", "q"), turn, "vec_id long, z array<double>")
    asked = turned.join(t.queries.select(F.col("qid").alias("vec_id")), "vec_id").withColumnRenamed("vec_id", "qid")
    pool = ivf.gather(t.probes, ivf.build(t.assigned, codecs.encoded(turned, codec, "z")))
    best = exact.top_k(ivf.dedup(codecs.code_scores(pool, asked, codec, "ip", "z")), KEEP)
    return ivf.rescored(best, t.rows, t.queries, "q", "ip", 10, "long")
