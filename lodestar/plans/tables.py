"""Reading the test tables, what the registered queries share, and the same in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import graph, ivf, routing
from lodestar.operators.routing import Cells
from lodestar.operators.space import Space, coded, fit_space, usable

#: Bounded samples that an index is fitted on: cells of the flat router, coarse cells, centroids of a sub-space.
N_CELLS, N_COARSE, N_BOOK = 20, 5, 16
#: Cells looked at, cells of each row, rows of a pool and of a reranked pool.
PROBES, COPIES, POOL, KEEP = 4, 2, 60, 20
EVERY = 100
#: Neighbours of a row in a graph.
DEGREE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """The embeddings of a folder: every row is indexed, every row with an id divisible by 100 is a query too."""

    def __init__(self, spark: SparkSession, sf_dir: str, fit_on: str | None = None) -> None:
        """fit_on: a condition on the rows that the mean, the scale and the cells come from; all by default."""
        self.spark = spark
        self.raw = usable(table(spark, sf_dir, "embeddings")).select("vec_id", F.col("embedding").alias("x"))
        self.fitted = self.raw if fit_on is None else self.raw.where(fit_on)

    @cached_property
    def space(self) -> Space:
        return fit_space(self.fitted)

    @cached_property
    def rows(self) -> DataFrame:
        return coded(self.raw, self.space)

    @cached_property
    def queries(self) -> DataFrame:
        return self.rows.where(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "qid")

    @cached_property
    def cells(self) -> Cells:
        return Cells([routing.pivots(coded(self.fitted, self.space), N_CELLS)])

    @cached_property
    def pivot_ids(self) -> list[int]:
        h = F.md5(F.col("vec_id").cast("string").cast("binary"))
        return [r.vec_id for r in self.fitted.orderBy(h, "vec_id").select("vec_id").limit(N_CELLS).collect()]

    @cached_property
    def graph(self) -> DataFrame:
        """(src, pos, dst): the exact int8 neighbours of every row."""
        return graph.exact_graph(self.rows, DEGREE)

    def directory(self) -> DataFrame:
        """(qid, vec_id): the rows that the cells come from, as entries of every query."""
        ids = F.array(*map(F.lit, self.pivot_ids)).cast("array<bigint>")
        return self.queries.select("qid", F.explode(ids).alias("vec_id")).where("vec_id <> qid")

    @cached_property
    def tree(self) -> Cells:
        fine = self.cells.finest
        return routing.under_nearest(fine[:N_COARSE], fine)

    @cached_property
    def assigned(self) -> DataFrame:
        return routing.flat(self.rows, self.cells, COPIES)

    @cached_property
    def lists(self) -> DataFrame:
        return ivf.build(self.assigned, self.rows)

    @cached_property
    def probes(self) -> DataFrame:
        return routing.flat(self.queries, self.cells, PROBES, "qid")

    @cached_property
    def pool(self) -> DataFrame:
        """(qid, vec_id, score): int8 L2 of the gathered rows, once each."""
        return ivf.dedup(ivf.scanned(ivf.gather(self.probes, self.lists), self.queries, "q", "l2"))


def ip(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


def l2(a: str, b: str) -> str:
    return f"(list_inner_product({a}, {a}) + list_inner_product({b}, {b}) - 2 * list_inner_product({a}, {b}))"


def ranked(frame: str, by: str, order: str, k: int, columns: str = "*") -> str:
    return f"(select {columns} from (select *, row_number() over (partition by {by} order by {order}) as rank from {frame}) where rank <= {k})"


_PRELUDE = f"""with e as (select vec_id, embedding::double[] as x from embeddings),
u as (select vec_id, unnest(x) as v, generate_subscripts(x, 1) as i from e),
mu as (select list(m order by i) as mu from (select i, avg(v) as m from u where <fit> group by i)),
mx as (select max(abs(v)) as top from u where <fit>),
q8 as (select vec_id, list_transform(x, lambda v: greatest(-127, least(127, round(v * 127 / top)))) as q from e, mx),
c8 as (select vec_id, list_transform(list_zip(x, mu), lambda p: p[1] - p[2]) as c from e, mu),
nf as (select vec_id, list_transform(c, lambda v: v / greatest(sqrt(list_inner_product(c, c)), 1e-9)) as nf from c8),
n8 as (select vec_id, list_transform(nf, lambda v: greatest(-127, least(127, round(127 * v)))) as nx from nf),
r as (select vec_id, x, q, nx from e join q8 using (vec_id) join n8 using (vec_id)),
qs as (select vec_id as qid, x as qx, q as qq, nx as qn from r where vec_id % {EVERY} = 0),
pv as (select (row_number() over (order by md5(vec_id::varchar), vec_id) - 1)::int as cell, vec_id as seed from e where <fit> qualify cell < {N_CELLS}),
cells as (select cell, nx as cx, q as cq from pv join r on seed = vec_id),
da as (select vec_id, cell, {l2('nx', 'cx')}::bigint as score from n8, cells),
ra as (select *, row_number() over (partition by vec_id order by score, cell) as rank from da),
lists as (select vec_id, cell, (rank - 1)::int as copy_no from ra where rank <= {COPIES}),
probes as (select vec_id as qid, cell, rank, score from ra where rank <= {PROBES} and vec_id % {EVERY} = 0),
gathered as (select p.qid, l.vec_id, p.cell, l.copy_no from probes p join lists l using (cell) where l.vec_id <> p.qid),
places as (select g.qid, g.vec_id, {l2('qq', 'q')}::bigint as score from gathered g join qs using (qid) join q8 on q8.vec_id = g.vec_id),
pool as (select qid, vec_id, min(score) as score from places group by qid, vec_id),
pool_t as {ranked('pool', 'qid', 'score, vec_id', POOL)},
tree as (select f.cell, f.cx, arg_min(c.cell, {l2('f.cx', 'c.cx')} * 100 + c.cell)::int as parent from cells f, cells c where c.cell < {N_COARSE} group by f.cell, f.cx),
truth as (select qid, rank, vec_id, score from {ranked(f"(select qid, vec_id, {l2('qx', 'x')} as score from qs, e where vec_id <> qid)", 'qid', 'score, vec_id', 10)})
"""


GRAPH_SQL = "g as (select src, rank as pos, dst from " + ranked(f"(select a.vec_id as src, b.vec_id as dst, -{ip('a.q', 'b.q')} as s from q8 a, q8 b where a.vec_id <> b.vec_id)", "src", "s, dst", DEGREE) + ")"


def sql(select: str, *ctes: str, fit: str = "true") -> str:
    """A query over the shared tables: rows r, queries qs, cells, lists, probes, pools and the truth."""
    return _PRELUDE.replace("<fit>", fit) + "".join(f", {c}\n" for c in ctes) + select
