"""Mixing sources to target weights by systematic sampling, as a native plan.

Every document of a source is expected rate = target / size-of-source times. Along a fixed order of the source's
documents the expected copies are summed up, one random offset per source is added, and a document is emitted once per
integer that its interval crosses. The order is by class of size and then by hash, so that sizes are sampled evenly and
the words taken come close to the target.

Sums over a source never meet in one task: documents are summed within (source, size class, hash prefix) blocks, and
only one count per block is summed up along a source: at most 256 blocks for each of some 4 classes per
doubling of size, whatever the source's rows. Within a block, documents are ordered by hash and then by id. Texts of any length
are measured whole. Null texts have size 0 and are taken 0 words; a null source is a source
of its own, after the others; no rows give no rows. Repeated rows are separate documents. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import WORD

# Weights of the sources in order, repeating; the share of all words that the mix takes; the most copies.
WEIGHTS = (5, 2, 1)
TOTAL_PERCENT = 150
MOST_COPIES = 2


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = TOTAL_PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, n_docs) to the same with `target`: weighted shares, none above `most` times its size.

    Handing out the excess again and again ends where every open source has level * weight and every other its cap; the
    level is found at once from sums along the order in which sources fill up. One row per source comes in.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    df = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    df = df.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("fill", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everything) * percent / 100.0
    df = df.withColumn("level", (budget - before) / open_weight)
    level = F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(everything)  # of the first source that stays open; later ones are lower
    first = F.coalesce(level, F.lit(float("inf")))
    return df.select("source", "source_size", "n_docs", F.least(first * F.col("weight"), F.col("cap")).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken (= copies * size)."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *_size_and_hash(seed, id_col, text_col))
    return mixed(df, seed).select("doc_id", "size", "source", "source_size", "target", "copies", "taken")


def copied(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows and columns of docs, every row as often as the mix takes it. Ids need not be unique: each row carries its columns along."""
    df = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *_size_and_hash(seed, id_col, text_col))
    taken = mixed(df, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def _size_and_hash(seed: str, id_col: str, text_col: str) -> tuple[Column, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string"), text).cast("binary")).alias("h")


def mixed(df: DataFrame, seed: str) -> DataFrame:
    """Adds source_size, target, copies and taken to rows with source, size and h (a hash, the order within a size class)."""
    digits = F.bin("size")
    df = df.withColumn("size_class", (F.length(digits) * 4 + F.conv(F.rpad(F.substring(digits, 2, 2), 2, "0"), 2, 10).cast("int")).cast("int"))
    df = df.withColumn("prefix", F.substring("h", 1, 2))
    blocks = df.groupBy("source", "size_class", "prefix").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    per_source = blocks.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum("words").alias("source_size"))
    shares = targets(per_source)
    earlier = Window.partitionBy("source").orderBy("size_class", "prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("source", "size_class", "prefix", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    s, t, d = starts.alias("s"), shares.alias("t"), df.alias("d")
    info = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select(F.col("s.source").alias("b_source"), F.col("s.size_class").alias("b_class"), F.col("s.prefix").alias("b_prefix"), "start", "source_size", "target", "n_docs")
    w = Window.partitionBy("source", "size_class", "prefix").orderBy("h", "doc_id")
    ranked = d.withColumn("place", F.row_number().over(w))
    joined = ranked.join(info, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size_class") == F.col("b_class")) & (F.col("prefix") == F.col("b_prefix")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|offset|"), F.coalesce(F.col("source"), F.lit("\x00"))).cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)
    end = F.col("start") + F.col("place")
    copies = F.floor(end * rate + offset) - F.floor((end - 1) * rate + offset)
    return joined.withColumn("copies", copies.cast("bigint")).withColumn("taken", F.col("copies") * F.col("size"))


SQL = r"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
a as (select doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as size, md5(concat_ws('|', 'mix', doc_id::varchar, t)) as h from d),
k as (select *, bin(size) as b from a),
c as (select *, length(b) * 4 + case rpad(substr(b, 2, 2), 2, '0') when '00' then 0 when '01' then 1 when '10' then 2 else 3 end as size_class from k),
z as (select source, sum(size) as source_size from a group by source),
w as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight, 2 * source_size::double as cap from z),
f as (select *, cap / weight as fill from w),
l as (select *, (sum(source_size) over () * 150 / 100.0 - coalesce(sum(cap) over (order by fill, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by fill, source nulls last rows between current row and unbounded following) as level from f),
m as (select *, max(case when level <= fill then level end) over () as first from l),
t as (select source, source_size, least(coalesce(first, 'inf'::double) * weight, cap) as target, case when source_size > 0 then least(coalesce(first, 'inf'::double) * weight, cap) / source_size::double else 0 end as rate,
  ('0x' || substr(md5('mix|offset|' || coalesce(source, chr(0))), 1, 12))::bigint::double / 281474976710656.0 as u from m),
r as (select *, row_number() over (partition by source order by size_class, h, doc_id) as i from c)
select doc_id, size::bigint as size, source_size::bigint as source_size, target, ((floor(i * rate + u) - floor((i - 1) * rate + u)) * size)::bigint as taken
from r join t on r.source is not distinct from t.source
"""
