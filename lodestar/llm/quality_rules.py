"""Quality rules as one native projection.

A table of thresholds is compiled into a single boolean expression over statistics of the whole text. No row is
shuffled and no user function runs. Null and empty texts have no words, so every count is 0 and the base rule fails.
Extra columns of the input are ignored; repeated rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import SPACE, let, words

# Frequent function words of the languages that are kept.
STOP_WORDS = """
the of and to in is that for it was with as be by on at this are from or an he his her they you
der die das und ist nicht mit den von zu ein eine im auf für dem des sich als
le la les de des et un une que qui est en du dans pour par sur au pas avec
el los las y una por con para su se no es lo del al como
""".split()


@dataclass(frozen=True)
class Rule:
    """A document passes if 100 * stat lies in [low, high] times its base; integers, so that engines agree."""

    stat: str
    base: str
    low: int | None = None
    high: int | None = None


#: Percentages: a clean text has words of 2 to 12 characters on average, few symbols, few repeated lines, function words.
RULES = (
    Rule("word_chars", "n_words", low=200, high=1200),
    Rule("n_symbols", "n_words", high=30),
    Rule("n_dup_lines", "n_lines", high=30),
    Rule("n_stop_words", "n_words", low=2),
)


def _repeated_words(df: DataFrame, width: int) -> DataFrame:
    """Adds n_repeat_words: words inside windows of `width` words that occur twice or more in the text.

    Windows are compared by 64-bit hash. One array per text is sorted that has the hash's upper bits and the window's
    place in each long; equal neighbours are then compared by their whole hashes.
    """
    n = F.size("w") - (width - 1)
    grams = F.slice("w", F.lit(1), F.greatest(n, F.lit(0)))
    for i in range(1, width):
        grams = F.zip_with(grams, F.slice("w", F.lit(i + 1), F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    df = let(df, h=grams)
    bits = F.length(F.bin(F.size("h").cast("bigint")))
    df = let(df, bits=bits)
    mask = F.expr("(shiftleft(1L, bits) - 1L)")
    packed = F.transform("h", lambda x, i: F.bitwise_not(mask).bitwiseAND(x).bitwiseOR(i.cast("bigint")))
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    df = let(df, p=F.when(repeated, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))
    at = lambda x: x.bitwiseAND(mask).cast("int")
    short = F.greatest(F.size("p") - 1, F.lit(0))
    same = F.zip_with(F.slice("p", F.lit(1), short), F.slice("p", F.lit(2), short), lambda a, b: F.when((a.bitwiseXOR(b) <= mask) & (a.bitwiseXOR(b) >= 0) & (F.get("h", at(a)) == F.get("h", at(b))), F.array(at(a), at(b))))
    df = let(df, r=F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    gaps = F.zip_with(F.slice("r", F.lit(1), F.greatest(F.size("r") - 1, F.lit(0))), F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(width)))
    total = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, x: s + x) + F.lit(width)
    return df.withColumn("n_repeat_words", F.when(F.size("r") > 0, total).otherwise(F.lit(0)).cast("bigint"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words (all long)."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    df = let(df, w=words(F.col("t")), lines=F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    stop = [x for w in STOP_WORDS for x in (w, w.capitalize())]
    df = df.select(
        "doc_id",
        "w",
        F.size("w").cast("bigint").alias("n_words"),
        (F.length("t") - F.regexp_count("t", F.lit(SPACE))).cast("bigint").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: x.isin(stop))).cast("bigint").alias("n_stop_words"),
    )
    return _repeated_words(df, 3)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table of thresholds as one expression."""

    def one(r: Rule) -> Column:
        stat, base = 100 * F.col(r.stat), F.col(r.base)
        return reduce(Column.__and__, [c for c in (stat >= r.low * base if r.low is not None else None, stat <= r.high * base if r.high is not None else None) if c is not None])

    return reduce(Column.__and__, map(one, rules))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the statistics, base_failed and kept. Base: under 50 words, or over half of them repeated."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = statistics(docs, id_col, text_col).withColumn("base_failed", failed)
    return df.withColumn("kept", ~F.col("base_failed") & verdict(rules)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")


def verdict_sql(rules: tuple[Rule, ...] = RULES) -> str:
    return " and ".join(f"100 * {r.stat} {op} {bound} * {r.base}" for r in rules for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None)


_STOP_SQL = ", ".join("'" + x + "'" for w in STOP_WORDS for x in dict.fromkeys((w, w.capitalize())))
SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
s as (select doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) as x, unnest(range(1, len(w) - 1)) as i from s where len(w) > 2),
f as (select doc_id, i, count(*) over (partition by doc_id, x) as n from g),
p as (select distinct doc_id, i + o as i from f, (values (0), (1), (2)) as v(o) where n > 1),
c as (select doc_id, count(*) as n_repeat_words from p group by doc_id),
a as (select s.doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines,
  len(list_filter(w, lambda x: x in ({_STOP_SQL}))) as n_stop_words, coalesce(n_repeat_words, 0) as n_repeat_words from s left join c using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {verdict_sql()} as kept, n_lines, n_stop_words from b
"""
