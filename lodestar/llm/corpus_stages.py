"""Pipeline stages: each operator's decisions as a step from documents to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import bpe, minhash, mixing, quality_model, secrets
from lodestar.llm.common import read


def good_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts."""
    model = quality_model.train(docs, read(spark, sf_dir, "labels"))
    name = "_score" + "_" * max(map(len, docs.columns))  # longer than any name in use
    scored = quality_model.score(docs, model, into=name)
    return scored.where(F.col(name) >= quality_model.THRESHOLD).drop(name)


def without_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word near-copies at 0.8, and every document without words."""
    found = minhash.judged(docs, width=5, percent=80)
    kept = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (minhash.digest(F.col("text")) == F.col("_digest"))
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])


def without_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars renewed."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.copied(docs)


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenise(docs.select("doc_id", "source", "text"), remembered=100_000).select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")
