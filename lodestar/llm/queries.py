"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from lodestar.llm import bpe, chat, hnsw, language, license, minhash, mixing, quality_model, quality_rules, secrets
from lodestar.llm.common import read


def op4_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op1_quality_classifier(spark, sf_dir):
    return quality_model.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op7_hnsw(spark, sf_dir):
    return hnsw.search(read(spark, sf_dir, "embeddings"))


def op3_license_scan(spark, sf_dir):
    return license.scan(read(spark, sf_dir, "documents"))


def op9_chat_formatting(spark, sf_dir):
    return chat.format_chat(read(spark, sf_dir, "conversations"))


def op2_minhash(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_secrets(spark, sf_dir):
    return secrets.digest(read(spark, sf_dir, "documents"))


def op10_bpe(spark, sf_dir):
    return bpe.digest(read(spark, sf_dir, "documents"))


QUERIES = {"op3_license_scan": op3_license_scan, "op9_chat_formatting": op9_chat_formatting, "op7_hnsw": op7_hnsw, "op1_quality_classifier": op1_quality_classifier, "op6_language": op6_language, "op2_minhash": op2_minhash, "op5_secrets": op5_secrets, "op10_bpe": op10_bpe, "op4_quality_rules": op4_quality_rules, "op8_mixing": op8_mixing}
ORACLES = {"op4_quality_rules": quality_rules.SQL, "op8_mixing": mixing.SQL}
