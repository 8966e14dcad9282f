"""From raw documents to token ids in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from lodestar.llm import corpus_stages as stages
from lodestar.llm.common import read, shared_folder

STAGES = [
    ("quality classifier", stages.good_quality),
    ("MinHash near-dedup", stages.without_near_copies),
    ("secret scans", stages.without_secrets),
    ("mixing sources to target weights", stages.mixed),
    ("BPE encoding and decoding", stages.tokens),
]
#: The classifier and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
