"""Saving an index and reading it again: one Parquet table each for lists, cells and what describes them."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.codecs import Product
from lodestar.operators.routing import Cells
from lodestar.operators.space import Space

VERSION = 1


@dataclass
class Index:
    lists: DataFrame
    cells: Cells
    space: Space
    codec: Product | None = None
    params: dict | None = None


def save(index: Index, path: str) -> None:
    """Lists are written in order of cell, so that a scan of some cells skips row groups."""
    spark = index.lists.sparkSession
    index.lists.repartitionByRange("cell").sortWithinPartitions("cell", "vec_id").write.mode("overwrite").parquet(f"{path}/lists")
    levels = [(n, i, int(up[i]) if len(up) else -1, c[i].tolist()) for n, c in enumerate(index.cells.levels) for up in [index.cells.parents[n] if n < len(index.cells.parents) else []] for i in range(len(c))]
    spark.createDataFrame(levels, "level int, cell int, parent int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    book = None if index.codec is None else {"book": index.codec.book.tolist(), "eta": index.codec.eta}
    meta = {"n": index.space.n, "mean": index.space.mean.tolist(), "top": index.space.top, "codec": book, "params": index.params or {}}
    spark.createDataFrame([(VERSION, json.dumps(meta))], "version int, meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Index:
    row = spark.read.parquet(f"{path}/meta").first()
    if row.version != VERSION:
        raise ValueError(f"{path} has version {row.version}, not {VERSION}")
    meta = json.loads(row.meta)
    got = spark.read.parquet(f"{path}/cells").orderBy("level", "cell").collect()
    levels, parents = [], []
    for n in sorted({r.level for r in got}):
        levels.append(np.array([r.centroid for r in got if r.level == n]))
        parents.append(np.array([r.parent for r in got if r.level == n]))
    codec = meta["codec"] and Product(np.array(meta["codec"]["book"]), meta["codec"]["eta"])
    return Index(spark.read.parquet(f"{path}/lists"), Cells(levels, parents if len(levels) > 1 else []), Space(meta["n"], np.array(meta["mean"]), meta["top"]), codec, meta["params"])


def probed(index: Index, cells: list[int]) -> DataFrame:
    """The lists of some cells; the filter reaches the files."""
    return index.lists.where(F.col("cell").isin(cells))
