"""A mutable index: inserts and deletes in order, searched together with what was built first.

A log has (seq, op, vec_id, x): op 'I' inserts and 'D' deletes. Of the entries of an id the last one by seq counts, so an
insert of a known id replaces it and a delete of an unknown one does nothing. The router, the mean and the scale stay those
that the index was built with. A log is applied batch by batch, each batch being a folder of its own, so a batch that is
applied again after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import ivf, routing
from lodestar.operators.exact import top_k
from lodestar.operators.routing import Cells
from lodestar.operators.space import Space, coded, usable

LOG = "seq long, op string, vec_id long, x array<float>"


def live(main: DataFrame, log: DataFrame) -> DataFrame:
    """(vec_id, x): rows whose last entry is an insert; rows of `main` come before all entries."""
    entries = main.select(F.lit(-1).cast("long").alias("seq"), F.lit("I").alias("op"), "vec_id", "x").unionByName(log.select("seq", "op", "vec_id", "x"))
    last = entries.groupBy("vec_id").agg(F.max_by(F.struct("op", "x"), "seq").alias("e"))
    return last.where("e.op = 'I'").select("vec_id", "e.x")


def effective_deletes(main: DataFrame, log: DataFrame) -> DataFrame:
    """(vec_id, known) of ids deleted at last: whether the id was ever there."""
    last = log.groupBy("vec_id").agg(F.max_by("op", "seq").alias("op"), F.max(F.col("op") == "I").alias("inserted")).where("op = 'D'")
    return last.join(main.select("vec_id", F.lit(True).alias("there")), "vec_id", "left").select("vec_id", (F.coalesce("there", F.lit(False)) | F.col("inserted")).alias("known"))


class LiveIndex:
    """Folders main, log/batch=.. under a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, space: Space, cells: Cells, copies: int = 2) -> None:
        self.spark, self.path, self.space, self.cells, self.copies = spark, path.rstrip("/"), space, cells, copies
        self.size = len(space.mean)

    def build(self, rows: DataFrame) -> None:
        usable(rows, "x", self.size).select("vec_id", "x").write.mode("overwrite").parquet(f"{self.path}/main")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch. Inserts without a usable vector are left out."""
        deletes = batch.where("op = 'D'").select("seq", "op", "vec_id", F.lit(None).cast("array<float>").alias("x"))
        inserts = usable(batch.where("op = 'I'"), "x", self.size).select("seq", "op", "vec_id", "x")
        inserts.unionByName(deletes).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch_id}")

    def log(self) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log").select("seq", "op", "vec_id", "x")

    def main(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/main")

    def rows(self) -> DataFrame:
        return live(self.main(), self.log())

    def search(self, queries: DataFrame, p: int, k: int = 10, metric: str = "l2") -> DataFrame:
        """queries: (qid, x)."""
        return search(self.rows(), queries, self.space, self.cells, self.copies, p, k, metric)

    def compact(self, into: str) -> LiveIndex:
        """The live rows as the main folder of a new index."""
        out = LiveIndex(self.spark, into, self.space, self.cells, self.copies)
        out.build(self.rows())
        return out


def search(rows: DataFrame, queries: DataFrame, space: Space, cells: Cells, copies: int, p: int, k: int = 10, metric: str = "l2") -> DataFrame:
    """Live rows, routed by the frozen cells, scanned in the p nearest ones."""
    index = coded(rows, space)
    asked = coded(queries, space, "qid", "qid long")
    lists = ivf.build(routing.flat(index, cells, copies), index.select("vec_id", "x"))
    probes = routing.flat(asked, cells, p, "qid")
    return top_k(ivf.dedup(ivf.scanned(ivf.gather(probes, lists), asked, "x", metric, "double")), k).select("qid", "rank", "vec_id", "score")
