"""Tables written to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors of a cluster share; one is set only where there is none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/lodestar-checkpoints")
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


class Scratch:
    """Writes tables to the shared folder and reads them again, which survives lost executors and ends the lineage."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{shared_folder(self.spark)}/lodestar-{uuid.uuid4().hex}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def delete_first(self) -> None:
        """For a caller that reads the oldest table no more."""
        delete(self.spark, self.paths.pop(0))

    def delete_all_but_last(self) -> None:
        """For a caller whose result reads nothing but the last table."""
        for path in self.paths[:-1]:
            delete(self.spark, path)
        del self.paths[:-1]


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
