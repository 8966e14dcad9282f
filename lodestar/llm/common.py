"""What the operators share: the word rule, column barriers and tables cut off from their lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.scratch import Scratch, delete, shared_folder  # noqa: F401

#: Words are runs of anything but ASCII white space; Java and Python regexes read these alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once.

    A projection could be merged into the next one, which would compute an array again for every element that a
    lambda looks up in it. Spark does not merge through a generator.
    """
    for name, column in columns.items():
        df = df.withColumn(name, F.explode(F.array(F.struct(column.alias("v"))))).withColumn(name, F.col(name)["v"])
    return df


def words(text: Column) -> Column:
    """Array of the words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def stored(df: DataFrame) -> DataFrame:
    """One table written to the shared folder and read again."""
    return Scratch(df.sparkSession)(df)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no operator learns from; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


#: Bytes of a batch that an operator's function is given at once; only a single row may be larger.
PIECE = 4_000_000


def pieces(batch):
    """The batch in runs of rows of at most PIECE bytes, so that what is made of long texts needs little memory at once."""
    if batch.num_rows < 2 or batch.nbytes <= PIECE:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half))
        yield from pieces(batch.slice(half))


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """Applies fn (a RecordBatch to a dict of columns) to every piece of every batch; the dict's columns come out in the schema's order."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in (piece for whole in batches for piece in pieces(whole)):
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c := out[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def texts_of(batch, column: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def struct(fields: str):
    """'a long, b string' as a StructType."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(fields)
