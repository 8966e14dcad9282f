"""Dense binary files as a Spark source.

`spark.read.format("vectors")` reads a header of two unsigned 32-bit integers, the rows and the length of each, then the rows
themselves, little-endian: options `type` int8, float32 or uint32, `dataOffset` where the rows begin (8), `start` and `count`
for a part of the file, whose ids then begin at 0, `limit` for the first rows, `header` false with `n` rows for a file of rows
only, whose row length follows from its size. Every partition reads its own range of bytes. Paths may be of any store that
pyarrow knows (file, hdfs, s3). A folder is read file by file in order of name; a name that is a number is the id of the first row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestar.functions.arrow import matrix

TYPES = {"int8": ("<i1", "array<tinyint>", pa.int8()), "float32": ("<f4", "array<float>", pa.float32()), "uint32": ("<u4", "array<bigint>", pa.int64())}
#: Bytes that one task reads.
PART = 64 << 20


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Part(InputPartition):
    def __init__(self, path: str, at: int, rows: int, d: int, first: int) -> None:
        self.path, self.at, self.rows, self.d, self.first = path, at, rows, d, first


class Vectors(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return f"vec_id long, x {TYPES[self.options.get('type', 'float32')][1]}"

    def reader(self, schema) -> Reader:
        return Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = dict(options)
        self.kind, _, self.arrow = TYPES[self.options.get("type", "float32")]

    def _layout(self, path: str) -> tuple[int, int, int]:
        """(rows, length of a row, where the rows begin); an error where the size does not agree."""
        store, name = _open(path)
        size, item = store.get_file_info(name).size, np.dtype(self.kind).itemsize
        if self.options.get("header", "true") == "false":
            n = int(self.options["n"])
            if n <= 0 or size % (n * item):
                raise ValueError(f"{path}: {size} bytes are not {n} rows")
            return n, size // (n * item), 0
        with store.open_input_file(name) as f:
            n, d = np.frombuffer(f.read_at(8, 0), "<u4").tolist()
        at = int(self.options.get("dataoffset", self.options.get("dataOffset", 8)))
        if size < at + n * d * item or d == 0:
            raise ValueError(f"{path}: {size} bytes do not hold {n} rows of {d} from byte {at}")
        return n, d, at

    def partitions(self) -> list[Part]:
        path = self.options["path"]
        store, name = _open(path)
        files, out, item, first = [path], [], np.dtype(self.kind).itemsize, 0
        if store.get_file_info(name).type == fs.FileType.Directory:
            found = store.get_file_info(fs.FileSelector(name))
            files = sorted(path.rstrip("/") + "/" + x.base_name for x in found if x.type == fs.FileType.File and x.base_name[0] not in "._")
        for p in files:
            n, d, at = self._layout(p)
            start = int(self.options.get("start", 0))
            n = min(n - start, int(self.options.get("count", n)), int(self.options.get("limit", n)))
            stem = p.rsplit("/", 1)[-1].split(".")[0]
            first = int(stem) if len(files) > 1 and stem.isdigit() else first
            step = max(1, PART // (d * item))
            out += [Part(p, at + (start + i) * d * item, min(step, n - i), d, first + i) for i in range(0, n, step)]
            first += max(n, 0)
        return out or [Part("", 0, 0, 1, 0)]

    def read(self, part: Part):
        if part.rows:
            store, name = _open(part.path)
            with store.open_input_file(name) as f:
                m = np.frombuffer(f.read_at(part.rows * part.d * np.dtype(self.kind).itemsize, part.at), self.kind)
            for i in range(0, part.rows, 8192):
                k = min(8192, part.rows - i)
                items = pa.array(m[i * part.d : (i + k) * part.d]).cast(self.arrow)
                lists = pa.ListArray.from_arrays(np.arange(0, (k + 1) * part.d, part.d, dtype=np.int32), items)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first + i, part.first + i + k)), lists], names=["vec_id", "x"])


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(Vectors)
    return spark.read.format("vectors").options(**options).load(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, vec_id): the ids of each query's nearest rows; the largest unsigned number stands for none."""
    rows = read(spark, path, type="uint32").select(F.col("vec_id").alias("qid"), F.posexplode("x").alias("pos", "vec_id"))
    return rows.where(F.col("vec_id") < 2**32 - 1).select("qid", (F.col("pos") + 1).alias("rank"), "vec_id")


def read_graph(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(src, pos, dst) of a file without a header."""
    rows = read(spark, path, type="uint32", header="false", n=n).select(F.col("vec_id").alias("src"), F.posexplode("x").alias("pos", "dst"))
    return rows.where(F.col("dst") < 2**32 - 1).select("src", (F.col("pos") + 1).alias("pos"), "dst")


def write(rows: DataFrame, path: str, kind: str = "float32", column: str = "x", parts: int = 8) -> None:
    """A folder of such files, each a run of ids without a gap, named by its first id. A task that is run again replaces its file."""
    item = TYPES[kind][0]

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            ids = np.concatenate([np.asarray(b.column("vec_id")) for b in got])
            m = np.concatenate([matrix(b.column(column), np.dtype(item)) for b in got])
            cuts = np.nonzero(np.diff(ids) != 1)[0] + 1
            store, folder = _open(path)
            store.create_dir(folder, recursive=True)
            for part, own in zip(np.split(m, cuts), np.split(ids, cuts), strict=True):
                with store.open_output_stream(f"{folder}/{own[0]:020d}.bin") as f:
                    f.write(np.array(part.shape, "<u4").tobytes() + np.ascontiguousarray(part, item).tobytes())
        yield pa.RecordBatch.from_pydict({"n": [sum(b.num_rows for b in got)]})

    rows.select("vec_id", column).repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_ranked(found: DataFrame, path: str, k: int = 10, parts: int = 8) -> None:
    """Results (qid, rank, vec_id) as a file of k ids a query, filled up with the largest unsigned number."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda s: s["vec_id"])
    wide = found.where(F.col("rank") <= k).groupBy("qid").agg(ids.alias("x"))
    full = F.slice(F.concat("x", F.array_repeat(F.lit(2**32 - 1).cast("long"), k)), 1, k)
    write(wide.select(F.col("qid").alias("vec_id"), full.alias("x")), path, "uint32", parts=parts)
