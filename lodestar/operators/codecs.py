"""Compressed forms of vectors: scalar codes, product codes, rotated and binary codes, and scores from codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.arrow import half_away, map_batches, matrix, rows_of


@dataclass(frozen=True)
class Scalar:
    """bits a component: n = round((x - lo) / step), clamped."""

    bits: int
    lo: np.ndarray
    step: np.ndarray

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.clip(half_away((x - self.lo) / self.step), 0, 2**self.bits - 1).astype(np.int8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return codes * self.step + self.lo

    def fold(self, q: np.ndarray) -> np.ndarray:
        """The query with the steps multiplied in; its product with codes orders rows as their reconstructions would."""
        return q * self.step


def fit_scalar(rows: DataFrame, bits: int, low: float, high: float, column: str = "q") -> Scalar:
    """Ranges from the interpolated percentiles of every component, over all rows: int8 values are counted, not sorted."""

    def count(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch.column(0), np.int64) + 128
                d = m.shape[1]
                c = np.bincount((m + 256 * np.arange(d)).ravel(), minlength=256 * d)
                total = c if total is None else total + c
        if total is not None:
            yield pa.RecordBatch.from_pydict({"c": [total.tolist()]}, schema=pa.schema([("c", pa.list_(pa.int64()))]))

    got = rows.select(column).mapInArrow(count, "c array<long>").select(F.posexplode("c").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c")).orderBy("i").collect()
    counts = np.array([r.c for r in got], np.int64).reshape(-1, 256).cumsum(1)
    lo, hi = percentile(counts, low), percentile(counts, high)
    return Scalar(bits, lo, np.maximum(hi - lo, 1) / (2**bits - 1))


def percentile(counts: np.ndarray, p: float) -> np.ndarray:
    """Interpolated percentile of int8 values from their cumulative counts, one row a component."""
    place = (counts[:, -1] - 1) * p
    at = lambda i: (counts <= i[:, None]).sum(1) - 128.0
    below = np.floor(place)
    a, b = at(below), at(np.ceil(place))
    return a + (b - a) * (place - below)


@dataclass(frozen=True)
class Product:
    """book: (sub-spaces, centroids, components of each). eta > 1 weighs the error along the vector more."""

    book: np.ndarray
    eta: float = 1.0

    def parts(self, x: np.ndarray) -> np.ndarray:
        m, _, d = self.book.shape
        if x.shape[1] != m * d:
            raise ValueError(f"vectors of {x.shape[1]} components, codebook of {m} x {d}")
        return x.reshape(len(x), m, d)

    def losses(self, x: np.ndarray) -> np.ndarray:
        p = self.parts(x)
        s = (p * p).sum(2)[:, :, None] + (self.book**2).sum(2)[None] - 2 * np.einsum("nmd,mcd->nmc", p, self.book)
        if self.eta != 1:
            v = self.parts(x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9))
            along = (p * v).sum(2)[:, :, None] - np.einsum("nmd,mcd->nmc", v, self.book)
            s = s + (self.eta - 1) * along**2
        return np.round(s, 6)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return self.losses(x).argmin(2).astype(np.int8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.book[np.arange(self.book.shape[0]), codes.astype(int)].reshape(len(codes), -1)

    def table(self, q: np.ndarray, metric: str) -> np.ndarray:
        """(queries, sub-spaces, centroids): what each code adds to a score."""
        p = self.parts(q)
        dots = np.einsum("nmd,mcd->nmc", p, self.book)
        if metric == "ip":
            return -dots
        return (p * p).sum(2)[:, :, None] + (self.book**2).sum(2)[None] - 2 * dots

    def nav_table(self, q: np.ndarray) -> np.ndarray:
        """Half squared norms minus products, rounded: orders rows by L2."""
        return half_away(0.5 * (self.book**2).sum(2)[None] - np.einsum("nmd,mcd->nmc", self.parts(q), self.book))


def adc(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Scores of rows of codes from rows of look-up tables."""
    return np.take_along_axis(table, codes.astype(int)[:, :, None], 2)[:, :, 0].sum(1)


def narrow(table: np.ndarray, bits: int) -> np.ndarray:
    """Look-up tables as whole numbers of so many bits: each sub-space from 0, one scale for a query. Changes no order but by rounding."""
    shifted = table - table.min(2, keepdims=True)
    scale = (2 ** (bits - 1) - 1) / np.maximum(shifted.max((1, 2), keepdims=True), 1e-9)
    return half_away(shifted * scale)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte, the first in the low half."""
    c = codes.astype(np.uint8)
    return c[:, ::2] | (c[:, 1::2] << 4)


def unpack(data: np.ndarray) -> np.ndarray:
    out = np.empty((len(data), 2 * data.shape[1]), np.int8)
    out[:, ::2], out[:, 1::2] = data & 15, data >> 4
    return out


@dataclass(frozen=True)
class Reflection:
    """An orthogonal map, x - 2 v (v x) / |v|^2: a rotation of codes' spaces that costs one product."""

    v: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x - 2 * np.outer(x @ self.v, self.v) / (self.v @ self.v)


def random_rotation(d: int, seed: int = 0) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


@dataclass(frozen=True)
class Binary:
    """Unit residuals, rotated, in uniform levels of `bits` bits, with two numbers that make scores of them."""

    rotation: np.ndarray
    bits: int = 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """levels (int8), |x|^2 and |x| / <u, o>; zero vectors have zeros."""
        d, norm = x.shape[1], np.sqrt((x * x).sum(1))
        o = (x / np.maximum(norm, 1e-9)[:, None]) @ self.rotation.T
        u = self.levels(o)
        along = (self.values(u, d) * o).sum(1)
        return u, norm * norm, np.where(norm > 0, norm / np.where(along == 0, 1, along), 0.0)

    def levels(self, o: np.ndarray) -> np.ndarray:
        if self.bits == 1:
            return (o >= 0).astype(np.int8)
        top = 3 / np.sqrt(o.shape[1])
        return np.clip(np.floor((o + top) / (2 * top) * 2**self.bits), 0, 2**self.bits - 1).astype(np.int8)

    def values(self, u: np.ndarray, d: int) -> np.ndarray:
        if self.bits == 1:
            return (2.0 * u - 1) / np.sqrt(d)
        return ((u + 0.5) / 2**self.bits * 2 - 1) * 3 / np.sqrt(d)

    def score(self, q: np.ndarray, u: np.ndarray, cadd: np.ndarray, cmul: np.ndarray, metric: str) -> np.ndarray:
        s = (self.values(u, q.shape[1]) * (q @ self.rotation.T)).sum(1)
        return -cmul * s if metric == "ip" else cadd - 2 * cmul * s


def encoded(rows: DataFrame, codec, column: str = "q", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The kept columns and `code`, an array of small numbers."""
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batch):
        return {c: batch.column(c) for c in keep} | {"code": rows_of(codec.encode(matrix(batch.column(column))))}

    return map_batches(rows.select(*keep, column), run, f"{ddl}, code array<tinyint>")


def code_scores(pool: DataFrame, queries: DataFrame, codec: Product, metric: str, column: str = "q") -> DataFrame:
    """(qid, vec_id, score) of a pool that carries codes."""

    def run(batch):
        table = codec.table(matrix(batch.column("_query")), metric)
        return {"qid": batch.column("qid"), "vec_id": batch.column("vec_id"), "score": adc(table, matrix(batch.column("code"), np.int64))}

    both = pool.select("qid", "vec_id", "code").join(queries.select("qid", F.col(column).alias("_query")), "qid")
    return map_batches(both, run, "qid long, vec_id long, score double")
