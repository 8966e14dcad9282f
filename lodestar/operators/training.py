"""Fitting centroids, codebooks, rotations and projections.

Loops run on the driver over models of bounded size. The rows stay distributed: each step is one pass in which every partition
sends one row of partial sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.arrow import matrix
from lodestar.operators.codecs import Product
from lodestar.operators.routing import Cells, l2, pivots


def summed(rows: DataFrame, column: str, fn) -> np.ndarray:
    """The sum over all batches of what fn makes of a batch's matrix, an array of one shape."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = fn(matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": [total.ravel().tolist()], "shape": [list(total.shape)]}, schema=pa.schema([("v", pa.list_(pa.float64())), ("shape", pa.list_(pa.int64()))]))

    parts = rows.select(column).mapInArrow(run, "v array<double>, shape array<long>")
    got = parts.select("shape", F.posexplode("v").alias("i", "v")).groupBy("i", "shape").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r.v for r in got]).reshape(got[0].shape) if got else np.zeros(0)


def lloyd_sums(c: np.ndarray):
    """For each centroid: the sum of its rows, their number and their squared distances."""

    def fn(x):
        s = l2(x, c)
        near = s.argmin(1)
        out = np.zeros((len(c), x.shape[1] + 2))
        np.add.at(out, near, np.hstack([x, np.ones((len(x), 1)), s.min(1, keepdims=True)]))
        return out

    return fn


def lloyd_step(rows: DataFrame, c: np.ndarray, column: str = "nx") -> tuple[np.ndarray, np.ndarray, float]:
    """(centroids, counts, inertia before the step); an empty centroid stays where it is."""
    got = summed(rows, column, lloyd_sums(c))
    n = got[:, -2]
    return np.where(n[:, None] > 0, got[:, :-2] / np.maximum(n, 1)[:, None], c), n.astype(int), float(got[:, -1].sum())


def k_means(rows: DataFrame, k: int, steps: int = 15, column: str = "nx") -> tuple[np.ndarray, list[float]]:
    """Centroids and the inertia before each step, from k rows of least id hash."""
    c, inertia = pivots(rows, k, column), []
    for _ in range(steps):
        c, _, now = lloyd_step(rows, c, column)
        inertia.append(now)
    return c, inertia


def tree(rows: DataFrame, counts: list[int], steps: int = 8, column: str = "nx") -> Cells:
    """A hierarchy of uniform fan-out: the coarse level by k-means, then k-means of each parent's rows, all parents at once."""
    levels, parents = [k_means(rows, counts[0], steps, column)[0]], [np.empty(0, int)]
    for above, below in zip(counts, counts[1:], strict=False):
        fan = max(1, below // above)
        coarse = levels[-1]
        r = np.random.default_rng(len(levels))
        start = np.repeat(coarse, fan, 0)
        start = start + r.normal(size=start.shape)
        parent = np.repeat(np.arange(len(coarse)), fan)
        chain = [*levels, start]
        ups = [*parents, parent]
        for _ in range(steps):
            chain[-1] = _tree_means(rows, Cells(chain, ups), column)[-1]
        levels, parents = chain, ups
    return Cells([np.round(c) for c in levels], parents)


def _leaf_of(x: np.ndarray, cells: Cells) -> np.ndarray:
    """The leaf that greedy descent reaches."""
    at = l2(x, cells.levels[0]).argmin(1)
    for c, up in zip(cells.levels[1:], cells.parents[1:], strict=True):
        at = np.where(up[None] == at[:, None], l2(x, c), np.inf).argmin(1)
    return at


def _tree_means(rows: DataFrame, cells: Cells, column: str) -> list[np.ndarray]:
    n_leaves = len(cells.finest)

    def fn(x):
        out = np.zeros((n_leaves, x.shape[1] + 1))
        np.add.at(out, _leaf_of(x, cells), np.hstack([x, np.ones((len(x), 1))]))
        return out

    got, out = summed(rows, column, fn), []
    for level in range(len(cells.levels) - 1, -1, -1):
        n = got[:, -1:]
        out.append(np.where(n > 0, got[:, :-1] / np.maximum(n, 1), cells.levels[level]))
        if level:
            above = np.zeros((len(cells.levels[level - 1]), got.shape[1]))
            np.add.at(above, cells.parents[level], got)
            got = above
    return out[::-1]


def tree_em(rows: DataFrame, cells: Cells, rounds: int = 2, column: str = "nx") -> Cells:
    """Every round: rows go to the leaf that descent reaches, then each level's centroids become the means of the rows below."""
    for _ in range(rounds):
        cells = Cells(_tree_means(rows, cells, column), cells.parents)
    return cells


def fixed_book(rows: DataFrame, sub: int, centroids: int = 16, column: str = "q") -> Product:
    """A codebook whose centroids are the parts of the rows of least id hash: what training starts from."""
    p = pivots(rows, centroids, column)
    return Product(p.reshape(len(p), -1, sub).transpose(1, 0, 2).copy())


def train_product(rows: DataFrame, sub: int, centroids: int = 16, steps: int = 6, eta: float = 1.0, column: str = "q", rotation: np.ndarray | None = None) -> Product:
    """k-means in all sub-spaces at once. With eta > 1 errors along the vector count eta times: c = (sum A)^-1 sum A x with A = I + (eta - 1) v v'."""
    turn = (lambda x: x) if rotation is None else (lambda x: x @ rotation.T)
    p = turn(pivots(rows, centroids, column))
    book = p.reshape(len(p), -1, sub).transpose(1, 0, 2).copy()
    for _ in range(steps):
        codec = Product(book, eta)
        m, c, d = book.shape

        def fn(x):
            x = turn(x)
            part, code = codec.parts(x), codec.encode(x).astype(int)
            v = codec.parts(x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9))
            a = np.eye(d) + (eta - 1) * v[:, :, :, None] * v[:, :, None, :]
            ax = np.einsum("nmij,nmj->nmi", a, part)
            out = np.zeros((m * c, d * d + d))
            np.add.at(out, (code + c * np.arange(m)).ravel(), np.concatenate([a.reshape(len(x) * m, -1), ax.reshape(len(x) * m, -1)], 1))
            return out

        got = summed(rows, column, fn)
        a, ax = got[:, : d * d].reshape(-1, d, d), got[:, d * d :]
        full = a[:, 0, 0] > 0
        book = book.reshape(-1, d).copy()
        book[full] = np.linalg.solve(a[full], ax[full][:, :, None])[:, :, 0]
        book = book.reshape(m, c, d)
    return Product(book, eta)


def train_rotation(rows: DataFrame, sub: int, rounds: int = 4, column: str = "q", eta: float = 1.0) -> tuple[np.ndarray, Product]:
    """Rotation and codebook in turn; the rotation that best maps vectors to their reconstructions solves a Procrustes problem."""
    d = len(rows.select(column).first()[0])
    rotation = np.eye(d)
    codec = train_product(rows, sub, column=column, rotation=rotation)
    for _ in range(rounds):
        turn, book = rotation, codec
        cross = summed(rows, column, lambda x: book.decode(book.encode(x @ turn.T)).T @ x)
        u, _, vt = np.linalg.svd(cross)
        rotation = u @ vt
        codec = train_product(rows, sub, column=column, rotation=rotation)
    return rotation, train_product(rows, sub, eta=eta, column=column, rotation=rotation) if eta != 1 else codec


def distortion(rows: DataFrame, codec: Product, column: str = "q", rotation: np.ndarray | None = None) -> float:
    """Mean squared error of the reconstructions."""

    def fn(x):
        x = x if rotation is None else x @ rotation.T
        return np.array([((x - codec.decode(codec.encode(x))) ** 2).sum(), len(x)])

    total, n = summed(rows, column, fn)
    return float(total / n)


def principal(rows: DataFrame, r: int, column: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """(mean, directions): the r leading eigenvectors of the covariance, one a column, the largest component of each positive."""
    def fn(x):
        y = np.hstack([x, np.ones((len(x), 1))])
        return y.T @ y

    got = summed(rows, column, fn)
    n = got[-1, -1]
    mean = got[-1, :-1] / n
    _, v = np.linalg.eigh(got[:-1, :-1] / n - np.outer(mean, mean))
    v = v[:, ::-1][:, :r]
    return mean, v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])


def landmarks(c: np.ndarray, k: int) -> list[int]:
    """Farthest points in turn, from the first centroid; ties to the lower one."""
    chosen = [0]
    near = ((c - c[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(c)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((c - c[chosen[-1]]) ** 2).sum(1))
    return chosen


def portals(lists: DataFrame, p: int = 4, steps: int = 3, column: str = "nx", part: int = 20_000) -> DataFrame:
    """(cell, vec_id, portal, portal_centroid): p spherical centroids within each cell and the bucket of each member.

    Farthest-first starts come from at most `part` members of a cell, those of least id hash; every member is then put into its
    bucket by the inner product with the int8 centroids. Empty buckets do not appear.
    """
    from pyspark.sql import Window

    from lodestar.functions.arrow import half_away, map_batches, rows_of

    h = F.md5(F.col("vec_id").cast("string").cast("binary"))
    sample = lists.withColumn("_n", F.row_number().over(Window.partitionBy("cell").orderBy(h, "vec_id"))).where(F.col("_n") <= part).select("cell", "_n", column)

    def fit(key, table):
        order = np.argsort(table.column("_n").to_numpy())
        x = matrix(table.column(column).combine_chunks())[order]
        x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
        chosen, near = [0], x @ x[0]
        while len(chosen) < min(p, len(x)):
            chosen.append(int(near.argmin()))
            near = np.maximum(near, x @ x[chosen[-1]])
        c = x[chosen]
        for _ in range(steps):
            own = (x @ c.T).argmax(1)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            norm = np.sqrt((sums * sums).sum(1, keepdims=True))
            c = np.where(norm > 0, sums / np.maximum(norm, 1e-9), c)
        return pa.Table.from_pydict({"cell": pa.array([key[0].as_py()], pa.int32()), "book": pa.array([half_away(c * 127).astype(np.int8).ravel()], pa.list_(pa.int8()))})

    books = sample.groupBy("cell").applyInArrow(fit, "cell int, book array<tinyint>")

    def put(batch):
        x, out, cents = matrix(batch.column(column)), [], []
        for v, book in zip(x, batch.column("book"), strict=True):
            c = book.values.to_numpy().astype(np.float64).reshape(-1, len(v))
            out.append(int((c @ v).argmax()))
            cents.append(c[out[-1]])
        return {"cell": batch.column("cell"), "vec_id": batch.column("vec_id"), "portal": out, "portal_centroid": rows_of(np.array(cents))}

    return map_batches(lists.select("cell", "vec_id", column).join(books, "cell"), put, "cell int, vec_id long, portal int, portal_centroid array<tinyint>")
