"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a lookup table over quantile bins. Shallow trees are boosted cyclically, one feature at a time at a low
rate, so that each table grows without favouring any; then the strongest pairs of features get two-way tables on a coarser
grid in the same way. A score is the logistic of a sum of table entries, added up for whole batches.

The model is fitted on at most `sample` labelled rows, those of lowest id hash among all labelled rows that are not held
out; it is as large as its tables. Null and empty texts get the features of an empty text and so a score. Documents whose
id is null are held out. Without any labels every score is 0.5. Repeated rows score alike; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.llm.common import held_out, map_arrow, struct, texts_of

SAMPLE, BINS, GRID, ROUNDS, RATE, LEAVES, PAIRS = 5_000, 64, 8, 120, 0.08, 3, 12
THRESHOLD = 0.3
_SYMBOL = re.compile(r"[#*$%&|<>{}\[\]\\^~=_@]")
_STRONG = re.compile(r"[!?]")
_STOP = re.compile(r"[.,;:]")
_DIGIT = re.compile(r"[0-9]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LINK = re.compile(r"https?://|www\.")
FEATURES = ("log_chars", "log_words", "word_length", "symbols", "strong_marks", "stops", "digits", "upper", "line_length", "repeated_lines", "distinct_words", "top_word", "repeated_pairs", "compression", "links", "short_words")


def features(texts: list[str]) -> np.ndarray:
    """One row of FEATURES per whole text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, t in enumerate(texts):
        words = t.split()
        n, m = len(t), len(words)
        if not m:
            continue
        lines = [x for x in t.split("\n") if x.strip()]
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        data = t.encode("utf-8", "surrogatepass")
        out[i] = (
            np.log1p(n), np.log1p(m), sum(map(len, words)) / m, len(_SYMBOL.findall(t)) / m, len(_STRONG.findall(t)) / m, len(_STOP.findall(t)) / m,
            len(_DIGIT.findall(t)) / n, len(_UPPER.findall(t)) / n, np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), len(counts) / m, max(counts.values()) / m,
            1 - len(set(zip(words, words[1:]))) / max(m - 1, 1), len(zlib.compress(data, 1)) / len(data), len(_LINK.findall(t)) / m, sum(c for w, c in counts.items() if len(w) < 4) / m,
        )
    return out


@dataclass
class Model:
    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        total = np.full(len(x), self.start)
        for b, table in zip(bins, self.tables, strict=True):
            total += table[b]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[_coarse(bins[i], self.edges[i]), _coarse(bins[j], self.edges[j])]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _coarse(b: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return b * GRID // (len(edges) + 1)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Newton steps of a tree with few leaves over ordered bins, from sums of gradients and weights per bin."""
    cuts = [0, len(g)]
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1.0)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            if len(cg):
                v = cg**2 / (ch + 1.0) + (g[a:b].sum() - cg) ** 2 / (h[a:b].sum() - ch + 1.0) - gain(a, b)
                k = int(np.argmax(v))
                best = max(best, (float(v[k]), a + k + 1), key=lambda z: z[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of four leaves: the best cut of one axis, then each side's best cut of the other; both orders are tried."""
    best, out = -1.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(gg)):
            value, trial = 0.0, np.zeros_like(gg)
            for part in (slice(0, cut), slice(cut, None)):
                cg, ch = np.cumsum(gg[part].sum(0)), np.cumsum(hh[part].sum(0))
                v = cg[:-1] ** 2 / (ch[:-1] + 1.0) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1.0)
                k = int(np.argmax(v))
                value += float(v[k])
                trial[part, : k + 1], trial[part, k + 1 :] = cg[k] / (ch[k] + 1.0), (cg[-1] - cg[k]) / (ch[-1] - ch[k] + 1.0)
            if value > best:
                best, out = value, trial.T if flip else trial
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, n_pairs: int = PAIRS) -> Model:
    if not len(y):
        return Model(0.0, [np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [], [])
    p = np.clip(y.mean(), 0.01, 0.99)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model = Model(float(np.log(p / (1 - p))), edges, [np.zeros(len(e) + 1) for e in edges], [], [])
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    raw = np.full(len(y), model.start)

    def slopes():
        q = 1 / (1 + np.exp(-raw))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for b, table in zip(bins, model.tables, strict=True):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)), LEAVES)
            table += step
            raw += step[b]
    cells = {(i, j): _coarse(bins[i], edges[i]) * GRID + _coarse(bins[j], edges[j]) for i, j in combinations(range(x.shape[1]), 2)}
    g, h = slopes()
    strength = {k: float((np.bincount(c, g, GRID * GRID) ** 2 / (np.bincount(c, h, GRID * GRID) + 1.0)).sum()) for k, c in cells.items()}
    model.pairs = sorted(strength, key=lambda k: (-strength[k], k))[:n_pairs]
    model.grids = [np.zeros((GRID, GRID)) for _ in model.pairs]
    for _ in range(rounds // 4):
        for k, grid in zip(model.pairs, model.grids, strict=True):
            g, h = slopes()
            step = RATE * _grid_tree(np.bincount(cells[k], g, GRID * GRID).reshape(GRID, GRID), np.bincount(cells[k], h, GRID * GRID).reshape(GRID, GRID))
            grid += step
            raw += step.reshape(-1)[cells[k]]
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of at most `sample` labelled rows that are not held out; a document with several labels has their majority."""
    marked = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(sample)  # bounded by `sample`, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    measured = map_arrow(rows, lambda b: {"id": b.column("id"), "y": b.column("y"), "x": list(features(texts_of(b)))}, struct("id long, y int, x array<double>"))
    got = measured.orderBy(F.xxhash64("id"), "id", "x").limit(sample).collect()
    return fit(np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([r.y for r in got], float))


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """Adds the score, in place of a column of its name."""
    docs = docs.drop(into)
    model = docs.sparkSession.sparkContext.broadcast(model)
    return map_arrow(docs, lambda b: {c: b.column(c) for c in b.schema.names} | {into: model.value.score(features(texts_of(b, text_col)))}, StructType(docs.schema.fields + struct(f"{into} double").fields))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
