"""Language identification by words first, character n-grams second.

A word that training has seen adds its log frequency in each language. An unseen word falls back to its character
n-grams, from the longest length down, until some of them are known. Tables come from at most `sample` labelled
documents of each language, those of lowest id hash among all that are not held out, counted in full on the executors.

What was seen once says little: such words and n-grams are left out of the tables, but for languages of few documents. A
document counts once, however often its row is repeated, so the tables are bounded by the sample's texts.

Texts that are null or have no letter are `und` with score 0, as is everything where nothing could be learned. The score
is the softmax of the mean evidence per word, sharpened by the square root of their number. Ties go to the smaller name. Repeated
rows are judged alike; rows with null lang teach nothing; documents with null ids are held out. Texts of any length are read
whole, in memory that grows with their words; no rows give none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import held_out, map_arrow, struct, texts_of

SAMPLE, LONGEST, REMEMBERED = 2_000, 4, 300_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased; digits, fractions and number signs are none."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Languages:
    def __init__(self, counts: dict[tuple[str, int, str], int]) -> None:
        """counts: (language, 0 for words or the n-gram length, string) to occurrences."""
        self.names = sorted({k[0] for k in counts})
        at = {x: i for i, x in enumerate(self.names)}
        self.rows: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        for _, n, s in counts:
            self.rows[n].setdefault(s, len(self.rows[n]))
        self.logs = [np.zeros((len(r), len(at))) for r in self.rows]
        for (lang, n, s), c in counts.items():
            self.logs[n][self.rows[n][s], at[lang]] += c
        self.logs = [np.log((m + 0.1) / (m.sum(0) + 0.1 * (len(m) + 1))).astype(np.float32) for m in self.logs]
        self.known: dict[str, int] = {}
        self.matrix = np.zeros((1024, len(at)))

    def evidence(self, word: str) -> np.ndarray:
        row = self.rows[0].get(word)
        if row is not None:
            return self.logs[0][row]
        for n in range(LONGEST, 0, -1):
            rows = [self.rows[n][g] for g in grams(word, n) if g in self.rows[n]]
            if rows:
                return self.logs[n][rows].mean(0)
        return np.zeros(len(self.names))

    def predict(self, text: str) -> tuple[str, float]:
        counted = Counter(words(text)) if self.names else None
        if not counted:
            return "und", 0.0
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in counted:
            if w not in known:
                if len(known) == len(self.matrix):
                    self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
                self.matrix[len(known)] = self.evidence(w)
                known[w] = len(known)
        times = np.fromiter(counted.values(), np.float64, len(counted))
        total, n = times @ self.matrix[[known[w] for w in counted]], times.sum()
        z = (total - total.max()) / n * max(np.sqrt(n), 1.0)
        p = np.exp(z) / np.exp(z).sum()
        k = int(np.argmax(p))
        return self.names[k], float(p[k])


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    taught = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    # A repeated row counts once, whatever its id.
    taught = taught.withColumn("key", F.xxhash64("id", "text"))
    place = F.pmod("key", F.lit(1 << 40)).cast("double")
    # Twice the sample by the hash's share first, so that no language meets in one task.
    sizes = taught.groupBy("lang").agg(F.approx_count_distinct("key").alias("n"))
    near = taught.select("key", "lang", place.alias("place")).join(sizes, "lang").where(F.col("place") * F.col("n") <= F.lit(2.0 * sample * (1 << 40))).distinct()
    chosen = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "key"))).where(F.col("rank") <= sample)
    chosen = chosen.select("key", "lang", (F.col("n") < sample // 10).alias("rare"))  # at most `sample` a language, so it may be broadcast

    def count(batch):
        c: Counter = Counter()
        rare = dict(zip(batch.column("lang").to_pylist(), batch.column("rare").to_pylist(), strict=True))
        for t, lang in zip(texts_of(batch), batch.column("lang").to_pylist(), strict=True):
            for w in words(t):
                c[lang, 0, w] += 1
        for (lang, _, w), k in list(c.items()):
            for n in range(1, LONGEST + 1):
                for g in grams(w, n):
                    c[lang, n, g] += k
        keys = list(c)
        return {"lang": [k[0] for k in keys], "rare": [rare[k[0]] for k in keys], "n": [k[1] for k in keys], "s": [k[2] for k in keys], "c": [c[k] for k in keys]}

    counted = map_arrow(taught.join(F.broadcast(chosen), ["key", "lang"]).dropDuplicates(["key", "lang"]).select("text", "lang", "rare"), count, struct("lang string, rare boolean, n int, s string, c long"))
    got = counted.groupBy("lang", "rare", "n", "s").agg(F.sum("c").alias("c")).where("c > 1 or n = 1 or rare").toArrow()
    keys = zip(*(got.column(x).to_pylist() for x in ("lang", "n", "s")), strict=True)
    return Languages(dict(zip(keys, got.column("c").to_pylist(), strict=True)))


def identify(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        found = [model.value.predict(t) for t in texts_of(batch)]
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return map_arrow(rows, run, struct(f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double"))
