"""What is said of whole runs: frontiers, presets and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frontier(points: DataFrame, falling: str, rising: str, tie: str) -> DataFrame:
    """The points that no other one beats in both measures; a table of runs, so one window orders it."""
    before = F.max(rising).over(Window.orderBy(F.col(falling).desc(), F.col(rising).desc(), F.col(tie)).rowsBetween(Window.unboundedPreceding, -1))
    return points.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(rising) > F.col("_before"))).drop("_before")


def touched(found: DataFrame, row_bytes: int, page: int = 4096) -> DataFrame:
    """(qid, pages): how many pages of a dense file each query's rows lie on."""
    return found.groupBy("qid").agg(F.countDistinct(F.floor(F.col("vec_id") * row_bytes / page)).alias("pages"))


def interpolated(points: list[tuple[float, float]], at: float) -> float | None:
    """The second measure at a value of the first, on a log scale between neighbours; None outside."""
    import math

    p = sorted(points)
    for (a, x), (b, y) in zip(p, p[1:], strict=False):
        if a <= at <= b:
            return x if a == b else math.exp(math.log(x) + (math.log(y) - math.log(x)) * (at - a) / (b - a))
    return None


def geometric_fit(points: list[tuple[int, float]], steps: int = 999) -> dict[str, float]:
    """ceiling - amplitude * contraction^(rounds - 1) of least squares; contraction from a grid, ceiling within [max, 1]."""
    import numpy as np

    n, y = np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)
    best = None
    for contraction in np.arange(1, steps + 1) / (steps + 1):
        base = contraction ** (n - 1)
        (ceiling, slope), *_ = np.linalg.lstsq(np.column_stack([np.ones_like(n), base]), y, rcond=None)
        error = float(np.sqrt(((ceiling + slope * base - y) ** 2).mean()))
        if y.max() - 1e-12 <= ceiling <= 1 and slope <= 0 and (best is None or error < best["rmse"]):
            best = {"ceiling": float(ceiling), "amplitude": float(-slope), "contraction": float(contraction), "rmse": error}
    if best is None:
        raise ValueError("no fit has a ceiling between the largest value and 1")
    return best


def cohorts(results: DataFrame, members: DataFrame) -> DataFrame:
    """(cohort, n_places, n_rows, distinct_share): how much the results of a group of queries (qid, cohort) overlap."""
    both = results.select("qid", "vec_id").join(members, "qid")
    out = both.groupBy("cohort").agg(F.count("*").alias("n_places"), F.countDistinct("vec_id").alias("n_rows"))
    return out.withColumn("distinct_share", F.round(F.col("n_rows") / F.col("n_places"), 6))
