"""Thresholds and the like, chosen from what they would let through.

A sweep over all thresholds is one cumulative sum by falling score, with all rows of one score taken together, instead of
a join of candidates with rows. Scores are grouped first, so the windows run over distinct scores.
"""

from __future__ import annotations

import itertools
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sweep(rows: DataFrame, keys: list[str], score: str, correct: Column) -> DataFrame:
    """keys, threshold, selected, correct, precision: what score >= threshold selects, for each score that occurs."""
    per = rows.groupBy(*keys, score).agg(F.count("*").alias("_n"), F.count_if(correct).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    s = per.select(*keys, F.col(score).alias("threshold"), F.sum("_n").over(w).alias("selected"), F.sum("_c").over(w).alias("correct"))
    return s.withColumn("precision", F.col("correct") / F.col("selected"))


def best_threshold(swept: DataFrame, keys: list[str], passing: Column, rank: list[Column]) -> DataFrame:
    """The passing threshold that is first by rank, per key."""
    w = Window.partitionBy(*keys).orderBy(*rank)
    return swept.where(passing).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def grid(rows: DataFrame, candidates: DataFrame, keys: list[str], **measures: Column) -> DataFrame:
    """Measures per candidate; candidates are a parameter grid, of which the caller fixes the size, so it is broadcast."""
    return rows.join(F.broadcast(candidates)).groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])


def pareto(points: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """The points that no other is at least as good as in both measures and better in one.

    A point is kept if it has the most b among those with its a, and more b than all points with a greater a: one sort
    instead of a comparison of all pairs.
    """
    top = points.groupBy(a).agg(F.max(b).alias("_top"))
    w = Window.orderBy(F.desc(a)).rowsBetween(Window.unboundedPreceding, -1)  # over distinct values of one measure of a grid
    edge = top.withColumn("_above", F.max("_top").over(w)).where(F.col("_above").isNull() | (F.col("_top") > F.col("_above")))
    return points.join(edge, a).where(F.col(b) == F.col("_top")).drop("_top", "_above")


def chosen(points: DataFrame, passing: Column, rank: list[Column], otherwise: list[Column], last: list[Column]) -> DataFrame:
    """points with passes and chosen: of the passing points the greatest by `rank`, and if none passes, of all the greatest
    by `otherwise`; ties go to the first by `last`. Points are those of a parameter grid, so they fit one task."""
    ok = F.coalesce(passing, F.lit(False))
    order = [F.desc(ok), *[F.desc(F.when(ok, c)) for c in rank], *[F.desc(F.when(~ok, c)) for c in otherwise], *last]
    return points.select("*", ok.alias("passes"), (F.row_number().over(Window.orderBy(*order)) == 1).alias("chosen"))


def on_grid(swept: DataFrame, keys: list[str], step: float) -> DataFrame:
    """A sweep brought to thresholds of a grid: of the grid steps that select the same, the strictest. One row per key and
    step at most, whatever the number of scores."""
    at = F.floor(F.col("threshold") / step + 1e-9).cast("long")
    w = Window.partitionBy(*keys, "_at").orderBy("threshold")
    first = swept.withColumn("_at", at).withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return first.withColumn("threshold", F.col("_at") * F.lit(step)).drop("_at", "_k")


def joint_thresholds(options: list[tuple[str, int, int, float]], precision: float) -> dict:
    """The most rows that per-class thresholds can select together at the given precision: exact.

    options: label, selected, correct, threshold, as sweep() gives them per class; a class may also select nothing, with
    threshold 1.01. Equal outcomes go to more correct rows, then to stricter thresholds (their sum).

    Classes are added one after another. What matters of a choice is how many rows it selects and how much precision it
    has to spare, correct - precision * selected, in whole numbers. Choices are arrays in the order of rows selected, of
    which one stays only if it has more to spare than all that select more; each remembers its option and the choice it
    was made from, so the thresholds are read backwards from the last one. Runs on the driver: its input has one row per
    class and step of a threshold grid, whatever the number of rows.
    """
    exact = Fraction(precision).limit_denominator(10**6)
    over, under = (exact if float(exact) == precision else Fraction(precision)).as_integer_ratio()
    classes = []
    for label, of in itertools.groupby(sorted(options), key=lambda o: o[0]):
        rows = [(0, 0, 1.01), *[o[1:] for o in of]]
        selected, correct = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        classes.append((label, selected, correct * under - selected * over, np.array([r[2] for r in rows])))
    most = [int(spare.max()) for _, _, spare, _ in classes]
    selected, spare, strict = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for k, (_, own, own_spare, own_strict) in enumerate(classes):
        n, m = (np.add.outer(x, y).ravel() for x, y in ((selected, own), (spare, own_spare)))
        t = np.add.outer(strict, own_strict).ravel()
        order = np.lexsort((-t, -m, -n))
        front = np.maximum.accumulate(m[order])
        # more to spare than everything before it, and enough for the classes to come to make good
        keep = np.concatenate(([True], front[1:] > front[:-1])) & (m[order] + sum(most[k + 1 :]) >= 0)
        kept = order[keep]
        selected, spare, strict = n[kept], m[kept], t[kept]
        steps.append((kept // len(own), kept % len(own)))
    good = np.flatnonzero((spare >= 0) & (selected > 0))
    if not len(good):
        raise ValueError("no thresholds reach the precision")
    at = max(good, key=lambda i: (selected[i], spare[i], strict[i]))
    best, thresholds = int(at), {}
    for (label, _, _, own), (before, option) in zip(reversed(classes), reversed(steps), strict=True):
        thresholds[label] = float(own[option[at]])
        at = before[at]
    n = int(selected[best])
    return {"selected": n, "precision": (int(spare[best]) + n * over) / under / n, "thresholds": dict(sorted(thresholds.items()))}
