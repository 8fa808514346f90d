"""Quotas, splits and repeats, by hash order so that a run can be repeated anywhere."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import hash_rank


def hash_order(salt: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)


def quotas(rows: DataFrame, label: str, key: str, target: int, salt: str = "quota|") -> DataFrame:
    """About `target` rows, evenly over labels in hash order; what a label lacks is filled from the others' leftovers.

    The remainder of the division goes to the first labels in alphabetical order. The fill ranks leftovers over all
    labels by hash, limited to `target` rows.
    """
    names = rows.groupBy(label).agg(F.count("*").alias("held"))
    n = Window.orderBy(label)
    plan = names.withColumn("i", F.row_number().over(n) - 1).withColumn("k", F.count("*").over(Window.partitionBy()))  # one row per label
    plan = plan.withColumn("quota", F.floor(F.lit(target) / F.col("k")).cast("int") + (F.col("i") < F.lit(target) % F.col("k")).cast("int"))
    ranked = rows.join(plan.select(label, "quota"), label).withColumn("h", hash_order(salt, F.col(key)))
    ranked = hash_rank(ranked, [label], "h", [F.col("h"), F.col(key)]).withColumnRenamed("_rank", "r")
    first = ranked.where(F.col("r") <= F.col("quota"))
    lacking = plan.agg(F.sum(F.greatest(F.lit(0), F.col("quota") - F.col("held"))).cast("int").alias("n")).first()["n"] or 0
    rest = ranked.where(F.col("r") > F.col("quota")).orderBy("h", key).limit(lacking)
    return first.union(rest).drop("quota", "h", "r")


def seeded_split(groups: list[str], ratios: tuple[float, float] = (0.7, 0.15), seed: int = 42) -> dict[str, str]:
    """Groups to splits by a Mersenne shuffle of their sorted names; cut points are rounded half to even.

    For lists of groups that fit on the driver; hash_split() is the distributed form.
    """
    names = sorted(set(groups))
    random.Random(seed).shuffle(names)
    a = round(len(names) * ratios[0])
    b = a + round(len(names) * ratios[1])
    return {g: "train" if i < a else "validation" if i < b else "test" for i, g in enumerate(names)}


def cap_negatives(rows: DataFrame, group: str, positive: Column, key: str, ratio: int, floor: int) -> DataFrame:
    """All positives, and per group at most max(floor, ratio x max(1, positives)) negatives in hash order."""
    n = rows.groupBy(group).agg(F.count_if(positive).alias("n_pos"))
    told = rows.join(n, group).withColumn("_positive", positive).withColumn("_h", hash_order("negative|", F.col(key)))
    ranked = hash_rank(told, [group, "_positive"], "_h", [F.col("_h"), F.col(key)]).withColumnRenamed("_rank", "r").drop("_positive", "_h")
    limit = F.greatest(F.lit(floor), F.lit(ratio) * F.greatest(F.lit(1), F.col("n_pos")))
    return ranked.where(positive | (F.col("r") <= limit)).drop("n_pos", "r")


def group_split(rows: DataFrame, group: str, label: str, source: str, fraction: float, salt: str) -> DataFrame:
    """group, source, label, split: groups with one label and one source, split by hash order within each stratum.

    A stratum of two groups or more gives at least one to validation; groups that mix labels or sources are left out.
    """
    g = rows.groupBy(group).agg(F.min(label).alias(label), F.max(label).alias("l2"), F.min(source).alias(source), F.max(source).alias("s2"))
    g = g.where((F.col(label) == F.col("l2")) & (F.col(source) == F.col("s2"))).drop("l2", "s2")
    w = Window.partitionBy(source, label)
    r = F.row_number().over(w.orderBy(hash_order(salt, F.col(group)), group))
    n = F.count("*").over(w)
    quota = F.when(n >= 2, F.greatest(F.lit(1.0), F.bround(n * F.lit(fraction)))).otherwise(0.0)
    return g.withColumn("split", F.when(r <= quota, "validation").otherwise("train"))


def until_target(groups: DataFrame, stratum: str, group: str, size: str, target: int, salt: str) -> DataFrame:
    """Groups of a stratum in hash order, as long as those before them hold less than the target."""
    w = Window.partitionBy(stratum).orderBy(hash_order(salt, F.col(group)), group).rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("_before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("_before") < target).drop("_before")


def repeated(rows: DataFrame, times: Column) -> DataFrame:
    """Each row `times` times, with the number of the copy."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), times) - 1)))


def evenly_spaced(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Up to k rows per key at positions round(i (n - 1) / (k - 1)), rounded half to even."""
    w = Window.partitionBy(*keys)
    r = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    if k < 2:
        return r.where("_i = 0").drop("_i", "_n")
    picks = F.array(*[F.bround(F.lit(i) * (F.col("_n") - 1) / F.lit(k - 1)).cast("int") for i in range(k)])
    return r.where((F.col("_n") <= k) | F.array_contains(picks, F.col("_i"))).drop("_i", "_n")
