"""Votes over observations of one thing: which label holds, how surely, and under which rules to abstain.

Every vote is a two-level aggregate (per key and label, then per key), so both levels combine before the shuffle. Ties are
broken by the label, in the direction each operator names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def weighted_vote(obs: DataFrame, keys: list[str], label: str, weight: Column, base: Column, least: int, threshold: float) -> DataFrame:
    """keys, label, confidence, samples, stable. Confidence is the winner's weight over the base of all rows, unknown ones
    included; the label stays 'unknown' unless it is stable (enough samples and confidence). Ties: smallest label.
    """
    per = obs.groupBy(*keys, label).agg(F.sum(weight).alias("w"), F.sum(base).alias("b"), F.count("*").alias("n"))
    known = F.col(label) != UNKNOWN
    best = F.min(F.when(known, F.struct((-F.col("w")).alias("w"), F.col(label).alias("label"), F.col("n").alias("n"))))
    g = per.groupBy(*keys).agg(best.alias("x"), F.sum("b").alias("all"))
    confidence = F.coalesce(F.try_divide(-F.col("x.w"), F.col("all")), F.lit(0.0))
    stable = F.coalesce((F.col("x.n") >= least) & (confidence >= threshold), F.lit(False))
    return g.select(*keys, F.when(stable, F.col("x.label")).otherwise(UNKNOWN).alias("label"), confidence.alias("confidence"), F.coalesce("x.n", F.lit(0)).alias("samples"), stable.alias("stable"))


def share_margin_vote(obs: DataFrame, keys: list[str], label: str, weight: Column, share: float, margin: float) -> DataFrame:
    """keys, label, share, margin over the weight of known rows only; 'unknown' below either bound. Ties: smallest label."""
    per = obs.where(F.col(label) != UNKNOWN).groupBy(*keys, label).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*keys).orderBy(F.desc("w"), label)
    ranked = per.withColumn("k", F.row_number().over(w)).withColumn("all", F.sum("w").over(Window.partitionBy(*keys)))
    top = ranked.where("k <= 2").groupBy(*keys).agg(
        F.max(F.when(F.col("k") == 1, F.col(label))).alias("top"), F.max(F.when(F.col("k") == 1, F.col("w"))).alias("first"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("w"))), F.lit(0)).alias("second"), F.max("all").alias("all")
    )
    s, m = F.try_divide("first", "all"), F.try_divide(F.col("first") - F.col("second"), F.col("all"))
    won = F.coalesce((F.col("all") > 0) & (s >= share) & (m >= margin), F.lit(False))
    voted = top.select(*keys, F.when(won, F.col("top")).otherwise(UNKNOWN).alias("label"), F.coalesce(s, F.lit(0.0)).alias("share"), F.coalesce(m, F.lit(0.0)).alias("margin"))
    return obs.select(*keys).distinct().join(voted, keys, "left").select(*keys, F.coalesce("label", F.lit(UNKNOWN)).alias("label"), F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("margin", F.lit(0.0)).alias("margin"))


def majority(obs: DataFrame, keys: list[str], label: str, floor: float) -> DataFrame:
    """keys, label, share: the most frequent known label, if its share of ALL rows reaches the floor. Ties: smallest label."""
    per = obs.groupBy(*keys, label).agg(F.count("*").alias("n"))
    best = F.min(F.when(F.col(label) != UNKNOWN, F.struct((-F.col("n")).alias("n"), F.col(label).alias("label"))))
    g = per.groupBy(*keys).agg(best.alias("x"), F.sum("n").alias("all"))
    share = F.coalesce(-F.col("x.n") / F.col("all"), F.lit(0.0))
    return g.select(*keys, F.when(share >= floor, F.col("x.label")).otherwise(UNKNOWN).alias("label"), share.alias("share"))


def view_consensus(views: DataFrame, keys: list[str], label: str, confidence: str, least: int, floor: float) -> DataFrame:
    """keys, label, confidence: a label that at least `least` views give, with the least confidence among them, if that
    reaches the floor. Ties: largest label. Keys without such a label are absent.
    """
    per = views.groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(confidence).alias("c"))
    best = per.groupBy(*keys).agg(F.max(F.struct("n", F.col(label).alias("label"), "c")).alias("x"))
    return best.where((F.col("x.n") >= least) & (F.col("x.c") >= floor)).select(*keys, F.col("x.label").alias("label"), F.col("x.c").alias("confidence"))


def unanimous(decisions: DataFrame, keys: list[str], label: str, confidence: str, expected: int) -> DataFrame:
    """keys, label, confidence where all expected teachers decided and agree; confidence is their least."""
    g = decisions.groupBy(*keys).agg(F.count("*").alias("n"), F.min(label).alias("low"), F.max(label).alias("high"), F.min(confidence).alias("confidence"))
    return g.where((F.col("n") == expected) & (F.col("low") == F.col("high"))).select(*keys, F.col("low").alias("label"), "confidence")


def mean_vector(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, position, mean: the elementwise mean of vectors, in long form so that it combines before the shuffle."""
    return rows.select(*keys, F.posexplode(vector).alias("position", "x")).groupBy(*keys, "position").agg(F.avg("x").alias("mean"))


def strong_track(obs: DataFrame, keys: list[str], label: str, strong: Column, least: int, fraction: float) -> DataFrame:
    """keys, label: the one label of all strong rows, if there are enough of them and they are a large enough part."""
    g = obs.groupBy(*keys).agg(F.count_if(strong).alias("s"), F.count("*").alias("n"), F.min(F.when(strong, F.col(label))).alias("low"), F.max(F.when(strong, F.col(label))).alias("high"))
    good = (F.col("s") >= least) & (F.col("low") == F.col("high")) & (F.col("s") >= fraction * F.col("n"))
    return g.select(*keys, F.when(good, F.col("low")).alias("label"), F.col("s").alias("n_strong"), "n")
