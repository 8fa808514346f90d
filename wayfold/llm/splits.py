"""Problem 4: a split for every record such that linked records share it, with sizes and labels near given shares.

Rows are linked if they share a key (track group, source group, camera), directly or through others. A linked set is
moved as a whole. The search starts from a hashed assignment and moves or exchanges whole sets, accepting worse states
with falling probability, in many blocks at once; each block runs several chains and keeps its best.

How it scales. A key is named by its least row, so linked sets are found on keys, not rows, and a camera with a third of
all rows is one vertex. Sets larger than 1/`coarse` of all rows number fewer than `coarse` by arithmetic; only those are
gathered, and placed first by a search of their own. The others are cut by hash into blocks of about `block_sets` sets,
each of which aims at what the large sets leave over. The MOST_LABELS most frequent labels are told apart by a dictionary,
each with a count of its own; all others share one count, since no set can be told from another by labels that rare.

Nulls, blanks and filler words are no keys; a row without any key is a set of its own. Rows without a split keep none in
the present state, but get one. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normal
from ..session import Scratch
from .groups import hash_to_min

KEYS = ("track_group", "source_group", "camera_id")
#: Labels that are balanced one by one; what is rarer is balanced together.
MOST_LABELS = 63


def row_sets(manifest: DataFrame, keys: tuple[str, ...] = KEYS, scratch: Scratch | None = None) -> DataFrame:
    """row, split (normal form or null), label, set_id: the least row number among the keys' names that are linked."""
    scratch = scratch or Scratch(manifest.sparkSession, "splits")
    rows = manifest.select(
        F.col("stage177_row_number").cast("long").alias("row"), normal.split_name("split").alias("split"),
        F.coalesce(normal.label("body_type"), F.lit("unknown")).alias("label"), *[normal.key(k).alias(k) for k in keys],
    ).where("row is not null")
    held = rows.select("row", F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("key")) for i, k in enumerate(keys)])).alias("x")).select("row", "x.kind", "x.key").where("key is not null")
    names = held.groupBy("kind", "key").agg(F.min("row").alias("name"))
    # The names of a row as a set: a row that occurs twice has no more of them than once.
    named = held.join(names, ["kind", "key"]).groupBy("row").agg(F.min("name").alias("low"), F.collect_set("name").alias("names"))
    named = scratch.keep(named, "names")
    edges = named.select(F.col("low").alias("a"), F.explode("names").alias("b")).where("a <> b").distinct()
    groups = hash_to_min(edges, scratch)
    of_row = named.select("row", F.col("low").alias("vertex")).join(groups, "vertex", "left").select("row", F.coalesce("group_id", "vertex").alias("found"))
    base = rows.select("row", "split", "label")
    return base.join(of_row, "row", "left").select("row", "split", "label", F.coalesce("found", "row").alias("set_id"))


def torn_rows(manifest: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """stage177_row_number of every row in a linked set that now holds two or more splits."""
    rows = row_sets(manifest, scratch=scratch)
    torn = rows.where("split is not null").groupBy("set_id", "split").agg(F.lit(1).alias("x")).groupBy("set_id").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(torn, "set_id", "left_semi").select(F.col("row").alias("stage177_row_number")).distinct()


def anneal(sizes: np.ndarray, labels: np.ndarray, targets: np.ndarray, label_targets: np.ndarray, start: np.ndarray, seed: int, chains: int = 3, steps: int = 0) -> np.ndarray:
    """The best assignment found of sets to splits.

    sizes [n]; labels [n, bins]; targets [s] rows wanted; label_targets [s, bins]; start [n] the first assignment. The
    energy is the sum over splits of squared size error, plus a tenth of the squared errors by label, each relative to
    the whole. Half of the moves take one set to another split, half exchange two sets.
    """
    n, splits = len(sizes), len(targets)
    if n == 0 or splits < 2:
        return start
    total = max(1.0, float(targets.sum()))
    load = np.concatenate([sizes[:, None] * 1.0, labels * 0.316], axis=1) / total
    want = np.concatenate([targets[:, None] * 1.0, label_targets * 0.316], axis=1) / total
    steps = steps or 3_000 + 12 * n
    best, best_energy = start.copy(), np.inf
    for chain in range(chains):
        rng = np.random.default_rng([seed, chain])
        state = start.copy() if chain == 0 else rng.choice(splits, n, p=np.maximum(targets, 0) / max(1e-9, np.maximum(targets, 0).sum()))
        error = -want.copy()
        np.add.at(error, state, load)
        energy = float((error**2).sum())
        if energy < best_energy:
            best, best_energy = state.copy(), energy
        heat, cool = max(energy, 1e-12), (1e-7) ** (1 / steps)
        pick = rng.integers(0, n, (steps, 2))
        other = rng.integers(1, splits, steps)
        swap = rng.random(steps) < 0.5
        bar = rng.random(steps)
        for k in range(steps):
            i, j = pick[k]
            a = state[i]
            if swap[k]:
                b, delta = state[j], load[i] - load[j]
                if a == b:
                    heat *= cool
                    continue
            else:
                b, delta = (a + other[k]) % splits, load[i]
            # The energy changes by what moving `delta` from a to b adds to either error.
            change = 2.0 * float(delta @ (error[b] - error[a] + delta))
            if change < 0 or bar[k] < np.exp(-change / heat):
                error[a] -= delta
                error[b] += delta
                state[i] = b
                if swap[k]:
                    state[j] = a
                energy += change
                if energy < best_energy:
                    best, best_energy = state.copy(), energy
            heat *= cool
    return best


def _bins(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["labels"].tolist(), float).reshape(len(pdf), -1)


def label_numbers(rows: DataFrame, most: int = MOST_LABELS) -> dict[str, int]:
    """Numbers of the most frequent labels, ties by name; `most` rows at most reach the driver."""
    counted = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most)
    return {r["label"]: i for i, r in enumerate(counted.collect())}


def set_splits(rows: DataFrame, shares: dict[str, float], scratch: Scratch, seed: int = 17, coarse: int = 500, block_sets: int = 2000) -> DataFrame:
    """set_id, new_split for each set of row_sets()."""
    spark = rows.sparkSession
    names = sorted(shares)
    share = np.array([shares[s] for s in names], float)
    share = share / share.sum()
    number = label_numbers(rows)
    bins = len(number) + 1
    of_label = [F.count_if(F.col("label") == label) for label in number]
    counts = rows.groupBy("set_id").agg(F.count("*").alias("n"), F.array(*of_label, F.lit(0).cast("long")).alias("known"))
    other = F.col("n") - F.aggregate("known", F.lit(0).cast("long"), lambda a, x: a + x)
    sets = scratch.keep(counts.select("set_id", "n", F.concat(F.slice("known", 1, len(number)), F.array(other)).alias("labels")), "sets")
    whole = sets.agg(F.sum("n").alias("n"), F.count("*").alias("sets"), *[F.sum(F.col("labels")[i]).alias(f"l{i}") for i in range(bins)]).first()
    total, label_total = int(whole["n"] or 0), np.array([float(whole[f"l{i}"] or 0) for i in range(bins)])
    limit = max(1, total // coarse)
    large = sets.where(F.col("n") > limit).orderBy("set_id").toPandas()  # fewer than `coarse` rows
    start = np.array([_hashed(int(s), share, seed) for s in large["set_id"]], int)
    placed = anneal(large["n"].to_numpy(float), _bins(large) if len(large) else np.zeros((0, bins)), share * total, share[:, None] * label_total[None, :], start, seed, chains=8)
    taken, taken_labels = np.zeros(len(names)), np.zeros((len(names), bins))
    np.add.at(taken, placed, large["n"].to_numpy(float))
    if len(large):
        np.add.at(taken_labels, placed, _bins(large))
    rest = np.maximum(0.0, share * total - taken)
    rest = rest / rest.sum() if rest.sum() > 0 else share
    rest_labels = np.maximum(0.0, share[:, None] * label_total[None, :] - taken_labels)
    rest_labels = rest_labels / np.maximum(1e-9, rest_labels.sum(axis=0, keepdims=True))
    blocks = max(1, -(-int(whole["sets"]) // block_sets))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("set_id")
        sizes, labels = pdf["n"].to_numpy(float), _bins(pdf)
        first = np.array([_hashed(int(s), rest, seed) for s in pdf["set_id"]], int)
        out = anneal(sizes, labels, rest * sizes.sum(), rest_labels * labels.sum(axis=0, keepdims=True), first, seed)
        return pd.DataFrame({"set_id": pdf["set_id"], "new_split": [names[i] for i in out]})

    small = sets.where(F.col("n") <= limit).withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(seed)), F.lit(blocks)))
    moved = small.groupBy("block").applyInPandas(place, "set_id long, new_split string")
    of_large = spark.createDataFrame([(int(s), names[i]) for s, i in zip(large["set_id"], placed, strict=True)], "set_id long, new_split string")
    return scratch.keep(moved.union(of_large), "placed")


def _hashed(set_id: int, share: np.ndarray, seed: int) -> int:
    """A split by a hash of the set, in proportion to the shares."""
    x = (set_id * 0x9E3779B97F4A7C15 + seed * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 31)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return int(min(len(share) - 1, np.searchsorted(np.cumsum(share), (x >> 11) / 2.0**53, side="right")))


def shares_of(split_targets: DataFrame) -> dict[str, float]:
    """The wanted shares; the table is a parameter table with one row per split."""
    found = split_targets.select(normal.split_name("split").alias("split"), F.col("target_share").cast("double").alias("share")).where("split is not null and share > 0")
    return {r["split"]: r["share"] for r in found.groupBy("split").agg(F.sum("share").alias("share")).collect()}


def assigned_rows(manifest: DataFrame, split_targets: DataFrame, scratch: Scratch | None = None, **how) -> DataFrame:
    """stage177_row_number, set_id, old_split, new_split for every row."""
    scratch = scratch or Scratch(manifest.sparkSession, "splits")
    shares = shares_of(split_targets)
    if not shares:
        raise ValueError("split_targets holds no split with a positive share")
    rows = scratch.keep(row_sets(manifest, scratch=scratch), "rows")
    placed = set_splits(rows, shares, scratch, **how)
    return rows.join(placed, "set_id").select(F.col("row").alias("stage177_row_number"), "set_id", F.col("split").alias("old_split"), "new_split")


def reached_shares(manifest: DataFrame, split_targets: DataFrame, scratch: Scratch | None = None, **how) -> DataFrame:
    """split, n_rows, n_sets, target_share, reached_share."""
    rows = assigned_rows(manifest, split_targets, scratch, **how)
    per = rows.groupBy("new_split", "set_id").agg(F.count("*").alias("n")).groupBy("new_split").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_sets"))
    wanted = split_targets.select(normal.split_name("split").alias("split"), "target_share")
    total = per.agg(F.sum("n_rows").alias("total"))
    return wanted.join(per, F.col("split") == F.col("new_split"), "left").crossJoin(total).select(
        "split", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_sets", F.lit(0)).alias("n_sets"), "target_share", F.coalesce(F.try_divide("n_rows", "total"), F.lit(0.0)).alias("reached_share")
    )


def label_report(manifest: DataFrame, split_targets: DataFrame, scratch: Scratch | None = None, **how) -> DataFrame:
    """label, split, n_rows, reached_share (of the rows of that label), deviation from the target share."""
    scratch = scratch or Scratch(manifest.sparkSession, "splits")
    rows = scratch.keep(assigned_rows(manifest, split_targets, scratch, **how), "assigned")
    label = manifest.select(F.col("stage177_row_number").cast("long").alias("stage177_row_number"), F.coalesce(normal.label("body_type"), F.lit("unknown")).alias("label")).distinct()
    per = rows.select("stage177_row_number", "new_split").distinct().join(label, "stage177_row_number").groupBy("label", F.col("new_split").alias("split")).agg(F.count("*").alias("n_rows"))
    wanted = split_targets.select(normal.split_name("split").alias("split"), F.col("target_share").cast("double").alias("target_share")).where("split is not null and target_share > 0").groupBy("split").agg(F.sum("target_share").alias("share"))
    wanted = wanted.crossJoin(wanted.agg(F.sum("share").alias("all"))).select("split", (F.col("share") / F.col("all")).alias("share"))
    totals = per.groupBy("label").agg(F.sum("n_rows").alias("total"))
    out = totals.crossJoin(wanted).join(per, ["label", "split"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return out.select("label", "split", "n_rows", (F.col("n_rows") / F.col("total")).alias("reached_share"), (F.col("n_rows") / F.col("total") - F.col("share")).alias("deviation"))


def invariants(manifest: DataFrame, split_targets: DataFrame, scratch: Scratch | None = None, **how) -> DataFrame:
    """One row of what has to hold: n_rows, n_sets, n_torn (sets in two or more splits), n_without (rows without a split of
    the targets), near (whether every share is within one per cent of its target)."""
    scratch = scratch or Scratch(manifest.sparkSession, "splits")
    rows = scratch.keep(assigned_rows(manifest, split_targets, scratch, **how), "assigned")
    shares = shares_of(split_targets)
    whole = sum(shares.values())
    per = rows.groupBy("set_id").agg(F.count("*").alias("n"), F.count_distinct("new_split").alias("splits"), F.count_if(~F.coalesce(F.col("new_split").isin(*shares), F.lit(False))).alias("without"), *[F.count_if(F.col("new_split") == k).alias(f"in_{i}") for i, k in enumerate(shares)])
    near = F.lit(True)
    for i, share in enumerate(shares.values()):
        near = near & (F.abs(F.sum(f"in_{i}") / F.sum("n") - share / whole) <= 0.01)
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_sets"), F.count_if(F.col("splits") > 1).alias("n_torn"), F.sum("without").alias("n_without"), near.alias("near"))
