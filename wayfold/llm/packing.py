"""Problem 8: texts of varying length in containers of fixed capacity, with little space unused.

Items above a third of the capacity fit at most two to a container, so they are matched: from the largest down, each takes
the largest free partner that still fits. Smaller items, from the largest down, go where they leave the smallest gap, or
open a container. Only a text that alone exceeds the capacity is split: into full containers and one remaining item.

How it scales. The full pieces of a split text are full containers as they are; they are written without being packed. So
a text has one item to be packed at most, however long it is. These items are counted and spread by hash over blocks of
about `block_items`, and each block is packed by itself in one task, so a task's work is bounded whatever the input; a
block leaves at most about one container badly filled. Sizes, not texts, are shuffled; equal rows are counted first.

Null and empty texts have no tokens and need no space: they are in no container. Repeated rows are items of their own. A
capacity that is null or below 1 holds nothing and is left out. Ties go to the lower doc_id, then to the earlier part.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normal
from ..session import Scratch
from .tokens import VOCABULARY, measured

_OUT = "container_kind string, block long, slot long, capacity long, doc_id long, part long, tokens long"


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item. sizes: from the largest down, each from 1 to capacity."""
    where = [-1] * len(sizes)
    large = sum(1 for s in sizes if s * 3 > capacity)
    rising = sizes[:large][::-1]  # position k here is item large - 1 - k
    free = list(range(-1, large))  # free[k + 1]: the last position up to k that may still be free, by path halving

    def last_free(k: int) -> int:
        k += 1
        while free[k] != k - 1:
            free[k] = free[free[k] + 1]
            k = free[k] + 1
        return k - 1

    opened = 0
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for k in range(large - 1, -1, -1):
        item = large - 1 - k
        if where[item] >= 0:
            continue
        where[item], room = opened, capacity - rising[k]
        free[k + 1] = k - 1
        partner = last_free(min(k - 1, bisect_right(rising, room) - 1))
        if partner >= 0:
            where[large - 1 - partner] = opened
            room -= rising[partner]
            free[partner + 1] = partner - 1
        gaps[room].append(opened)
        mask |= 1 << room
        opened += 1
    for item in range(large, len(sizes)):
        size = sizes[item]
        fitting = mask >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            bin_ = gaps[gap].pop()
            if not gaps[gap]:
                mask &= ~(1 << gap)
        else:
            gap, bin_ = capacity, opened
            opened += 1
        where[item] = bin_
        gaps[gap - size].append(bin_)
        mask |= 1 << (gap - size)
    return where


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable")
    pdf["slot"] = pack(pdf["tokens"].tolist(), int(pdf["capacity"].iloc[0]))
    return pdf[["container_kind", "block", "slot", "capacity", "doc_id", "part", "tokens"]]


def packed_items(documents: DataFrame, limits: DataFrame, vocabulary: str = VOCABULARY, block_items: int = 20_000, scratch: Scratch | None = None) -> DataFrame:
    """container_kind, container_id, capacity, doc_id, part, tokens: one row per item of each kind of container.

    part numbers the pieces of a split text from 0, in its order.
    """
    scratch = scratch or Scratch(documents.sparkSession, "packing")
    sized = scratch.keep(measured(documents, {"doc_id": F.col("doc_id").cast("long")}, vocabulary).where("tokens > 0"), "sizes")
    kinds = limits.select(normal.key("container_kind").alias("container_kind"), F.col("capacity_tokens").cast("long").alias("capacity")).where("container_kind is not null and capacity > 0")
    kinds = kinds.groupBy("container_kind").agg(F.max("capacity").alias("capacity"))
    # Rows that are equal are told apart by a number, so that they go to different blocks and are containers of their own.
    counted = sized.groupBy("doc_id", "tokens").agg(F.count("*").alias("copies"))
    rows = counted.select("doc_id", F.col("tokens").alias("all"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    each = rows.join(F.broadcast(kinds))  # a parameter table: one row per kind of container
    n_full = F.call_function("div", F.col("all"), F.col("capacity"))
    long = each.where("all >= capacity").select("*", F.explode(F.sequence(F.lit(0).cast("long"), n_full - 1)).alias("part"))
    name = F.concat(F.col("container_kind"), F.lit("-full-"), F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "all", "copy", "part"))
    full = long.select("container_kind", name.alias("container_id"), "capacity", "doc_id", "part", F.col("capacity").alias("tokens"))
    items = each.select("container_kind", "capacity", "doc_id", "copy", n_full.alias("part"), (F.col("all") - n_full * F.col("capacity")).alias("tokens")).where("tokens > 0")
    count = sized.count()  # the most items that a kind can have
    block = F.pmod(F.xxhash64("doc_id", "part", "tokens", "copy"), F.lit(max(1, -(-count // block_items))))
    blocked = items.withColumn("block", block).drop("copy").withColumn("slot", F.lit(0).cast("long"))
    placed = blocked.groupBy("container_kind", "block").applyInPandas(_pack_block, _OUT)
    name = F.format_string("%s-%06d-%06d", "container_kind", "block", "slot")
    return placed.select("container_kind", name.alias("container_id"), "capacity", "doc_id", "part", "tokens").union(full)


def containers(documents: DataFrame, limits: DataFrame, **how) -> DataFrame:
    """One row per container: container_kind, container_id, capacity, n_items, tokens, fill, items.

    items holds doc_id, part and tokens of each item; a container holds at most capacity items, as each has a token.
    """
    items = packed_items(documents, limits, **how)
    return items.groupBy("container_kind", "container_id", "capacity").agg(
        F.count("*").alias("n_items"), F.sum("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("doc_id", "part", "tokens"))).alias("items")
    ).withColumn("fill", F.col("tokens") / F.col("capacity"))


def fill_report(documents: DataFrame, limits: DataFrame, **how) -> DataFrame:
    """Per kind: n_containers, n_items, tokens, fill (mean), least_containers (tokens over capacity, rounded up)."""
    items = packed_items(documents, limits, **how)
    per = items.groupBy("container_kind", "container_id", "capacity").agg(F.count("*").alias("n_items"), F.sum("tokens").alias("tokens"))
    return per.groupBy("container_kind", "capacity").agg(
        F.count("*").alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("tokens").alias("tokens"), F.avg(F.col("tokens") / F.col("capacity")).alias("fill")
    ).withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity")).cast("long"))


def invariants(documents: DataFrame, limits: DataFrame, vocabulary: str = VOCABULARY, scratch: Scratch | None = None, **how) -> DataFrame:
    """Per kind what has to hold: container_kind, capacity, n_texts placed, and how many n_overfull containers, n_torn texts
    (in more parts than they need) and n_unequal texts (whose parts do not add up) there are; fits: whether no more
    containers are used than 1.05 times the least possible and one for each block."""
    scratch = scratch or Scratch(documents.sparkSession, "packing")
    sized = scratch.keep(measured(documents, {"doc_id": F.col("doc_id").cast("long")}, vocabulary).where("tokens > 0"), "all-sizes")
    items = scratch.keep(packed_items(documents, limits, vocabulary, scratch=scratch, **how), "items")
    per = items.groupBy("container_kind", "capacity", "container_id").agg(F.sum("tokens").alias("held"))
    boxes = per.groupBy("container_kind", "capacity").agg(F.count_if(F.col("held") > F.col("capacity")).alias("n_overfull"), F.count("*").alias("n"), F.sum("held").alias("all"))
    wanted = sized.groupBy("doc_id").agg(F.sum("tokens").alias("want"), F.count("*").alias("copies"), F.max("tokens").alias("longest"))
    got = items.groupBy("container_kind", "capacity", F.col("doc_id").alias("doc")).agg(F.sum("tokens").alias("got"), F.count("*").alias("parts"))
    both = got.join(wanted, F.col("doc").eqNullSafe(F.col("doc_id")))
    texts = both.groupBy(F.col("container_kind").alias("kind")).agg(
        F.count("*").alias("n_texts"), F.count_if(F.col("parts") > F.ceil(F.col("longest") / F.col("capacity")) * F.col("copies")).alias("n_torn"), F.count_if(F.col("got") != F.col("want")).alias("n_unequal")
    )
    blocks = -(-sized.count() // how.get("block_items", 20_000))
    fits = F.col("n") <= F.ceil(F.col("all") / F.col("capacity")) * 1.05 + 1 + blocks
    return boxes.join(texts, F.col("container_kind") == F.col("kind")).select("container_kind", "capacity", "n_texts", "n_overfull", "n_torn", "n_unequal", fits.alias("fits"))
