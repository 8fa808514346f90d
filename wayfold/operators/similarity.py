"""Near matches of 64-bit hashes, and what is built on them: leaders and transitive clusters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def block_bounds(radius: int, exact: bool = True) -> list[tuple[int, int]]:
    """(start, width) of the blocks of bits of which two hashes within the radius have one in common.

    With exact=False four 16-bit bands, which at radius 4 miss pairs that differ in every band.
    """
    n = radius + 1 if exact else 4
    out, start, left = [], 0, 64
    for i in range(n):
        width = -(-left // (n - i))
        out.append((start, width))
        start, left = start + width, left - width
    return out


def block_value(bits: str | Column, start: int, width: int) -> Column:
    c = F.col(bits) if isinstance(bits, str) else bits
    return F.shiftrightunsigned(c, start).bitwiseAND(F.lit((1 << width) - 1) if width < 64 else F.lit(-1))


def piece_bounds(left: int, n: int) -> list[tuple[int, int]]:
    """(start, width) of n pieces of `left` bits, the wider ones first."""
    out, start = [], 0
    for i in range(n):
        width = -(-left // (n - i))
        out.append((start, width))
        start, left = start + width, left - width
    return out


def pieces(bits: Column, start: int, width: int, n: int) -> list[Column]:
    """The bits outside a block in n pieces. Of two hashes that agree in the block and differ in fewer than n bits, one
    piece is equal."""
    low = bits.bitwiseAND(F.lit((1 << start) - 1))
    high = F.shiftrightunsigned(bits, start + width) if start + width < 64 else F.lit(0).cast("long")
    rest = F.shiftleft(high, start).bitwiseOR(low)
    return [block_value(rest, *at) for at in piece_bounds(64 - width, n)]


#: Distinct hashes of one block value above which it is refined; and how many times as many there may be in all before
#: every value is. So the table of values to refine has at most 2 x blocks x 8,192 rows, whatever the size of the input.
REFINE_OVER, REFINE_ALL = 4096, 8192


def hamming_pairs(left: DataFrame, right: DataFrame, radius: int, exact: bool = True, within: str | None = None, refine_over: int = REFINE_OVER) -> DataFrame:
    """left_bits, right_bits, distance (and `within`): distinct hashes of either side within the radius, each pair once.

    Only distinct hashes are joined, on equal blocks of bits. A block value that many hashes share is refined by pieces of
    the other bits, of which radius + 1 pieces one is equal too, so that blocks do not grow with the input; what is still
    hot then is a join that adaptive execution may split. A pair is taken from the first block and piece it shares, so no
    duplicates have to be removed afterwards. left and right: a column bits (long); nulls match nothing.
    within: a column of both sides in which the hashes of a pair have to agree, too. refine_over changes no result.
    """
    bounds = block_bounds(radius, exact)
    n = radius + 1
    own = ["bits", *([within] if within else [])]
    sides = [side.where("bits is not null" + (f" and {within} is not null" if within else "")).select(*own).distinct() for side in (left, right)]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), block_value("bits", *at).alias("value")) for i, at in enumerate(bounds)]))
    keyed = [side.select(*own, keys.alias("k")).select(*own, "k.block", "k.value") for side in sides]
    plain = F.array(F.struct((F.col("block") * n).alias("part"), F.col("value").alias("at")))
    fine = None
    for i, (start, width) in enumerate(bounds):
        # a refined part has a number of its own, and its value the block's value before that of the piece
        parts = F.array(*[F.struct(F.lit(len(bounds) * n + i * n + j).alias("part"), F.shiftleft("value", 64 - width).bitwiseOR(v).alias("at")) for j, v in enumerate(pieces(F.col("bits"), start, width, n))])
        fine = (F if fine is None else fine).when(F.col("block") == i, parts)
    many = sides[0].count() if left is right else max(side.count() for side in sides)
    by = ["block", "value", *([within] if within else [])]
    if many > refine_over * REFINE_ALL:
        keyed = [k.select(*own, F.explode(fine).alias("k")) for k in keyed]
    elif many > refine_over:
        counted = keyed[0].groupBy(*by).agg(F.count("*").alias("n")).union(keyed[1].groupBy(*by).agg(F.count("*").alias("n")))
        hot = F.broadcast(counted.where(F.col("n") > refine_over).select(*by).distinct().withColumn("hot", F.lit(True)))
        keyed = [k.join(hot, by, "left").select(*own, F.explode(F.when(F.col("hot"), fine).otherwise(plain)).alias("k")) for k in keyed]
    else:
        keyed = [k.select(*own, F.explode(plain).alias("k")) for k in keyed]
    ends = [k.select(F.col("bits").alias(f"{name}_bits"), *own[1:], "k.part", "k.at") for k, name in zip(keyed, ("left", "right"), strict=True)]
    apart = F.col("left_bits").bitwiseXOR(F.col("right_bits"))
    j = ends[0].join(ends[1], ["part", "at", *own[1:]]).withColumn("_apart", apart).withColumn("distance", F.bit_count("_apart")).where(F.col("distance") <= radius)
    # The first block, and in a refined one the first piece, in which a pair agrees: of which the difference has no bits.
    first = F.lit(len(bounds) - 1) * n
    for i in range(len(bounds) - 1, -1, -1):
        piece = F.lit(n - 1)
        for k, v in reversed(list(enumerate(pieces(F.col("_apart"), *bounds[i], n)))):
            piece = F.when(v == 0, k).otherwise(piece)
        mine = F.lit(i * n) + F.when(F.col("part") >= len(bounds) * n, piece).otherwise(0)
        first = mine if i == len(bounds) - 1 else F.when(block_value("_apart", *bounds[i]) == 0, mine).otherwise(first)
    return j.where(first == F.col("part") % (len(bounds) * n)).select("left_bits", "right_bits", "distance", *own[1:])


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, component (its least node) of undirected edges (a, b), by passing on the least label known.

    Labels also jump to the label of the node they name, so the rounds grow with the logarithm of the longest chain; a
    label can only fall, so they end.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct()
    both = scratch.keep(both, "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "heard").alias("new"))
        root = labels.select(F.col("node").alias("new"), F.col("component").alias("up"))
        after = scratch.keep(step.join(root, "new", "left").select("node", "component", F.least("new", F.coalesce("up", "new")).alias("new")), "labels")
        scratch.drop(labels)
        if after.where("new < component").isEmpty():
            return after.select("node", F.col("new").alias("component"))
        labels = scratch.keep(after.select("node", F.col("new").alias("component")), "labels")
        scratch.drop(after)


#: Open pairs that one task may settle in order.
LAST_PAIRS = 100_000


def leaders(rows: DataFrame, pairs: DataFrame, scratch: Scratch | None = None, last_pairs: int = LAST_PAIRS) -> DataFrame:
    """id, kept: in the order of id (of any type that has one), a row is kept if no kept row is paired with it (a, b).

    Decided in rounds: a row all of whose earlier partners are dropped is kept; a row with a kept earlier partner is
    dropped. A round settles at least the earliest open row of every cluster, in all clusters at once. Once no more than
    last_pairs are open, one task settles them in order; long chains, which would take a round per kept row, end there.
    """
    scratch = scratch or Scratch(rows.sparkSession, "leaders")
    ordered = pairs.select(F.least("a", "b").alias("before"), F.greatest("a", "b").alias("after")).where("before < after").distinct()
    open_ = scratch.keep(ordered, "open")
    dropped: list[DataFrame] = []
    while (left := open_.count()) > last_pairs:
        # rows that are not after any open row are kept; what comes after them is dropped
        kept = open_.select(F.col("before").alias("id")).distinct().join(open_.select(F.col("after").alias("id")), "id", "left_anti")
        gone = scratch.keep(open_.join(kept, F.col("before") == F.col("id"), "left_semi").select(F.col("after").alias("id")).distinct(), "gone")
        rest = open_.join(gone, F.col("before") == F.col("id"), "left_anti").join(gone, F.col("after") == F.col("id"), "left_anti")
        after = scratch.keep(rest.join(kept, F.col("before") == F.col("id"), "left_anti"), "open")
        scratch.drop(open_)
        open_ = after
        # The tables of dropped rows are merged as runs are: never more of them than the logarithm of the rounds.
        dropped.append(gone)
        if len(dropped) >= 8:
            all_gone = dropped[0]
            for g in dropped[1:]:
                all_gone = all_gone.union(g)
            merged = scratch.keep(all_gone, "gone")
            for g in dropped:
                scratch.drop(g)
            dropped = [merged]
    if left:
        dropped.append(scratch.keep(open_.coalesce(1).mapInPandas(_settle, f"id {open_.schema['before'].dataType.simpleString()}"), "gone"))
    gone = open_.select(F.col("after").alias("id")).limit(0)
    for g in dropped:
        gone = gone.union(g)
    return rows.select("id").join(gone.distinct().withColumn("_gone", F.lit(True)), "id", "left").select("id", F.col("_gone").isNull().alias("kept"))


def _settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows that are dropped, of pairs (before, after) that are few enough for one task."""
    later: dict[int, list[int]] = {}
    for pdf in frames:
        for a, b in zip(pdf["before"].tolist(), pdf["after"].tolist(), strict=True):
            later.setdefault(a, []).append(b)
    gone: set[int] = set()
    for a in sorted(later):
        if a not in gone:
            gone.update(later[a])
    yield pd.DataFrame({"id": sorted(gone)})
