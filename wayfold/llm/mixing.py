"""Problem 9: records of several sources combined so that each source has its target share of all tokens.

The total is the largest at which no source has to be repeated more often than it may be (or a given smaller one). A
source first contributes complete epochs, each record once per epoch; the rest of its budget is a weighted sample without
replacement after Efraimidis and Spirakis: every record draws an exponential key scaled by its quality, and the records
with the least keys are taken until their prefix sum reaches the budget.

How it scales. No source is sorted as a whole. Keys are cut into ranges, first by their logarithm (64 to an octave, a few
thousand in all, whatever the qualities are), then the range in which the budget of a source ends into FAN ranges again,
until it has no more than `range_rows` records. Sums per source and range, of which there are never more than a few
thousand to a source, show where the budget ends; only that range is put in order, in one task per source. A source with
a third of all rows is spread over its ranges. What is broadcast has one row per source of the target table.

Null and empty texts have no tokens and are never chosen. A source that is not in the targets contributes nothing. A
target source without any tokens is left out, and the other shares grow in proportion. A repeat limit that is null counts
as 1. A quality that is null or below LEAST_QUALITY counts as that. Repeated rows are records of their own, but have one
draw: copies of one doc_id stay in one range. Draws depend on doc_id and the seed only, so a run can be repeated; ties
go to the lower doc_id. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal
from ..session import Scratch
from .tokens import VOCABULARY, measured


LEAST_QUALITY = 0.01
#: Ranges into which the range is cut in which a budget ends.
FAN = 4096


def solid_share() -> Column:
    """The quality used where none is given: from 0.2 to 1 with the share of letters and digits among the characters that
    are not blanks, so that tables, rules and markup weigh less than prose."""
    text = F.col("text")
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    return 0.2 + 0.8 * F.coalesce(F.try_divide(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), solid), F.lit(0.0))


def sized_records(documents: DataFrame, vocabulary: str = VOCABULARY, quality: Column | None = None) -> DataFrame:
    """doc_id, source, quality, tokens of every document with tokens. quality: any expression over the documents' columns."""
    weight = F.greatest(F.coalesce(F.nanvl((solid_share() if quality is None else quality).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(LEAST_QUALITY))
    columns = {"doc_id": F.col("doc_id").cast("long"), "source": normal.key("source"), "quality": weight}
    return measured(documents, columns, vocabulary).where("tokens > 0")


def _targets(targets: DataFrame) -> DataFrame:
    t = targets.select(normal.key("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("max_repeats"))
    return t.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def budgets(records: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """source, target_share, max_repeats, available, share, budget, epochs, rest (tokens to sample beyond the epochs)."""
    held = records.groupBy("source").agg(F.sum("tokens").alias("available"))
    t = _targets(targets).join(held, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    everything = Window.partitionBy()  # over the target table: one row per source
    there = F.when(F.col("available") > 0, F.col("target_share"))
    t = t.withColumn("share", F.coalesce(F.try_divide(there, F.sum(there).over(everything)), F.lit(0.0)))
    most = F.min(F.when(F.col("share") > 0, F.col("available") * F.col("max_repeats") / F.col("share"))).over(everything)
    size = most if total is None else F.lit(float(total))
    budget = F.least(F.floor(F.coalesce(size, F.lit(0.0)) * F.col("share") + 1e-6).cast("long"), F.col("available") * F.col("max_repeats"))
    t = t.withColumn("budget", budget)
    epochs = F.coalesce(F.call_function("div", F.col("budget"), F.nullif(F.col("available"), F.lit(0))), F.lit(0)).cast("long")
    return t.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))


def mixture(
    documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 11, vocabulary: str = VOCABULARY, range_rows: int = 5000, quality: Column | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """doc_id, source, tokens, repeats of the chosen records; repeats is at least 1 and at most the source's limit."""
    scratch = scratch or Scratch(documents.sparkSession, "mixing")
    records = scratch.keep(sized_records(documents, vocabulary, quality), "records")
    plan = scratch.keep(budgets(records, targets, total), "budgets")
    drawn = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(2**53)
    # A broadcast of one row per source in the target table.
    keyed = records.withColumn("draw", -F.log(drawn) / F.col("quality")).join(F.broadcast(plan.select("source", "epochs", "rest")), "source")
    # Where the budget of each source ends: at `below` all smaller keys are taken; from there to `last` lies the cut.
    edges = scratch.keep(_edges(keyed.withColumn("range", F.floor(F.log2("draw") * 64)).withColumn("start", F.lit(0).cast("long"))), "edges")
    while (edges.agg(F.max(F.when(F.col("below") < F.col("last"), F.col("n")))).first()[0] or 0) > range_rows:
        coarse = (F.col("n") > range_rows) & (F.col("below") < F.col("last"))
        inside = keyed.join(F.broadcast(edges.where(coarse).drop("n")), "source").where("draw >= below and draw <= last")
        step = F.floor((F.col("draw") - F.col("below")) / (F.col("last") - F.col("below")) * FAN)
        edges = scratch.keep(edges.where(~coarse).union(_edges(inside.withColumn("range", F.least(step, F.lit(FAN - 1))))), "edges")
    placed = keyed.join(F.broadcast(edges), "source")
    whole = placed.where((F.col("draw") < F.col("below")) | (F.col("draw") > F.col("last"))).withColumn("taken", F.col("draw") < F.col("below"))
    cut = placed.where("draw >= below and draw <= last").select("doc_id", "source", "tokens", "epochs", "draw", (F.col("rest") - F.col("start")).alias("left"))
    filled = cut.groupBy("source").applyInPandas(_fill, "doc_id long, source string, tokens long, epochs long, taken boolean")
    names = ["doc_id", "source", "tokens", "epochs", "taken"]
    return whole.select(*names).union(filled).select("doc_id", "source", "tokens", (F.col("epochs") + F.col("taken").cast("long")).alias("repeats")).where("repeats > 0")


def _edges(ranged: DataFrame) -> DataFrame:
    """source, below, last, start, n: the range in which the budget ends, with the tokens before it and its records.

    If the budget ends with a range, the cut is the next one; if it takes all, the cut is beyond every key (n = 0).
    """
    sums = ranged.groupBy("source", "range").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.min("draw").alias("low"), F.max("draw").alias("high"), F.first("rest").alias("rest"), F.first("start").alias("start"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("end", F.col("start") + F.sum("tokens").over(upto)).withColumn("begin", F.col("end") - F.col("tokens"))
    first = F.min(F.when(F.col("end") > F.col("rest"), F.struct("range", "low", "high", "begin", "n")))
    e = sums.groupBy("source").agg(first.alias("cut"), F.max("end").alias("all"))
    beyond = F.lit(float("inf"))
    return e.select("source", F.coalesce("cut.low", beyond).alias("below"), F.coalesce("cut.high", beyond).alias("last"), F.coalesce("cut.begin", "all").alias("start"), F.coalesce("cut.n", F.lit(0)).alias("n"))


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """In the range where the budget ends, each record in order that still fits; so one long record does not leave the
    source far from its share."""
    pdf = pdf.sort_values(["draw", "doc_id"], kind="stable")
    left, taken = int(pdf["left"].iloc[0]) if len(pdf) else 0, []
    for size in pdf["tokens"].tolist():
        taken.append(size <= left)
        left -= size if taken[-1] else 0
    return pdf.assign(taken=taken)[["doc_id", "source", "tokens", "epochs", "taken"]]


def share_report(documents: DataFrame, targets: DataFrame, scratch: Scratch | None = None, **how) -> DataFrame:
    """source, target_share, max_repeats, n_records, most_repeats, tokens, reached_share, deviation (from the target, in
    proportion if some target sources have no tokens)."""
    scratch = scratch or Scratch(documents.sparkSession, "mixing")
    chosen = mixture(documents, targets, scratch=scratch, **how)
    per = chosen.groupBy("source").agg(F.count("*").alias("n_records"), F.max("repeats").alias("most_repeats"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = _targets(targets).join(per, "source", "left").select("source", "target_share", "max_repeats", zero("n_records"), zero("most_repeats"), zero("tokens"))
    everything = Window.partitionBy()  # one row per source of the target table
    out = out.withColumn("reached_share", F.coalesce(F.try_divide("tokens", F.sum("tokens").over(everything)), F.lit(0.0)))
    wanted = F.coalesce(F.try_divide(F.when(F.col("tokens") > 0, F.col("target_share")), F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(everything)), F.lit(0.0))
    return out.withColumn("deviation", F.col("reached_share") - wanted)


def invariants(documents: DataFrame, targets: DataFrame, scratch: Scratch | None = None, **how) -> DataFrame:
    """Per source of the targets what has to hold: n_beyond (records repeated more often than allowed), n_twice (records
    chosen in several rows), near (whether its share is within half a per cent of the whole, or one record of the source)."""
    scratch = scratch or Scratch(documents.sparkSession, "mixing")
    chosen = scratch.keep(mixture(documents, targets, scratch=scratch, **how), "chosen")
    t = _targets(targets)
    per = chosen.join(F.broadcast(t.select("source", "max_repeats")), "source").groupBy("source", "doc_id").agg(F.count("*").alias("rows"), F.count_if(F.col("repeats") > F.col("max_repeats")).alias("beyond"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("tokens").alias("longest"))
    per = per.groupBy("source").agg(F.sum("beyond").alias("n_beyond"), F.count_if(F.col("rows") > 1).alias("n_twice"), F.sum("tokens").alias("tokens"), F.max("longest").alias("longest"))
    everything = Window.partitionBy()
    there = F.when(F.col("tokens") > 0, F.col("target_share"))
    share = F.coalesce(F.try_divide("tokens", F.sum("tokens").over(everything)), F.lit(0.0)) - F.coalesce(there / F.sum(there).over(everything), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return t.join(per, "source", "left").select("source", "target_share", "max_repeats", zero("n_beyond"), zero("n_twice"), (F.abs(share) <= 0.005 + F.coalesce(F.col("longest") / F.sum("tokens").over(everything), F.lit(0.0))).alias("near"))
