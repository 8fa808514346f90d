"""Problem 2: one surviving record per group of duplicates, each field with the value of the best row.

Token-level consensus: the values that a group holds of a field are cut into tokens and aligned one after another, the
weightiest first, into columns; in each column the tokens are voted on by weight, and the value nearest to the outcome,
among those that occur, is the survivor's.

The weight of a row is a trust prior times a recency decay, shared among the rows of equal standing: TRUST_STEP for each
rank of trust in the group above its own, and RECENCY_STEP for being older than the latest row and again for each
HALF_LIFE_DAYS between them. With steps of 0.5 and 0.3 all rows that are older than the latest one weigh less, together,
than 0.5^0 * 0.3^0 = 1 (2 * 0.3 / 0.7 = 0.86), so a row that is alone the latest and that none outranks has more than half
of all weight and decides every column, whatever the number of others. Where no row is such, values add up, and the row
of highest trust, or the latest, can be outvoted.

How it scales. Groups are reduced by partial aggregates in one shuffle: a field of which a group holds one value is
settled by that. Only fields on which a group disagrees are voted on, from counts per value, rank and day, so a crop with
a third of all rows arrives as a few rows. Identifiers, of which a group may hold as many as rows, are not voted on but
come from the best row that has one. A vote over more than VOTERS values is held in blocks of values by hash, and again
among the winners of the blocks with the weight of their blocks.

Nulls, blanks and filler words are no values; a field without any value stays null. Rows without a hash are each a crop of
their own. A source that is missing or not ranked has trust 0; a missing review time is the oldest. Of rows reviewed at
the very latest time, equal ones (value and trust) count once as such, the others as older ones. Ties, also of weights too small for a number, go to higher
trust, then to the later review, the more frequent value, the lower row number. Repeated rows count again as support.
Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal
from ..session import Scratch

FIELDS = ("body_type", "color", "crop_quality", "viewpoint")
#: What a survivor is built from, where the columns exist: labels, flags (as true or false) and other words of a vocabulary, ...
FLAGS = ("blur", "occluded", "truncated", "night", "body_type_supervised", "color_supervised")
WORDS = ("stage177_scene_label", "source_license", "review_status", "split", "source_dataset", "review_method")
#: ... and identifiers, which come from the best row that has one.
KEYS = ("camera_id", "video_id", "track_group", "source_group", "source_frame_id", "source_manifest")
#: What belongs to one row and is not voted on, but comes from the best row as it stands there (null where missing) ...
CARRIED = ("image_path", "annotation_source", "reviewed_at_ms", "stage177_exact_duplicate_of", "stage177_near_duplicate_of", "stage177_read_error")
#: ... or, as it is measured on the picture, from the best row that has it: the hash as 16 digits, the luma as a number.
MEASURED = ("stage177_dhash64", "stage177_mean_luma")
#: The dealt flags are unreliable; they are settled anew for the survivor.
SETTLED = ("stage177_label_conflict", "stage177_dedup_eligible", "stage177_effective_representative")
TRUST_STEP, RECENCY_STEP, HALF_LIFE_DAYS = 0.5, 0.3, 90
#: Values of one group and field that are aligned at a time.
VOTERS = 500
DAY_MS = 86_400_000
_TOKENS = re.compile(r"[^\W_]+")


def consensus(values: tuple[str, ...], weights: tuple[float, ...]) -> int:
    """The position of the value closest to the weighted consensus of all; of equal ones the weightier, then the first."""
    return _remembered(values, weights) if len(values) <= 8 else _consensus(values, weights)


def _consensus(values: tuple[str, ...], weights: tuple[float, ...]) -> int:
    columns: list[dict[str, float]] = []  # token -> weight
    tokens = [_TOKENS.findall(v) or [v] for v in values]
    placed: dict[int, list[int]] = {}
    held = 0.0
    for k in sorted(range(len(values)), key=lambda k: -weights[k]):
        words, weight = tokens[k], weights[k]
        path = _align(columns, words, held)
        merged: list[dict[str, float]] = []
        moved: dict[int, int] = {}
        at: list[int] = []
        for column, word in path:
            if column is not None:
                moved[column] = len(merged)
            merged.append(columns[column] if column is not None else {})
            if word is not None:
                at.append(len(merged) - 1)
                merged[-1][words[word]] = merged[-1].get(words[word], 0.0) + weight
        placed = {i: [moved[c] for c in p] for i, p in placed.items()} | {k: at}
        columns, held = merged, held + weight
    voted: list[str | None] = []
    for column in columns:
        gap = held - sum(column.values())
        token = max(sorted(column), key=lambda t: column[t])
        voted.append(token if column[token] >= gap else None)

    def distance(k: int) -> int:
        """Columns in which a value differs from the outcome."""
        own = dict(zip(placed[k], tokens[k], strict=True))
        return sum(own.get(c) != voted[c] for c in range(len(columns)))

    return min(range(len(values)), key=lambda k: (distance(k), -weights[k], k))


_remembered = lru_cache(maxsize=4096)(_consensus)


def _align(columns: list[dict[str, float]], words: list[str], held: float) -> list[tuple[int | None, int | None]]:
    """Pairs (column, word) of the best global alignment; a gap costs half of what a full match earns."""
    n, m = len(columns), len(words)
    gap = -0.5
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        score[i][0] = i * gap
    for j in range(1, m + 1):
        score[0][j] = j * gap
    fit = lambda i, j: columns[i].get(words[j], 0.0) / held if held else 0.0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            score[i][j] = max(score[i - 1][j - 1] + fit(i - 1, j - 1), score[i - 1][j] + gap, score[i][j - 1] + gap)
    out: list[tuple[int | None, int | None]] = []
    i, j = n, m
    while i or j:
        if i and j and score[i][j] == score[i - 1][j - 1] + fit(i - 1, j - 1):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and score[i][j] == score[i - 1][j] + gap:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


_CHOSEN = ("content", "field", "value", "weight", "n", "trust", "reviewed", "row", "n_values", "latest_row", "latest_value", "latest_trust", "top_trust")


def _vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by group, field, block and standing; keeps the chosen row of each, with the weight of all of them."""
    ballot: tuple | None = None
    held: list[tuple] = []
    out: list[tuple] = []

    def frame() -> pd.DataFrame:
        made = pd.DataFrame(out, columns=list(_CHOSEN)).astype({c: "Int64" for c in ("reviewed", "latest_row")})
        out.clear()
        return made

    def close() -> None:
        if held:
            weights = tuple(r[4] for r in held)
            r = held[consensus(tuple(r[3] for r in held), weights)]
            out.append((r[0], r[1], r[3], sum(weights), *r[5:]))

    for pdf in frames:
        for c in ("reviewed", "latest_row"):
            pdf[c] = pdf[c].astype("Int64").astype(object).where(pdf[c].notna(), None)
        for r in zip(*[pdf[c] for c in ("content", "field", "block", *_CHOSEN[2:])], strict=True):
            if r[:3] != ballot:
                close()
                ballot, held = r[:3], []
            held.append(r)
        if len(out) >= 10_000:
            yield frame()
    close()
    yield frame()


def _value(field: str) -> Column:
    if field in FLAGS:
        return normal.flag(field).cast("string")
    if field == "split":
        return normal.split_name(field)
    if field == "source_manifest":
        return normal.path(field)
    return normal.color(field) if field == "color" else normal.label(field)


def _own(manifest: DataFrame) -> dict[str, Column]:
    """What a row has of CARRIED and MEASURED, and the labels it was supervised for, by the name _own.<column> takes."""
    has = manifest.columns
    own = {c: F.when(normal.key(F.col(c).cast("string")).isNotNull(), F.col(c)) for c in CARRIED if c in has}
    if "annotation_source" in own:
        own["annotation_source"] = normal.key("annotation_source")
    if "stage177_dhash64" in has:
        own["stage177_dhash64"] = F.lower(F.lpad(F.hex(normal.bits64("stage177_dhash64")), 16, "0"))
    if "stage177_mean_luma" in has:
        own["stage177_mean_luma"] = F.col("stage177_mean_luma").try_cast("double")
    for head in ("body_type", "color"):
        flag = f"{head}_supervised"  # a row without the flag counts as supervised
        counts = normal.key(flag).isNull() | F.coalesce(normal.flag(flag), F.lit(False)) if flag in has else F.lit(True)
        own[f"signed_{head}"] = F.when(counts, _value(head))
    return own


def _standing() -> list[Column]:
    return [F.col("trust"), F.coalesce("reviewed", F.lit(-1)).alias("reviewed_or"), (-F.col("row")).alias("minus_row")]


def _best(value: Column) -> Column:
    """The value of the best row of a group that has one."""
    return F.max(F.when(value.isNotNull(), F.struct(*_standing(), value.alias("x")))).getField("x")


def _settled(read: Column, conflict: Column) -> list[Column]:
    kept = read & ~conflict
    return [c.alias(n) for n, c in zip(SETTLED, (conflict, kept, kept), strict=True)]


def crop_rows(manifest: DataFrame, trust: DataFrame, fields: tuple[str, ...] = FIELDS, own: bool = False) -> DataFrame:
    """row, content (32 bytes; the hash of the text if it is no SHA-256), trust, reviewed, and the fields in normal form.

    own: with a struct of what belongs to the row itself.
    """
    rank = trust.select(normal.key("annotation_source").alias("source"), F.col("trust_rank").cast("int").alias("rank")).where("source is not null").groupBy("source").agg(F.max("rank").alias("rank"))
    content = normal.digest("stage177_pixel_sha256")
    rows = manifest.select(
        F.col("stage177_row_number").cast("long").alias("row"), F.when(content.rlike("^[0-9a-f]{64}$"), F.unhex(content)).otherwise(F.unhex(F.sha2(content, 256))).alias("content"),
        normal.key("annotation_source").alias("source"), F.col("reviewed_at_ms").cast("long").alias("reviewed"), *[_value(f).alias(f) for f in fields],
        *([F.struct(*[c.alias(n) for n, c in _own(manifest).items()]).alias("own")] if own else []),
    ).where("row is not null")
    return rows.join(rank, "source", "left").select("row", "content", F.coalesce("rank", F.lit(0)).alias("trust"), "reviewed", *fields, *(["own"] if own else []))


def crops(rows: DataFrame, fields: tuple[str, ...], more: list[Column]) -> DataFrame:
    """One row per content: n_rows, the only value of each field (null if there is none or several), disputed (the fields
    of which there are several), and more aggregates."""
    low, high = (lambda f: F.col(f"low_{f}")), (lambda f: F.col(f"high_{f}"))
    ends = [a for f in fields for a in (F.min(f).alias(f"low_{f}"), F.max(f).alias(f"high_{f}"))]
    known = rows.where("content is not null")
    # Crops of more than a thousandth of all rows, fewer than 1,000 by arithmetic, are aggregated before they are shuffled.
    # All others go as rows: these are smaller than what would be aggregated of them, as most crops have one or two.
    limit = max(1000, known.count() // 1000)
    hot = known.groupBy("content").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("content")
    grouped = lambda part: part.groupBy("content").agg(F.count("*").alias("n_rows"), *ends, *more)
    g = grouped(known.join(F.broadcast(hot), "content", "left_anti").repartition("content")).union(grouped(known.join(F.broadcast(hot), "content", "left_semi")))
    named = [c for c in g.columns if not c.startswith(("low_", "high_")) and c != "content"]
    disputed = F.array_compact(F.array(*[F.when(low(f) != high(f), F.lit(f)) for f in fields]))
    return g.select("content", *named, *[F.when(low(f) == high(f), low(f)).alias(f) for f in fields], disputed.alias("disputed"))


def ballots(rows: DataFrame, disputed: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The values voted on, one row per crop, disputed field and value: weight, n, and its best row; n_values; and of the
    whole group latest_row (null if several rows are the latest), latest_value, latest_trust and top_trust."""
    value = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    wanted = F.filter(value, lambda x: F.array_contains("disputed", x["field"]) & x["value"].isNotNull())
    long = rows.join(disputed.select("content", "disputed"), "content").select("content", "row", "trust", "reviewed", F.explode(wanted).alias("x")).select("content", "row", "trust", "reviewed", "x.field", "x.value")
    day = F.call_function("div", F.col("reviewed"), F.lit(DAY_MS))
    cells = long.groupBy("content", "field", "value", "trust", day.alias("day")).agg(
        F.count("*").alias("n"), F.max(F.struct("reviewed", "row")).alias("late"), F.max(F.struct("reviewed", (-F.col("row")).alias("minus_row"))).alias("other")
    )
    group, level = Window.partitionBy("content", "field"), Window.partitionBy("content", "field", "trust", "age")
    known = cells.select(
        "*", F.max("trust").over(group).alias("top_trust"), F.max(F.struct("late.reviewed", "late.row", "trust", "value")).over(group).alias("latest"), F.max("other").over(group).alias("latest_other"),
        (F.dense_rank().over(group.orderBy(F.desc("trust"))) - 1).alias("below"),
    )
    at_top = F.coalesce(F.col("late.reviewed") == F.col("latest.reviewed"), F.lit(False))
    old = 1 + F.coalesce(F.call_function("div", F.call_function("div", F.col("latest.reviewed"), F.lit(DAY_MS)) - F.col("day"), F.lit(HALF_LIFE_DAYS)), F.lit(1000))
    n_old = F.col("n") - at_top.cast("long")
    parts = F.filter(F.array(F.when(at_top, F.struct(F.lit(0).cast("long").alias("age"), F.lit(1).cast("long").alias("part"))), F.when(n_old > 0, F.struct(old.cast("long").alias("age"), n_old.alias("part")))), lambda x: x.isNotNull())
    aged = known.select("*", F.explode(parts).alias("p")).select("*", "p.age", "p.part")
    prior = F.pow(F.lit(TRUST_STEP), F.col("below")) * F.pow(F.lit(RECENCY_STEP), F.col("age"))
    weighed = aged.withColumn("weight", prior * F.col("part") / F.sum("part").over(level))
    unique = F.col("latest.reviewed").isNotNull() & (F.col("latest.row") == -F.col("latest_other.minus_row"))
    best = F.max(F.struct("trust", F.coalesce("other.reviewed", F.lit(-1)).alias("reviewed"), F.col("other.minus_row").alias("minus_row")))
    per_value = weighed.groupBy("content", "field", "value").agg(
        F.sum("weight").alias("weight"), F.sum("part").alias("n"), best.alias("best"), F.first(F.when(unique, F.col("latest.row"))).alias("latest_row"), F.first("latest.value").alias("latest_value"),
        F.first("latest.trust").alias("latest_trust"), F.first("top_trust").alias("top_trust"),
    )
    per_value = per_value.withColumn("n_values", F.count(F.lit(1)).over(group).cast("int"))
    return per_value.select("content", "field", "value", "weight", "n", F.col("best.trust").alias("trust"), F.col("best.reviewed").alias("reviewed"), (-F.col("best.minus_row")).alias("row"), *_CHOSEN[8:])


def chosen_values(rows: DataFrame, disputed: DataFrame, scratch: Scratch, fields: tuple[str, ...] = FIELDS, voters: int = VOTERS) -> DataFrame:
    """_CHOSEN: the outcome per crop and disputed field, with the best row that holds the value."""
    votes = scratch.keep(ballots(rows, disputed, fields), "ballots")
    schema = votes.schema
    most = votes.agg(F.max("n_values")).first()[0] or 0
    while True:
        # Votes over few values are held at once; those over many in blocks, whose winners stand again.
        blocks = F.ceil(F.col("n_values") / F.lit(voters)).cast("int")
        ballot = votes.withColumn("block", F.when(F.lit(most > voters), F.pmod(F.xxhash64("value"), blocks)).otherwise(F.lit(0)).cast("int"))
        order = ["content", "field", "block", F.desc("trust"), F.desc("reviewed"), F.desc("n"), "row", "value"]
        votes = ballot.repartition("content", "field", "block").sortWithinPartitions(*order).mapInPandas(_vote, schema)
        if most <= voters:
            return votes
        n_values = F.count(F.lit(1)).over(Window.partitionBy("content", "field")).cast("int")
        votes = scratch.keep(votes.withColumn("n_values", n_values).select(*_CHOSEN), "winners")
        schema = votes.schema
        most = votes.agg(F.max("n_values")).first()[0]


def clear_cases(manifest: DataFrame, trust: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """stage177_row_number, field_name: the consensus is the value of the one latest row, which no other outranks."""
    scratch = scratch or Scratch(manifest.sparkSession, "survivors")
    rows = scratch.keep(crop_rows(manifest, trust).where("content is not null"), "crops")
    disputed = crops(rows, FIELDS, []).where(F.size("disputed") > 0)
    c = chosen_values(rows, disputed, scratch).where("value = latest_value and latest_row is not null and latest_trust = top_trust")
    return c.select(F.col("latest_row").alias("stage177_row_number"), F.col("field").alias("field_name")).distinct()


def survivors(manifest: DataFrame, trust: DataFrame, fields: tuple[str, ...] | None = None, scratch: Scratch | None = None, voters: int = VOTERS) -> DataFrame:
    """One row per crop: pixel_sha256, the representative's row number, n_rows, the fields, n_disputed fields, then KEYS,
    CARRIED, MEASURED and SETTLED.

    A crop is in conflict if its rows hold two body types or two colors that they were supervised for; it is eligible and
    represented by the survivor if it is not in conflict and its best row was read without error.
    fields: by default those of FIELDS, FLAGS and WORDS that the manifest has. Rows without a hash follow as crops of their
    own, with pixel_sha256 null and their own values.
    """
    has = manifest.columns
    fields = fields or tuple(f for f in FIELDS + FLAGS + WORDS if f in has)
    keys = tuple(k for k in KEYS if k in has and k not in fields)
    scratch = scratch or Scratch(manifest.sparkSession, "survivors")
    rows = scratch.keep(crop_rows(manifest, trust, (*fields, *keys), own=True), "rows")
    names = rows.schema["own"].dataType.names
    carried, measured = ([n for n in of if n in names] for of in (CARRIED, MEASURED))
    signed = ("signed_body_type", "signed_color")
    best_row = F.max(F.struct(*_standing(), *[F.col(f"own.{n}").alias(n) for n in carried])).alias("best")
    differ = [F.coalesce(F.min(f"own.{s}") != F.max(f"own.{s}"), F.lit(False)) for s in signed]
    more = [best_row, (differ[0] | differ[1]).alias("conflict"), *[_best(F.col(k)).alias(k) for k in keys], *[_best(F.col(f"own.{n}")).alias(n) for n in measured]]
    grouped = scratch.keep(crops(rows, fields, more), "crops")
    chosen = chosen_values(rows, grouped.where(F.size("disputed") > 0), scratch, fields, voters)
    won = chosen.groupBy("content").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("won"))  # at most one entry per field
    read = lambda head: F.col(f"{head}stage177_read_error").isNull() if "stage177_read_error" in carried else F.lit(True)
    once = grouped.join(won, "content", "left").select(
        F.lower(F.hex("content")).alias("pixel_sha256"), (-F.col("best.minus_row")).alias("representative"), "n_rows", *[F.coalesce(f, F.col("won")[f]).alias(f) for f in fields], F.size("disputed").alias("n_disputed"),
        *keys, *[F.col(f"best.{n}").alias(n) for n in carried], *measured, *_settled(read("best."), F.col("conflict")),
    )
    alone = rows.where("content is null").select(
        F.lit(None).cast("string").alias("pixel_sha256"), F.col("row").alias("representative"), F.lit(1).cast("long").alias("n_rows"), *fields, F.lit(0).alias("n_disputed"),
        *keys, *[F.col(f"own.{n}").alias(n) for n in (*carried, *measured)], *_settled(read("own."), F.lit(False)),
    )
    return once.union(alone)
