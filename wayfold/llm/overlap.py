"""Problem 1: the same or nearly the same record in the training split and in an evaluation split.

Records are identified by a content hash (equal or not) and by a 64-bit perceptual hash (near if at most `radius` bits
differ). Shards of a full-text index hold the codes of the evaluation records as symbols, one per block of bits, rotated
so that the block of the shard comes last; the codes of the training records stream through backward search. The search
starts with that block and goes on backwards, block by block, which gives the maximal match of each pair that ends there;
a match that could be continued forwards belongs to another shard. Pairs whose bits differ too much are dropped, and the
maximal matches of a pair are merged: their bits add up to its span, their number is its count. Content hashes are
matched whole.

How it scales. Only distinct codes are searched, so a code that holds a third of all rows costs as much as any other.
With radius + 1 blocks of bits, two codes in reach agree in one block at least; a code goes to the shards of its blocks
and nowhere else. Block values that many evaluation codes share are refined: one block being equal, the differing bits
lie in the other 51, which are cut into radius + 1 pieces again, so that the shards of a hot value spread over 2^10
times as many keys. Keys, refined or not, that still hold many codes of either side are cut by salts on both sides: an
evaluation code goes to one row of a grid, a training code to one column, and a task has one cell. The table of block
values is broadcast; it has at most 5 x 2^13 rows, plus 2^13 for content hashes, whatever the size of the input.

Nulls: a record without a hash has no match by that hash. Rows without a known split take no part. Repeated rows count
as rows but give each pair of row numbers once. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normal
from ..operators import similarity
from ..session import Scratch, partitions
from .fmindex import FMIndex, expand

TRAIN, EVALUATION = 1, 0
RADIUS = 4
#: (first bit, width) of the blocks of a perceptual hash, and the number under which content hashes are filed.
BLOCKS = tuple(similarity.block_bounds(RADIUS))
CONTENT = 5
REFINED = 8
#: Codes of one task.
TASK_CODES = 400_000
_MATCH = pa.schema([("train_code", pa.binary()), ("eval_code", pa.binary()), ("distance", pa.int32()), ("span", pa.int32())])
_MATCH_DDL = "train_code binary, eval_code binary, distance int, span int"


def records(manifest: DataFrame) -> DataFrame:
    """row, split, side, dataset, content (32 bytes), near (8 bytes); only rows of a known split.

    A content hash that is no SHA-256 is represented by the SHA-256 of its text.
    """
    split = normal.split_name("split")
    content = normal.digest("stage177_pixel_sha256")
    return manifest.select(
        F.col("stage177_row_number").cast("long").alias("row"),
        split.alias("split"),
        F.when(split == "train", TRAIN).when(split.isin("validation", "test"), EVALUATION).alias("side"),
        F.coalesce(normal.key("source_dataset"), F.lit("unknown")).alias("dataset"),
        F.when(content.rlike("^[0-9a-f]{64}$"), F.unhex(content)).otherwise(F.unhex(F.sha2(content, 256))).alias("content"),
        F.unhex(F.lpad(F.hex(normal.bits64("stage177_dhash64")), 16, "0")).alias("near"),
    ).where("side is not null")


def _symbols(codes: np.ndarray, seed: int) -> np.ndarray:
    """The codes as records of symbols, the symbol of the key last, so that backward search starts there."""
    if codes.dtype.itemsize == 32:  # a content hash: sixteen symbols of 16 bits
        return np.frombuffer(codes.tobytes(), ">u2").reshape(-1, 16).astype(np.int64) + 1
    bits = codes.view(">u8").astype(np.uint64)
    block = seed if seed < CONTENT else (seed - REFINED) // 5
    order = [(block + 1 + i) % 5 for i in range(5)]
    out = np.empty((len(bits), 5), np.int64)
    for j, b in enumerate(order):
        at, width = BLOCKS[b]
        out[:, j] = ((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) + 1 + (b << 13)
    return out


def _refined_value(bits: np.ndarray, seed: int) -> np.ndarray:
    """The piece of the bits outside the block by which a refined shard is keyed, as in similarity.pieces()."""
    block, piece = divmod(seed - REFINED, 5)
    at, width = BLOCKS[block]
    high = (bits >> np.uint64(at + width)) if at + width < 64 else np.zeros_like(bits)
    rest = (high << np.uint64(at)) | (bits & np.uint64((1 << at) - 1))
    start, w = similarity.piece_bounds(64 - width, 5)[piece]
    return ((rest >> np.uint64(start)) & np.uint64((1 << w) - 1)).astype(np.int64)


def _fixed(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Codes by their length in bytes: where they stand, and the codes."""
    lengths = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out[int(n)] = at, np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), f"S{n}").copy()
    return out


class _Shard:
    """The index over the evaluation codes of one key kind, and its search."""

    def __init__(self, seed: int, codes: np.ndarray):
        self.seed, self.codes = seed, codes
        self.index = FMIndex(self._text(codes))

    def _text(self, codes: np.ndarray) -> np.ndarray:
        """The symbols of the codes; in a refined shard the refined piece stands before the block."""
        symbols = _symbols(codes, self.seed)
        if self.seed < REFINED:
            return symbols
        piece = _refined_value(codes.view(">u8").astype(np.uint64), self.seed) + (1 << 20)
        return np.column_stack([symbols[:, :-1], piece, symbols[:, -1]])

    def matches(self, codes: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
        text = self._text(codes)
        if self.seed == CONTENT:
            _, low, high = self.index.search(text, least=16)
            for row, at in expand(low, high):
                yield _batch(codes[row], self.codes[self.index.record[at]], np.zeros(len(row), int), np.full(len(row), 16))
            return
        refined = self.seed >= REFINED
        block = (self.seed - REFINED) // 5 if refined else self.seed
        bits, own = codes.view(">u8").astype(np.uint64), self.codes.view(">u8").astype(np.uint64)
        # The intervals by length; in a refined shard the first two symbols are one step.
        found = list(self.index.intervals(text))[1 if refined else 0 :]
        if not found:
            return
        rows, records = [], []
        query, low, high = found[0]
        for at, position in expand(low, high):
            row, record = query[at], self.index.record[position]
            apart = bits[row] ^ own[record]
            keep = np.bitwise_count(apart) <= radius
            # A match that goes on forwards ends in another shard; of a match all round, one shard speaks.
            ahead, width = BLOCKS[(block + 1) % 5]
            keep &= ((apart >> np.uint64(ahead)) & np.uint64((1 << width) - 1) != 0) | ((apart == 0) & (block == 0))
            for k in range(self.seed - REFINED - block * 5) if refined else ():  # the first piece in which they agree
                keep &= _refined_value(bits[row], REFINED + block * 5 + k) != _refined_value(own[record], REFINED + block * 5 + k)
            rows.append(row[keep])
            records.append(record[keep])
        row, record = np.concatenate(rows), np.concatenate(records).astype(np.int64)
        if not len(row):
            return
        # How far each pair matches: the longest suffix in whose interval the record still is.
        pair = row * len(own) + record
        order = np.argsort(pair, kind="stable")
        row, record, pair = row[order], record[order], pair[order]
        length = np.ones(len(pair), np.int64)
        for n, (query, low, high) in enumerate(found[1:], 2):
            for at, position in expand(low, high):
                longer = query[at] * len(own) + self.index.record[position]
                place = np.minimum(np.searchsorted(pair, longer), len(pair) - 1)
                length[place[pair[place] == longer]] = n
        widths = np.cumsum([BLOCKS[(block - k) % 5][1] for k in range(5)])
        yield _batch(codes[row], self.codes[record], np.bitwise_count(bits[row] ^ own[record]), widths[length - 1])


def _batch(train: np.ndarray, found: np.ndarray, distance: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
    n = train.dtype.itemsize
    raw = lambda x: pa.Array.from_buffers(pa.binary(n), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([raw(train), raw(found), pa.array(distance.astype(np.int32)), pa.array(span.astype(np.int32))], schema=_MATCH)


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Evaluation codes come first in a partition; the index over them is built when the first training code comes."""
        import pyarrow.compute  # noqa: F401

        # By seed and salt: cells of one key must not meet, while of all other keys a code has one per seed.
        gathered: dict[tuple[int, int, int], list[np.ndarray]] = {}
        shards: dict[tuple[int, int, int], _Shard] | None = None
        for batch in batches:
            side = batch.column(0).to_numpy(zero_copy_only=False)
            cell = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) << 32 | batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            code = batch.column(2)
            for which in (EVALUATION, TRAIN):
                for c in np.unique(cell[side == which]):
                    at = np.flatnonzero((side == which) & (cell == c))
                    for n, (_, codes) in _fixed(code.take(pa.array(at))).items():
                        key = int(c) >> 32, int(c) & 0xFFFFFFFF, n
                        if which == EVALUATION:
                            gathered.setdefault(key, []).append(codes)
                            continue
                        if shards is None:
                            shards = {k: _Shard(k[0], np.concatenate(v)) for k, v in gathered.items()}
                            gathered.clear()
                        if key in shards:
                            yield from shards[key].matches(codes, radius)

    return run


def routes(codes: DataFrame, scratch: Scratch, radius: int = RADIUS, refine_over: int = 4096, salt_over: int = 100_000) -> tuple[DataFrame, int]:
    """Where each code goes: side, code, seed, value, salt; and the number of tasks for that."""
    bits = F.conv(F.hex("code"), 16, 10).cast("decimal(20,0)")
    signed = F.when(bits >= F.lit("9223372036854775808").cast("decimal(20,0)"), bits - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(bits).cast("long")
    wide = F.length("code") == 32
    coded = codes.withColumn("bits", F.when(~wide, signed))
    seeds = F.when(wide, F.array(F.struct(F.lit(CONTENT).alias("seed"), F.pmod(F.xxhash64("code"), F.lit(8192)).cast("long").alias("value")))).otherwise(
        F.array(*[F.struct(F.lit(b).alias("seed"), similarity.block_value("bits", *at).alias("value")) for b, at in enumerate(BLOCKS)])
    )
    keyed = coded.select("side", "code", "bits", F.explode(seeds).alias("k")).select("side", "code", "bits", "k.seed", "k.value")
    number = (F.count_if(F.col("side") == EVALUATION).alias("n_eval"), F.count_if(F.col("side") == TRAIN).alias("n_train"))
    # At most 6 x 2^13 rows, so it may be broadcast however large the input is.
    counts = scratch.keep(keyed.groupBy("seed", "value").agg(*number).where("n_eval > 0 and n_train > 0"), "block-values")
    planned = keyed.join(F.broadcast(counts), ["seed", "value"])
    refine = (F.col("seed") < CONTENT) & (F.col("n_eval") > refine_over)
    parts_of = lambda n: F.ceil(F.col(n) / F.lit(salt_over)).cast("int")
    plain = planned.where(~refine).select("side", "code", "seed", "value", parts_of("n_eval").alias("rows"), parts_of("n_train").alias("columns"))
    both = F.col("n_eval") * parts_of("n_train") + F.col("n_train") * parts_of("n_eval")
    said = counts.agg(F.sum(F.when(refine, 5 * (F.col("n_eval") + F.col("n_train"))).otherwise(both)).alias("sent"), F.count_if(refine).alias("n_refined")).first()
    sent = plain
    if said["n_refined"]:
        fine = None
        for b, (start, width) in enumerate(BLOCKS):
            keys = F.array(*[F.struct(F.lit(REFINED + b * 5 + k).alias("seed"), (F.col("value") * 2048 + v).alias("value")) for k, v in enumerate(similarity.pieces(F.col("bits"), start, width, 5))])
            fine = (F if fine is None else fine).when(F.col("seed") == b, keys)
        close = planned.where(refine).select("side", "code", F.explode(fine).alias("k")).select("side", "code", "k.seed", "k.value")
        # Refined keys that many codes share, as those of nearly flat pictures: a join that adaptive execution may split.
        heavy = close.groupBy("seed", "value").agg(*number).where(F.greatest("n_eval", "n_train") > salt_over)
        heavy = heavy.select("seed", "value", parts_of("n_eval").alias("rows"), parts_of("n_train").alias("columns"))
        one = lambda c: F.coalesce(c, F.lit(1)).alias(c)
        sent = plain.union(close.join(heavy, ["seed", "value"], "left").select("side", "code", "seed", "value", one("rows"), one("columns")))
    # The grid of a key: an evaluation code goes to all cells of its row, a training code to all of its column.
    at = lambda n: F.pmod(F.xxhash64("code", F.lit(7)), F.greatest(F.col(n), F.lit(1))).cast("int")
    across = F.transform(F.sequence(F.lit(0), F.greatest(F.col("columns"), F.lit(1)) - 1), lambda c: at("rows") * F.col("columns") + c)
    down = F.transform(F.sequence(F.lit(0), F.greatest(F.col("rows"), F.lit(1)) - 1), lambda w: w * F.col("columns") + at("columns"))
    cells = F.when(F.col("side") == EVALUATION, across).otherwise(down)
    parts = max(partitions(codes.sparkSession), -(-int(said["sent"] or 0) // TASK_CODES))
    return sent.select("side", "code", "seed", "value", F.explode(cells).alias("salt")), parts


def code_matches(codes: DataFrame, scratch: Scratch, radius: int = RADIUS, **how) -> DataFrame:
    """Matches between distinct codes: train_code, eval_code, distance in bits, span (bits of all maximal matches, or the
    16 symbols of a content hash), n_spans (maximal matches; a match round the end counts as one).

    codes: side, code (32 bytes for a content hash, 8 for a perceptual hash), each pair once. radius is at most 4.
    refine_over: evaluation codes of one block value above which it is refined; salt_over: codes of one side and key above
    which they are spread over salts. Neither changes the result.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError("radius must be between 0 and 4")
    sent, parts = routes(codes, scratch, radius, **how)
    routed = sent.repartition(parts, "seed", "value", "salt").sortWithinPartitions("side").select(F.col("side").cast("int"), F.col("seed").cast("int"), "code", "salt")
    m = scratch.keep(routed.mapInArrow(_search(radius), _MATCH_DDL), "maximal")
    near = m.where(F.length("train_code") == 8).groupBy("train_code", "eval_code").agg(F.min("distance").alias("distance"), F.sum("span").cast("int").alias("span"), F.count("*").cast("int").alias("n_spans"))
    return near.union(m.where(F.length("train_code") == 32).select("*", F.lit(1).alias("n_spans")))


def codes_of(found: DataFrame) -> DataFrame:
    """The distinct codes of both kinds on either side."""
    return found.select("side", F.explode(F.array_compact(F.array("content", "near"))).alias("code")).distinct()


def matched_codes(found: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """kind ('content' or 'near'), train_key, eval_key (as in records()), distance, span, n_spans."""
    m = code_matches(codes_of(found), scratch, **how)
    kind = F.when(F.length("train_code") == 32, "content").otherwise("near").alias("kind")
    return scratch.keep(m.select(kind, F.col("train_code").alias("train_key"), F.col("eval_code").alias("eval_key"), "distance", "span", "n_spans"), "matches")


def row_pairs(manifest: DataFrame, scratch: Scratch | None = None, **how) -> DataFrame:
    """row_a, row_b (row_a < row_b): each pair of a train row and an evaluation row that match, once."""
    scratch = scratch or Scratch(manifest.sparkSession, "overlap")
    r = scratch.keep(records(manifest).select("row", "side", "content", "near"), "records")
    m = matched_codes(r, scratch, **how)
    t = r.where(F.col("side") == TRAIN).select(F.col("row").alias("t"), F.col("content").alias("t_content"), F.col("near").alias("t_near"))
    e = r.where(F.col("side") == EVALUATION).select(F.col("row").alias("e"), F.col("content").alias("e_content"), F.col("near").alias("e_near"))
    content, near = m.where("kind = 'content'"), m.where("kind = 'near'")
    same = content.join(t, F.col("train_key") == F.col("t_content")).join(e, F.col("eval_key") == F.col("e_content")).select("t", "e")
    close = near.join(t, F.col("train_key") == F.col("t_near")).join(e, F.col("eval_key") == F.col("e_near"))
    close = close.where(~F.coalesce(F.col("t_content") == F.col("e_content"), F.lit(False))).select("t", "e")
    return same.union(close).select(F.least("t", "e").alias("row_a"), F.greatest("t", "e").alias("row_b")).where("row_a < row_b").distinct()


def overlap_report(manifest: DataFrame, scratch: Scratch | None = None, **how) -> DataFrame:
    """Per evaluation split and source: rows, rows that overlap with training, and pairs, without listing the pairs.

    split, source_dataset, n_rows, n_same_rows (by content hash), n_near_rows (by perceptual hash), n_overlap_rows,
    n_same_pairs, n_near_pairs, and of the near pairs n_near_spans (their maximal matches, merged per pair of codes) and
    near_span_bits (the bits these hold). A code's rows are counted, not paired, so a code held by a third of all rows costs no more
    than any other; a pair that agrees by both hashes counts in both columns.
    """
    scratch = scratch or Scratch(manifest.sparkSession, "overlap")
    r = scratch.keep(records(manifest), "records")
    m = matched_codes(r, scratch, **how)
    per = lambda kind, c: (
        m.where(F.col("kind") == kind)
        .join(r.where(F.col("side") == TRAIN).groupBy(c.alias("train_key")).agg(F.count("*").alias("n")), "train_key")
        .groupBy("eval_key").agg(F.sum("n").alias(f"{kind}_pairs"), F.sum(F.col("n") * F.col("n_spans")).alias(f"{kind}_spans"), F.sum(F.col("n") * F.col("span")).alias(f"{kind}_bits"))
    )
    e = r.where(F.col("side") == EVALUATION).groupBy("split", "dataset", "content", F.col("near").alias("near_key")).agg(F.count("*").alias("n"))
    e = e.join(per("content", F.col("content")).withColumnRenamed("eval_key", "content"), "content", "left")
    e = e.join(per("near", F.col("near")).withColumnRenamed("eval_key", "near_key"), "near_key", "left")
    same, near = F.coalesce("content_pairs", F.lit(0)), F.coalesce("near_pairs", F.lit(0))
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    return e.groupBy("split", F.col("dataset").alias("source_dataset")).agg(
        total("n", "n_rows"),
        total(F.when(same > 0, F.col("n")).otherwise(0), "n_same_rows"),
        total(F.when(near > 0, F.col("n")).otherwise(0), "n_near_rows"),
        total(F.when((same > 0) | (near > 0), F.col("n")).otherwise(0), "n_overlap_rows"),
        total(F.col("n") * same, "n_same_pairs"),
        total(F.col("n") * near, "n_near_pairs"),
        total(F.col("n") * F.coalesce("near_spans", F.lit(0)), "n_near_spans"),
        total(F.col("n") * F.coalesce("near_bits", F.lit(0)), "near_span_bits"),
    )
