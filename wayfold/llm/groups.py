"""Problem 5: one group identifier for all records that pairwise matches link, directly or through others.

Hash-to-Min: every vertex holds a cluster, at first itself and its neighbours. In each round it sends the cluster to the
cluster's least member, and that member to all others; when nothing changes, the least member of a vertex's cluster names
its component. Clusters are kept as rows (vertex, member), never as one value, so the cluster of a vertex that a third
of all records point to is spread over tasks: its least member is a partial aggregate, and the join that sends the
messages is one that adaptive execution may split. The number of rounds grows with the logarithm of the diameter; each
round is written to the shared folder, which cuts the lineage.

Nulls, blanks and filler words are no pointers. Pointers to unknown paths or to the own row link nothing. Repeated rows
and repeated pairs count once. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import normal
from ..session import Scratch

MAX_ROUNDS = 100


def hash_to_min(pairs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """vertex, group_id for each vertex of pairs (a, b), longs; group_id is the least vertex of its component.

    Pairs with a null or with equal ends are ignored. Raises RuntimeError should MAX_ROUNDS not suffice.
    """
    scratch = scratch or Scratch(pairs.sparkSession, "groups")
    edges = pairs.select("a", "b").where("a <> b")
    both = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")), F.struct(F.col("a").alias("v"), F.col("a").alias("u")), F.struct(F.col("b").alias("v"), F.col("b").alias("u"))))
    cluster = scratch.keep(edges.select(both.alias("x")).select("x.v", "x.u").distinct(), "clusters")
    if cluster.isEmpty():
        return cluster.select(F.col("v").alias("vertex"), F.col("u").alias("group_id"))
    for _ in range(MAX_ROUNDS):
        least = cluster.groupBy("v").agg(F.min("u").alias("m"))
        seen = Observation()
        # A cluster is at rest if it is {its least member}, or belongs to that member.
        known = cluster.join(least, "v").observe(seen, F.count_if((F.col("v") != F.col("m")) & (F.col("u") != F.col("m"))).alias("moving"))
        sent = F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))))
        after = scratch.keep(known.select(sent.alias("x")).select("x.v", "x.u").distinct(), "clusters")
        if not seen.get["moving"]:
            scratch.drop(after)
            return least.select(F.col("v").alias("vertex"), F.col("m").alias("group_id"))
        scratch.drop(cluster)
        cluster = after
    raise RuntimeError(f"clusters still change after {MAX_ROUNDS} rounds")


def pointer_pairs(manifest: DataFrame, columns: tuple[str, ...] = ("stage177_exact_duplicate_of", "stage177_near_duplicate_of")) -> DataFrame:
    """a, b: row numbers where a points to the image_path of b, in any spelling of the path."""
    rows = manifest.select(F.col("stage177_row_number").cast("long").alias("row"), normal.path("image_path").alias("path"), *[normal.path(c).alias(f"to{i}") for i, c in enumerate(columns)])
    pointers = rows.select(F.col("row").alias("a"), F.explode(F.array_compact(F.array(*[F.col(f"to{i}") for i in range(len(columns))]))).alias("path"))
    # A path that several rows share names the first of them, so that repeated rows add no pairs of their own.
    named = rows.where("path is not null and row is not null").groupBy("path").agg(F.min("row").alias("b"))
    return pointers.where("a is not null").join(named, "path").where("a <> b").select("a", "b").distinct()


def linked_rows(manifest: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """stage177_row_number, group_id of the rows linked to at least one other row."""
    groups = hash_to_min(pointer_pairs(manifest), scratch)
    return groups.select(F.col("vertex").alias("stage177_row_number"), "group_id")


def grouped_rows(manifest: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """stage177_row_number, group_id, group_size for every row; a row without links is a group of its own."""
    groups = hash_to_min(pointer_pairs(manifest), scratch)
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("group_size"))
    rows = manifest.select(F.col("stage177_row_number").cast("long").alias("vertex")).where("vertex is not null").distinct()
    return rows.join(groups.join(sizes, "group_id"), "vertex", "left").select(
        F.col("vertex").alias("stage177_row_number"), F.coalesce("group_id", "vertex").alias("group_id"), F.coalesce("group_size", F.lit(1)).alias("group_size")
    )
