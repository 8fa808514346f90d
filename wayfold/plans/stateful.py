"""Queries over scalar functions and order-dependent operators.

Boxes come from the frames: a frame's source sequence places one box that drifts along its lane and, in every third frame,
a second one. Observations of labels are those of analytics.py.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import relational as R
from ..operators import tracks as T
from ..operators.calibration import chosen
from ..session import Scratch
from ..sources import files
from ..sources.tables import table
from .analytics import OBS, obs
from .registry import core
from .relational import NOW

_FRAMES = """f AS (SELECT run_id, frame_id, source_sequence AS s, capture_time_ms AS t FROM camera_frames WHERE source_sequence IS NOT NULL AND run_id IS NOT NULL AND capture_time_ms IS NOT NULL)"""


def _frames(spark, d):
    return table(spark, d, "camera_frames").where("source_sequence is not null and run_id is not null and capture_time_ms is not null").select("run_id", "frame_id", F.col("source_sequence").alias("s"), F.col("capture_time_ms").alias("t"))


# ---- scalar functions


@core.add("x1_clamp", "SELECT event_id, least(1.0, greatest(0.0, value / 100 - 1)) AS clamped FROM events")
def x1(spark, d):
    return table(spark, d, "events").select("event_id", X.clamp01(F.col("value") / 100 - 1).alias("clamped"))


_PAIR = f"""{_FRAMES}, b AS (SELECT frame_id, t, (s % 40) / 100 AS ax, (s % 40) / 100 + 0.3 AS bx, (s % 23) / 100 AS cx, (s % 23) / 100 + 0.35 AS dx FROM f),
    i AS (SELECT frame_id, t, greatest(0.0, least(bx, dx) - greatest(ax, cx)) * greatest(0.0, least(0.7, 0.8) - greatest(0.2, 0.3)) AS i, greatest(0.0, bx - ax) * 0.5 + greatest(0.0, dx - cx) * 0.5 AS u FROM b)"""


@core.add("x2_overlap", f"WITH {_PAIR} SELECT frame_id, t, round(i / (u - i), 6) AS iou FROM i")
def x2(spark, d):
    a, c = (F.col("s") % 40) / 100, (F.col("s") % 23) / 100
    return _frames(spark, d).select("frame_id", "t", F.round(X.iou((a, F.lit(0.2), a + 0.3, F.lit(0.7)), (c, F.lit(0.3), c + 0.35, F.lit(0.8))), 6).alias("iou"))


@core.add("x3_unletterbox", f"WITH {_FRAMES} SELECT frame_id, t, least(1920.0, greatest(0.0, round((s % 640 - 40) / 0.25))) AS x FROM f")
def x3(spark, d):
    return _frames(spark, d).select("frame_id", "t", X.unletterbox((F.col("s") % 640).cast("double"), 0.25, 40.0, 1920.0).alias("x"))


@core.add(
    "x4_anchor_decode",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS e FROM embeddings), c AS (SELECT vec_id, e[1] AS x, e[2] AS y, e[3] AS w, e[4] AS h, e[5:] AS scores FROM v),
    p AS (SELECT *, list_position(scores, list_max(scores)) - 1 AS class, list_max(scores) AS confidence FROM c)
    SELECT vec_id, round(least(1.0, greatest(0.0, x - w / 2)), 9) AS x1, round(least(1.0, greatest(0.0, y - h / 2)), 9) AS y1, round(least(1.0, greatest(0.0, x + w / 2)), 9) AS x2, round(least(1.0, greatest(0.0, y + h / 2)), 9) AS y2, CAST(class AS INT) AS class, round(confidence, 9) AS confidence FROM p WHERE confidence >= 0.25""",
)
def x4(spark, d):
    """An anchor as centre, size and scores of classes: its corners within the picture, the first best class, if it is sure."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("e"))
    e = [F.get("e", i) for i in range(4)]
    scores = F.slice("e", F.lit(5), F.size("e"))
    half = (e[2] / 2, e[3] / 2)
    edge = lambda c: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 9)
    out = v.select("vec_id", edge(e[0] - half[0]).alias("x1"), edge(e[1] - half[1]).alias("y1"), edge(e[0] + half[0]).alias("x2"), edge(e[1] + half[1]).alias("y2"), X.argmax(scores).alias("class"), F.round(F.array_max(scores), 9).alias("confidence"), F.array_max(scores).alias("sure"))
    return out.where("sure >= 0.25").drop("sure")


@core.add(
    "x7_family_mass",
    """WITH v AS (SELECT vec_id, list_transform(generate_series(0, 9), lambda k: list_sum(list_transform(embedding[1 + k : len(embedding) : 10], lambda x: greatest(0.0, CAST(x AS DOUBLE))))) AS p FROM embeddings), t AS (SELECT vec_id, p, list_sum(p) AS total FROM v WHERE list_sum(p) > 0),
    m AS (SELECT vec_id, p, total, list_sum(p[1:5]) AS a, list_sum(p[6:10]) AS b FROM t)
    SELECT vec_id, CASE WHEN a >= b THEN 'low' ELSE 'high' END AS family, CASE WHEN a >= b THEN list_position(p, list_max(p[1:5])) ELSE 5 + list_position(p[6:10], list_max(p[6:10])) END - 1 AS subtype,
      round(sqrt(greatest(a, b) / total * (CASE WHEN a >= b THEN list_max(p[1:5]) ELSE list_max(p[6:10]) END / greatest(a, b))), 6) AS score FROM m""",
)
def x7(spark, d):
    """The family that holds most of the mass, its greatest subtype, and the router's score: the root of the share of the
    family times the share of the subtype within it. Ten subtypes, each of every tenth number of the vector."""
    at = lambda k: F.filter("embedding", lambda x, i: i % 10 == k)
    p = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.aggregate(at(k), F.lit(0.0), lambda s, x: s + F.greatest(F.lit(0.0), x.cast("double"))))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    v = table(spark, d, "embeddings").select("vec_id", p.alias("p")).select("vec_id", "p", add(F.slice("p", 1, 5)).alias("a"), add(F.slice("p", 6, 5)).alias("b"), add(F.col("p")).alias("total")).where("total > 0")
    low = F.col("a") >= F.col("b")
    own = F.when(low, F.slice("p", 1, 5)).otherwise(F.slice("p", 6, 5))
    mass = F.greatest("a", "b")
    return v.select("vec_id", F.when(low, "low").otherwise("high").alias("family"), (X.argmax(own) + F.when(low, 0).otherwise(5)).cast("int").alias("subtype"), F.round(F.sqrt(mass / F.col("total") * (F.array_max(own) / mass)), 6).alias("score"))


def _yes(c):
    return f"lower(trim(coalesce({c}, ''), ' ')) IN ('1', 'true', 'yes', 'y', 'on')"


@core.add(
    "x9_quality_weight",
    f"""WITH m AS (SELECT stage177_row_number AS row_number, coalesce(try_cast(stage177_mean_luma AS DOUBLE), 0) AS e, {_yes('blur')} AS b, {_yes('occluded')} AS o, {_yes('truncated')} AS t, lower(trim(coalesce(crop_quality, ''), ' ')) = 'usable' AS u FROM attribute_manifest)
    SELECT row_number, round(greatest(0.01, least(1.0, greatest(0.10, least(1.0, ln(1 + greatest(0, e)) / ln(1001))) * CASE WHEN b THEN 0.6 ELSE 1 END * CASE WHEN o THEN 0.45 ELSE 1 END * CASE WHEN t THEN 0.55 ELSE 1 END * CASE WHEN u THEN 0.75 ELSE 1 END)), 6) AS weight FROM m""",
)
def x9(spark, d):
    from ..functions.predicates import truthy

    e = F.greatest(F.lit(0.0), F.coalesce(F.col("stage177_mean_luma").try_cast("double"), F.lit(0.0)))
    detail = F.greatest(F.lit(0.10), F.least(F.lit(1.0), F.log1p(e) / F.log1p(F.lit(1000.0))))
    f = lambda cond, x: F.when(cond, x).otherwise(1.0)
    w = X.product([detail, f(truthy("blur"), 0.6), f(truthy("occluded"), 0.45), f(truthy("truncated"), 0.55), f(F.lower(F.trim(F.coalesce("crop_quality", F.lit("")))) == "usable", 0.75)])
    return table(spark, d, "attribute_manifest").select(F.col("stage177_row_number").alias("row_number"), F.round(F.greatest(F.lit(0.01), F.least(F.lit(1.0), w)), 6).alias("weight"))


_PICTURE = """v AS (SELECT vec_id, list_transform(embedding, lambda x: least(255.0, greatest(0.0, 70 + 60 * CAST(x AS DOUBLE)))) AS v FROM embeddings),
  ring AS (SELECT vec_id, v, list_filter(v, lambda x, i: (i - 1) // 8 < 2 OR (i - 1) // 8 >= 6 OR (i - 1) % 8 < 2 OR (i - 1) % 8 >= 6) AS edge, list_transform(list_filter(generate_series(1, 63), lambda i: i % 8 <> 0), lambda i: v[i + 1] - v[i]) AS steps FROM v),
  st AS (SELECT vec_id, list_avg(v) AS mean, list_median(v) AS median, list_aggregate(v, 'quantile_cont', 0.9) AS p90, list_avg(edge) AS border, len(list_filter(v, lambda x: x < 55)) / 64 AS dark, list_aggregate(v, 'stddev_pop') AS contrast, list_aggregate(steps, 'var_pop') AS edges FROM ring)"""


def _pictures(spark, d):
    """Vectors as pictures of 8 by 8 brightness values, with their statistics."""
    v = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), 70 + 60 * x.cast("double"))))
    p = table(spark, d, "embeddings").select("vec_id", v.alias("v"))
    return p.select("vec_id", *[c.alias(n) for n, c in X.picture_statistics(F.col("v")).items()])


@core.add(
    "x11_low_light",
    f"""WITH {_PICTURE}, q AS (SELECT *, 0.28 * least(1, greatest(0, (95 - mean) / 65)) + 0.22 * least(1, greatest(0, (90 - median) / 65)) + 0.25 * least(1, greatest(0, (100 - border) / 70)) + 0.15 * least(1, dark / 0.6) + 0.10 * least(1, greatest(0, (165 - p90) / 105)) AS score FROM st)
    SELECT vec_id, round(score, 6) AS score, score >= 0.62 AND mean <= 88 AND median <= 82 AND border <= 95 AND dark >= 0.3 AS low_light, score >= 0.78 AND mean <= 70 AND median <= 65 AND border <= 80 AND dark >= 0.45 AS night,
      score <= 0.15 AND mean >= 130 AND median >= 120 AND dark <= 0.1 AS bright FROM q""",
)
def x11(spark, d):
    p = _pictures(spark, d).withColumn("score", X.low_light("mean", "median", "border", "dark", "p90"))
    flag = lambda text, name: F.expr(text).alias(name)
    return p.select(
        "vec_id", F.round("score", 6).alias("score"), flag("score >= 0.62 and mean <= 88 and median <= 82 and border <= 95 and dark >= 0.3", "low_light"),
        flag("score >= 0.78 and mean <= 70 and median <= 65 and border <= 80 and dark >= 0.45", "night"), flag("score <= 0.15 and mean >= 130 and median >= 120 and dark <= 0.1", "bright"),
    )


@core.add("f15_picture_gate", f"WITH {_PICTURE} SELECT vec_id, CASE WHEN mean NOT BETWEEN 12 AND 245 THEN 'exposure' WHEN contrast < 50 THEN 'contrast' WHEN edges < 2000 THEN 'edges' ELSE 'accepted' END AS reason FROM st")
def f15_pictures(spark, d):
    """Pictures by the first test they fail: exposure, contrast (standard deviation), edges (variance of steps to the right)."""
    from ..functions.predicates import first_reason

    return _pictures(spark, d).select("vec_id", first_reason(("exposure", ~F.col("mean").between(12, 245)), ("contrast", F.col("contrast") < 50), ("edges", F.col("edges") < 2000), otherwise="accepted").alias("reason"))


@core.add(
    "x11_explicit_scene",
    f"""WITH m AS (SELECT stage177_row_number AS row_number, try_cast(stage177_mean_luma AS DOUBLE) AS l, {_yes('night')} AS n, lower(trim(coalesce(stage177_scene_label, ''), ' ')) AS s FROM attribute_manifest)
    SELECT row_number, CASE WHEN l IS NULL THEN 0 ELSE round(greatest(0.0, least(1.0, (110 - l) / 90)), 6) END AS score, CASE WHEN n OR s = 'night' THEN 'night' WHEN s IN ('daylight', 'day') THEN 'day' WHEN l < 55 THEN 'low_light' ELSE 'unknown' END AS scene FROM m""",
)
def x11_scene(spark, d):
    from ..functions.predicates import first_reason, truthy

    luma, s = F.col("stage177_mean_luma").try_cast("double"), F.lower(F.trim(F.coalesce("stage177_scene_label", F.lit(""))))
    scene = first_reason(("night", truthy("night") | (s == "night")), ("day", s.isin("daylight", "day")), ("low_light", luma < 55), otherwise="unknown")
    return table(spark, d, "attribute_manifest").select(F.col("stage177_row_number").alias("row_number"), F.round(F.when(luma.isNull(), 0.0).otherwise(X.clamp01((110 - luma) / 90)), 6).alias("score"), scene.alias("scene"))


_COLORS = ("black", "blue", "gray", "green", "red", "white")
_CHROMATIC = ("blue", "green", "red")


@core.add(
    "x12_color_evidence",
    f"""WITH v AS (SELECT vec_id, unnest({list(_COLORS)}) AS color, unnest(list_transform(embedding[1:6], lambda x: greatest(0.0, CAST(x AS DOUBLE)))) AS s FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, color DESC) AS k FROM v)
    SELECT vec_id, max(color) FILTER (k = 1) AS proposed, CASE WHEN max(s) FILTER (k = 1) >= 0.15 AND max(s) FILTER (k = 1) - max(s) FILTER (k = 2) >= 0.02 THEN max(color) FILTER (k = 1) ELSE 'unknown' END AS label FROM k GROUP BY vec_id""",
)
def x12(spark, d):
    pairs = F.sort_array(F.array(*[F.struct(F.greatest(F.lit(0.0), F.get("embedding", i).cast("double")).alias("s"), F.lit(c).alias("color")) for i, c in enumerate(_COLORS)]), asc=False)
    e = table(spark, d, "embeddings").select("vec_id", pairs.alias("p"))
    first, second = F.get("p", 0), F.get("p", 1)
    good = (first["s"] >= 0.15) & (first["s"] - second["s"] >= 0.02)
    return e.select("vec_id", first["color"].alias("proposed"), F.when(good, first["color"]).otherwise("unknown").alias("label"))


@core.add(
    "x13_compatible_color",
    f"""WITH v AS (SELECT vec_id, {list(_COLORS)}[1 + label % 6] AS predicted, list_transform(embedding[1:6], lambda x: greatest(0.0, CAST(x AS DOUBLE))) AS s FROM embeddings), m AS (SELECT *, s[list_position({list(_COLORS)}, predicted)] AS own, list_max([s[1], s[3], s[6]]) AS grey, list_max([s[2], s[4], s[5]]) AS hue, list_max(s) AS top FROM v)
    SELECT vec_id, CASE WHEN predicted IN {_CHROMATIC} THEN own = top AND own >= 0.1 ELSE own >= 0.05 AND grey >= 0.05 AND hue < grey END AS compatible FROM m""",
)
def x13(spark, d):
    s = F.transform(F.slice("embedding", 1, 6), lambda x: F.greatest(F.lit(0.0), x.cast("double")))
    v = table(spark, d, "embeddings").select("vec_id", s.alias("s"), (F.col("label") % 6).alias("i"))
    own = F.get("s", F.col("i"))
    top = lambda *at: F.greatest(*[F.get("s", i) for i in at])
    grey, hue = top(0, 2, 5), top(1, 3, 4)
    chromatic = F.col("i").isin(1, 3, 4)
    return v.select("vec_id", F.when(chromatic, (own == F.array_max("s")) & (own >= 0.1)).otherwise((own >= 0.05) & (grey >= 0.05) & (hue < grey)).alias("compatible"))


_NINE = "list_concat(embedding, embedding[1:8])"


@core.add(
    "x14_difference_hash",
    f"""WITH v AS (SELECT vec_id, {_NINE} AS v FROM embeddings) SELECT vec_id, list_aggregate(list_transform(generate_series(0, 63), lambda i: CASE WHEN v[i // 8 * 9 + i % 8 + 2] > v[i // 8 * 9 + i % 8 + 1] THEN '1' ELSE '0' END), 'string_agg', '') AS rising,
    list_aggregate(list_transform(generate_series(0, 63), lambda i: CASE WHEN v[i // 8 * 9 + i % 8 + 2] < v[i // 8 * 9 + i % 8 + 1] THEN '1' ELSE '0' END), 'string_agg', '') AS falling FROM v""",
)
def x14(spark, d):
    """Difference hashes of pictures of 9 by 8 values, by both conventions of what a set bit means."""
    v = F.concat("embedding", F.slice("embedding", 1, 8))
    return table(spark, d, "embeddings").select("vec_id", X.dhash_bits(v).alias("rising"), X.dhash_bits(v, False).alias("falling"))


@core.add("x15_hamming", "SELECT event_id, bit_count(xor(event_id * 2654435761, user_id * 40503)) AS distance FROM events")
def x15(spark, d):
    return table(spark, d, "events").select("event_id", X.hamming(F.col("event_id") * 2654435761, F.col("user_id") * 40503).cast("byte").alias("distance"))


@core.add("x16_stable_key", "SELECT doc_id, sha256(coalesce(text, '')) AS digest, CAST('0x' || substr(sha256(coalesce(text, '')), 1, 8) AS BIGINT) % 1000 AS bucket FROM documents")
def x16(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("digest"), X.stable_fraction(t, 1000).alias("bucket"))


_PADS = [pad.hex() for pad in X.hmac_pads("test-secret")]


@core.add(
    "x17_hmac",
    f"SELECT outbox_id, event_id, sha256(from_hex('{_PADS[1]}') || unhex(sha256(from_hex('{_PADS[0]}') || encode(created_at_ms || chr(10) || coalesce(event_id, ''))))) AS signature FROM callback_outbox",
)
def x17(spark, d):
    return table(spark, d, "callback_outbox").select("outbox_id", "event_id", X.hmac_sha256("test-secret")(F.col("created_at_ms").cast("string"), F.coalesce("event_id", F.lit(""))).alias("signature"))


@core.add("x18_backoff", "SELECT outbox_id, event_id, created_at_ms, least(60000, 500 * CAST(pow(2, least(40, greatest(1, coalesce(attempt, 1))) - 1) AS BIGINT)) AS delay_ms FROM callback_outbox")
def x18(spark, d):
    return table(spark, d, "callback_outbox").select("outbox_id", "event_id", "created_at_ms", X.backoff(F.coalesce("attempt", F.lit(1)), 500, 60_000).alias("delay_ms"))


@core.add(
    "x19_motion",
    f"""WITH {_FRAMES}, u AS (SELECT DISTINCT run_id, s FROM f), g AS (SELECT *, lag(s) OVER w AS p, lead(s) OVER w AS n FROM u WINDOW w AS (PARTITION BY run_id ORDER BY s)) SELECT run_id, s, round((s % 97) / 100 + ((s % 97) - (p % 97)) / 100 * (n - s) / (s - p), 6) AS predicted_x FROM g WHERE p IS NOT NULL AND n IS NOT NULL""",
)
def x19(spark, d):
    w = Window.partitionBy("run_id").orderBy("s")
    g = _frames(spark, d).select("run_id", "s").distinct().withColumn("p", F.lag("s").over(w)).withColumn("n", F.lead("s").over(w)).where("p is not null and n is not null")
    return g.select("run_id", "s", F.round((F.col("s") % 97) / 100 + ((F.col("s") % 97) - (F.col("p") % 97)) / 100 * (F.col("n") - F.col("s")) / (F.col("s") - F.col("p")), 6).alias("predicted_x"))


@core.add("x20_regex_fields", "SELECT frame_id, capture_time_ms, regexp_extract(relative_path, '^([a-z]+)_', 1) AS place, try_cast(regexp_extract(relative_path, '(\\d+)\\.jpg$', 1) AS BIGINT) AS number FROM camera_frames")
def x20(spark, d):
    return table(spark, d, "camera_frames").select("frame_id", "capture_time_ms", F.regexp_extract("relative_path", "^([a-z]+)_", 1).alias("place"), F.regexp_extract("relative_path", r"(\d+)\.jpg$", 1).try_cast("long").alias("number"))


@core.add("x21_inverse_root", f"WITH {OBS} SELECT label, count(*) AS n, round(1 / sqrt(count(*)), 9) AS weight FROM obs GROUP BY label")
def x21(spark, d):
    return obs(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.round(1 / F.sqrt(F.count("*")), 9).alias("weight"))


@core.add(
    "x23_masked_uri",
    """WITH u AS (SELECT task_id, CASE WHEN version % 3 = 0 THEN 'http://' || task_id WHEN version % 2 = 0 THEN 'rtsp://user:pw@' || task_id || '/live?x=1' ELSE 'rtsp://' || task_id || '/live#f' END AS u FROM camera_tasks)
    SELECT task_id, CASE WHEN regexp_matches(u, '^rtsps?://') THEN regexp_replace(regexp_replace(u, '[?#].*$', ''), '^([A-Za-z]+://)[^/@]*@', '\\1***:***@') ELSE '***' END AS masked FROM u""",
)
def x23(spark, d):
    u = F.when(F.col("version") % 3 == 0, F.concat(F.lit("http://"), "task_id")).when(F.col("version") % 2 == 0, F.concat(F.lit("rtsp://user:pw@"), "task_id", F.lit("/live?x=1"))).otherwise(F.concat(F.lit("rtsp://"), "task_id", F.lit("/live#f")))
    return table(spark, d, "camera_tasks").select("task_id", X.masked_uri(u).alias("masked"))


# ---- frames of boxes


def _boxes(spark, d):
    """run_id, s, t, boxes: one or two boxes per frame, repeated frames once."""
    f = _frames(spark, d).groupBy("run_id", "s").agg(F.min("t").alias("t"))
    lane = lambda k, dy: F.array((F.col("s") % k) / (2.0 * k), F.lit(dy), (F.col("s") % k) / (2.0 * k) + 0.35, F.lit(dy + 0.3))
    return f.select("run_id", "s", "t", F.when(F.col("s") % 3 == 0, F.array(lane(29, 0.1), lane(17, 0.5))).otherwise(F.array(lane(29, 0.1))).alias("boxes"))


_BOXES = f"""{_FRAMES}, g AS (SELECT run_id, s, min(t) AS t FROM f GROUP BY 1, 2), b AS (SELECT run_id, s, 0 AS i, (s % 29) / 58 AS x1, 0.1 AS y1, (s % 29) / 58 + 0.35 AS x2, 0.4 AS y2 FROM g UNION ALL SELECT run_id, s, 1, (s % 17) / 34, 0.5, (s % 17) / 34 + 0.35, 0.8 FROM g WHERE s % 3 = 0)"""


@core.add(
    "j14_overlap_join",
    f"""WITH {_BOXES}, n AS (SELECT *, lead(s) OVER (PARTITION BY run_id ORDER BY s) AS nx FROM g), p AS (SELECT a.run_id, a.s, a.i, c.i AS j, greatest(0.0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0.0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) AS o,
    (a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) AS u FROM n JOIN b a ON a.run_id = n.run_id AND a.s = n.s JOIN b c ON c.run_id = n.run_id AND c.s = n.nx) SELECT run_id, s, i, j, round(o / (u - o), 6) AS iou FROM p WHERE o / (u - o) >= 0.3""",
)
def j14(spark, d):
    f = _boxes(spark, d)
    w = Window.partitionBy("run_id").orderBy("s")
    both = f.withColumn("later", F.lead("boxes").over(w)).select("run_id", "s", F.posexplode("boxes").alias("i", "a"), "later").select("run_id", "s", "i", "a", F.posexplode("later").alias("j", "c"))
    box = lambda c: tuple(F.get(c, k) for k in range(4))
    return both.withColumn("x", X.iou(box("a"), box("c"))).where("x >= 0.3").select("run_id", "s", "i", "j", F.round("x", 6).alias("iou"))


def _box_list(boxes) -> list[tuple]:
    return [tuple(map(float, b)) for b in boxes]


def _track_fold(frames):
    t, run, last = T.Tracker(least_hits=2, timeout=60_000), None, 0
    for run, s, at, boxes in frames:
        last = max(last, int(at))
        for x in t.frame(int(s), int(at), _box_list(boxes))[1]:
            yield run, x.id, x.first, x.last, x.hits, "exit" if x.confirmed else "dropped"
    for x in t.stop(last):
        yield run, x.id, x.first, x.last, x.hits, "run_stop" if x.confirmed else "dropped"


@core.add("r2_tracks")
def r2(spark, d):
    return T.streamed(_boxes(spark, d), ["run_id"], ["s"], _track_fold, "run_id string, track long, first_ms long, last_ms long, hits int, reason string")


@core.add("r1_rejected_frames", f"WITH {_FRAMES}, o AS (SELECT run_id, s, max(s) OVER (PARTITION BY run_id ORDER BY t, s DESC, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM f) SELECT run_id, count(*) AS frames, count(*) FILTER (s <= seen) AS rejected FROM o GROUP BY run_id")
def r1(spark, d):
    w = Window.partitionBy("run_id").orderBy("t", F.desc("s"), "frame_id").rowsBetween(Window.unboundedPreceding, -1)
    return _frames(spark, d).withColumn("seen", F.max("s").over(w)).groupBy("run_id").agg(F.count("*").alias("frames"), F.count_if(F.col("s") <= F.col("seen")).alias("rejected"))


@core.add(
    "r3_run_stop",
    f"""WITH {_FRAMES}, stops AS (SELECT run_id, max(t) AS stop_ms FROM f GROUP BY run_id), live AS (SELECT run_id, track_id, min(first_seen_at_ms) AS first_ms, max(last_seen_at_ms) AS last_ms, max(crop_quality) AS quality, count(*) AS n FROM vehicle_track_results
      WHERE run_id IS NOT NULL AND track_id IS NOT NULL GROUP BY 1, 2) SELECT run_id, track_id, first_ms, greatest(last_ms, stop_ms) AS last_ms, stop_ms, 'run_stop' AS reason FROM live JOIN stops USING (run_id)""",
)
def r3(spark, d):
    """When a run stops all its tracks exit, each last seen at the stop if it was not seen later."""
    stops = _frames(spark, d).groupBy("run_id").agg(F.max("t").alias("stop_ms"))
    live = table(spark, d, "vehicle_track_results").where("run_id is not null and track_id is not null").groupBy("run_id", "track_id").agg(F.min("first_seen_at_ms").alias("first_ms"), F.max("last_seen_at_ms").alias("last"))
    return live.join(stops, "run_id").select("run_id", "track_id", "first_ms", F.greatest("last", "stop_ms").alias("last_ms"), "stop_ms", F.lit("run_stop").alias("reason"))


@core.add("r27_tracks_in_order")
def r27(spark, d):
    def fold(frames):
        rows, again = itertools.tee(frames)
        for (run, s, _, _), ids in zip(rows, T.follow_in_order((i, _box_list(r[3])) for i, r in enumerate(again)), strict=True):
            for k, i in enumerate(ids):
                yield run, int(s), k, i

    return T.streamed(_boxes(spark, d), ["run_id"], ["s"], fold, "run_id string, s long, box int, track long")


_PAIRED = f"""{_BOXES}, n AS (SELECT *, lead(s) OVER (PARTITION BY run_id ORDER BY s) AS nx FROM g), o AS (SELECT a.run_id, a.s, a.i, c.i AS j, greatest(0.0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0.0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) AS o,
    (a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) AS u FROM n JOIN b a ON a.run_id = n.run_id AND a.s = n.s JOIN b c ON c.run_id = n.run_id AND c.s = n.nx), p AS (SELECT run_id, s, i, j, o / (u - o) AS x FROM o WHERE o / (u - o) >= 0.3)"""


# With two boxes a side at most, the best pair and the best of those that share no box with it are all there can be.
@core.add(
    "j15_greedy_matching",
    f"""WITH {_PAIRED}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id, s ORDER BY round(x, 12) DESC, i, j) AS k FROM p), first AS (SELECT * FROM k WHERE k = 1),
    second AS (SELECT k.*, row_number() OVER (PARTITION BY k.run_id, k.s ORDER BY k.k) AS again FROM k JOIN first f ON f.run_id = k.run_id AND f.s = k.s WHERE k.i <> f.i AND k.j <> f.j)
    SELECT run_id, s, i, j, round(x, 6) AS iou FROM first UNION ALL SELECT run_id, s, i, j, round(x, 6) FROM second WHERE again = 1""",
)
def j15(spark, d):
    return _matched(spark, d, lambda a, b: T.match_greedy(a, b, 0.3))


@core.add("j16_optimal_matching")
def j16(spark, d):
    """Links of least cost between the boxes of frames that follow each other; appearance is told by the frame numbers."""

    def fold(frames):
        for seen, ((run, s, _, a), (_, n, _, b)) in enumerate(itertools.pairwise(frames), 1):
            look = lambda i, j: abs((s + i) % 13 - (n + j) % 13) / 26  # noqa: B023, E731
            links = {(i, j): T.link_cost(x, y, int(n - s), 64 * 8, look(i, j), seen) for i, x in enumerate(_box_list(a)) for j, y in enumerate(_box_list(b))}
            cost = np.array([1e6 if links[i, j] is None else links[i, j] for i in range(len(a)) for j in range(len(b))], float).reshape(len(a), len(b))
            for i, j in T.match_optimal(cost, 0.82):
                yield run, int(s), i, j, round(float(cost[i, j]), 6)

    return T.streamed(_boxes(spark, d), ["run_id"], ["s"], fold, "run_id string, s long, i int, j int, cost double")


def _matched(spark, d, match):
    def fold(frames):
        for (run, s, _, a), (_, _, _, b) in itertools.pairwise(frames):
            for i, j, x in match(_box_list(a), _box_list(b)):
                yield run, int(s), i, j, round(float(x), 6)

    return T.streamed(_boxes(spark, d), ["run_id"], ["s"], fold, "run_id string, s long, i int, j int, iou double")


@core.add("j17_detection_outcomes")
def j17(spark, d):
    def fold(frames):
        for run, s, _, boxes in frames:
            truth = _box_list(boxes)
            guesses = [((b[0] + (s % 10) / 40, b[1], min(1.0, b[2] + (s % 10) / 40), b[3]), 1 / (1 + k)) for k, b in enumerate(truth) if (s + k) % 7]
            for o in T.detection_outcomes(guesses, truth, 0.5):
                yield run, int(s), o

    found = T.streamed(_boxes(spark, d), ["run_id"], ["s"], fold, "run_id string, s long, outcome string")
    return found.groupBy("run_id").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")])


# Every box comes twice, moved a little, as a class of its own: of two that overlap by more than half the better one stays.
@core.add(
    "x5_suppression",
    f"WITH {_BOXES} SELECT run_id, s, CAST(CASE WHEN (s + 3 * (2 * i + 1)) % 10 > (s + 6 * i) % 10 THEN 2 * i + 1 ELSE 2 * i END AS INT) AS kept FROM b",
)
def x5(spark, d):
    def fold(frames):
        for run, s, _, boxes in frames:
            twice = [b for b in _box_list(boxes) for _ in range(2)]
            moved = [(b[0] + 0.02 * (k % 2), b[1], b[2] + 0.02 * (k % 2), b[3]) for k, b in enumerate(twice)]
            for k in T.suppress(moved, [((s + 3 * k) % 10) / 10 for k in range(len(moved))], [k // 2 % 2 for k in range(len(moved))], 0.5):
                yield run, int(s), k

    return T.streamed(_boxes(spark, d), ["run_id"], ["s"], fold, "run_id string, s long, kept int")


# ---- fusion


def _seen(spark, d):
    return obs(spark, d).select("track", F.col("pos").alias("position"), "label", (F.col("c") / 100).alias("confidence"), (F.col("q") / 500).alias("quality"))


@core.add(
    "a7_window_fusion",
    f"""WITH {OBS}, w AS (SELECT a.track, a.pos, b.label, CAST(sum(b.c * b.q) AS BIGINT) AS w FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY pos) AS i FROM obs) a JOIN (SELECT *, row_number() OVER (PARTITION BY track ORDER BY pos) AS i FROM obs) b ON a.track = b.track AND b.i BETWEEN a.i - 4 AND a.i GROUP BY 1, 2, 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY track, pos ORDER BY w DESC, label) AS k, CAST(sum(w) OVER (PARTITION BY track, pos) AS BIGINT) AS a FROM w WHERE label <> 'unknown'), t AS (SELECT track, pos, max(label) FILTER (k = 1) AS label, max(w) FILTER (k = 1) AS f, coalesce(max(w) FILTER (k = 2), 0) AS s, max(a) AS a FROM k GROUP BY 1, 2)
    SELECT o.track, o.pos AS position, CASE WHEN a > 0 AND 2 * f >= a AND 10 * (f - s) >= a THEN t.label ELSE 'unknown' END AS label FROM obs o LEFT JOIN t ON t.track = o.track AND t.pos = o.pos""",
)
def a7_window(spark, d):
    # whole numbers decide, so that bounds met exactly are met in any arithmetic: the trailing rows are a window frame,
    # and the scores per label a fold over its few entries
    w = Window.partitionBy("track").orderBy("pos").rowsBetween(-4, 0)
    o = obs(spark, d).select("track", "pos", F.collect_list(F.struct("label", (F.col("c") * F.col("q")).alias("w"))).over(w).alias("h"))
    known = F.filter("h", lambda x: x["label"] != "unknown")
    sums = F.transform(F.array_distinct(F.transform(known, lambda x: x["label"])), lambda lab: F.struct((-F.aggregate(F.filter(known, lambda x: x["label"] == lab), F.lit(0).cast("long"), lambda s, x: s + x["w"])).alias("w"), lab.alias("label")))
    o = o.select("track", "pos", F.sort_array(sums).alias("r"))
    first, second = -F.get("r", 0)["w"], F.coalesce(-F.get("r", 1)["w"], F.lit(0))
    total = F.aggregate("r", F.lit(0).cast("long"), lambda s, x: s - x["w"])
    return o.select("track", F.col("pos").alias("position"), F.when((total > 0) & (2 * first >= total) & (10 * (first - second) >= total), F.get("r", 0)["label"]).otherwise("unknown").alias("label"))


@core.add("r6_guarded_fusion")
def r6(spark, d):
    return T.fused(_seen(spark, d), "track", "position", lambda o: T.fuse_guarded(o, 3, 0.55, 0.10))


@core.add("r7_persistent_fusion")
def r7(spark, d):
    return T.fused(_seen(spark, d), "track", "position", lambda o: T.fuse_held(o, 5, 2, (0.5, 0.1), (0.6, 0.2), 2))


@core.add("r8_frontier_fusion")
def r8(spark, d):
    return T.fused(_seen(spark, d), "track", "position", lambda o: T.fuse_held(o, 5, 1, (0.5, 0.1), (0.6, 0.2), 2, hold=1))


@core.add("r9_length_policy")
def r9(spark, d):
    limits = {"click": 0.3, "view": 0.4, "purchase": 0.2, "signup": 0.5}
    return T.fused(_seen(spark, d), "track", "position", lambda o: T.fuse_by_length(list(o), 40, {k: 0.45 for k in limits}, limits, 0.1, 1, window=5, least=1, entry=(0.5, 0.1), switch=(0.6, 0.2), patience=2))


@core.add("r5_track_labels")
def r5(spark, d):
    def fold(seen):
        a, track = T.Aggregator({"label": 0.25}), None
        for track, position, label, confidence, quality in seen:
            a.add(int(position) + 1, float(quality), label=(label, float(confidence)))
        label, confidence, stable = a.outcome("label")
        yield track, label, round(confidence, 6), stable, a.heads["label"].switches

    return T.streamed(_seen(spark, d), ["track"], ["position"], fold, "track long, label string, confidence double, stable boolean, switches int")


@core.add(
    "r4_collecting_tracks",
    f"""WITH {OBS}, n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY pos) AS i, row_number() OVER (PARTITION BY track, label ORDER BY pos) AS same FROM obs), s AS (SELECT track, min(i) AS stable_at FROM n WHERE label <> 'unknown' AND same >= 5 GROUP BY track)
    SELECT n.track, pos AS position, CASE WHEN i < 3 THEN 'tentative' WHEN i > coalesce(stable_at, i) THEN 'stable' ELSE 'collected' END AS outcome FROM n LEFT JOIN s ON s.track = n.track""",
)
def r4(spark, d):
    """Only confirmed tracks (from the third observation) collect, until a label was seen five times and the track is stable."""
    w = Window.partitionBy("track").orderBy("pos")
    n = obs(spark, d).withColumn("i", F.row_number().over(w)).withColumn("same", F.row_number().over(Window.partitionBy("track", "label").orderBy("pos")))
    stable = F.min(F.when((F.col("label") != "unknown") & (F.col("same") >= 5), F.col("i"))).over(Window.partitionBy("track"))
    return n.withColumn("stable_at", stable).select("track", F.col("pos").alias("position"), F.when(F.col("i") < 3, "tentative").when(F.col("i") > F.coalesce("stable_at", F.col("i")), "stable").otherwise("collected").alias("outcome"))


_FUSION = {"threshold": (0.3, 0.5), "window": (1, 3, 5), "share": (0.4, 0.6), "margin": (0.05, 0.2)}


@core.add("c6_fusion_grid")
def c6(spark, d):
    """Every setting of threshold, window, share and margin with the precision and coverage of each track's last label, the
    stability of what is fused (the share of its leading label), and which setting is chosen: the most coverage at the
    precision and stability wanted, else the most precise. The truth of a track is its most frequent label."""
    grid = spark.createDataFrame(list(itertools.product(*_FUSION.values())), "threshold double, window int, share double, margin double")

    def fold(seen):
        seen, first = itertools.tee(seen)
        (*_, threshold, window, share, margin) = next(first)
        del first
        single, kept = 0, {}
        last, raw, n = "unknown", {}, 0

        def gated():
            nonlocal single
            for r in seen:
                label = r[2] if r[3] >= threshold else "unknown"
                single += label != "unknown"
                raw[r[2]] = raw.get(r[2], 0) + 1
                yield label, r[3], r[4]

        for last in T.fuse_window(gated(), int(window), float(share), float(margin)):
            n += 1
            if last != "unknown":
                kept[last] = kept.get(last, 0) + 1
        truth = min((k for k in raw if k != "unknown"), key=lambda k: (-raw[k], k), default="unknown")
        yield threshold, int(window), share, margin, n, single, sum(kept.values()), max(kept.values(), default=0), int(last != "unknown"), int(last != "unknown" and last == truth)

    names = ["n", "single", "emitted", "leading", "selected", "right"]
    each = T.streamed(_seen(spark, d).join(F.broadcast(grid)), [*_FUSION, "track"], ["position"], fold, "threshold double, window int, share double, margin double, " + ", ".join(f"{c} long" for c in names))
    g = each.groupBy(*_FUSION).agg(*[F.sum(c).alias(c) for c in names], F.count("*").alias("tracks"))
    g = g.select(*_FUSION, X.ratio("right", "selected").alias("precision"), X.ratio("selected", "tracks").alias("coverage"), X.ratio("leading", "emitted").alias("stability"), X.ratio("single", "n").alias("single_coverage"), (1 - X.ratio("emitted", "n")).alias("abstention"))
    passing = (F.col("coverage") > 0) & (F.col("precision") >= 0.6) & (F.col("stability") >= 0.5)
    rank = [F.col("coverage"), F.col("single_coverage"), -F.col("abstention"), -F.col("threshold")]
    return chosen(g, passing, rank, [F.col("precision"), F.col("coverage"), F.col("stability")], [F.col(c) for c in _FUSION])


# ---- queues, cadence, budgets


@core.add("t7_admission_queue")
def t7(spark, d):
    def fold(seen):
        q, track = T.AdmissionQueue(16), None
        for track, pos, label, c, quality in seen:
            q.offer(f"{label}{pos % 40}", int(pos) + 1, int(c) * 10 + int(quality) % 10)
        for k, v in sorted(q.held.items()):
            yield track, k, v[0], v[1]

    return T.streamed(obs(spark, d), ["track"], ["pos"], fold, "track long, key string, sequence long, quality long")


def _by_run(spark, d):
    return _frames(spark, d).groupBy("run_id", "s").agg(F.min("t").alias("t"))


_RANKED_RUNS = f"WITH RECURSIVE {_FRAMES}, g AS (SELECT run_id, s, min(t) AS t FROM f GROUP BY 1, 2), r AS (SELECT *, s % 3000 AS age, row_number() OVER (PARTITION BY run_id ORDER BY t, s) AS i FROM g)"


@core.add(
    "r10_rate_windows",
    f"""{_RANKED_RUNS}, walk AS (SELECT run_id, i, t, t AS since, 1 AS n, CAST(NULL AS BIGINT) AS start, CAST(NULL AS DOUBLE) AS fps FROM r WHERE i = 1
    UNION ALL SELECT r.run_id, r.i, r.t, CASE WHEN r.t - w.since >= 60000 THEN r.t ELSE w.since END, CASE WHEN r.t - w.since >= 60000 THEN 0 ELSE w.n + 1 END, CASE WHEN r.t - w.since >= 60000 THEN w.since END, CASE WHEN r.t - w.since >= 60000 THEN (w.n + 1) * 1000.0 / (r.t - w.since) END
      FROM walk w JOIN r ON r.run_id = w.run_id AND r.i = w.i + 1) SELECT run_id, start AS start_ms, t AS end_ms, round(fps, 6) AS fps FROM walk WHERE fps IS NOT NULL""",
)
def r10(spark, d):
    def fold(frames):
        runs, again = itertools.tee(frames)
        run = next(runs)[0]
        del runs
        for a, b, x in T.fps_windows((int(r[2]) for r in again), 60_000):
            yield run, a, b, round(x, 6)

    return T.streamed(_by_run(spark, d), ["run_id"], ["t", "s"], fold, "run_id string, start_ms long, end_ms long, fps double")


def _picked(pick):
    """A fold that keeps the rows at the positions which pick, given an iterator over the rows, yields in rising order."""

    def fold(rows):
        rows, again = itertools.tee(rows)
        taken = pick(again)
        wanted = next(taken, None)
        for i, r in enumerate(rows):
            if wanted is None:
                return
            if i == wanted:
                yield r
                wanted = next(taken, None)

    return fold


@core.add(
    "r11_cadence",
    f"""{_RANKED_RUNS}, walk AS (SELECT run_id, s, t, i, age, t + 300000 AS due, true AS taken FROM r WHERE i = 1
    UNION ALL SELECT r.run_id, r.s, r.t, r.i, r.age, CASE WHEN r.t >= w.due THEN w.due + 300000 * ((r.t - w.due) // 300000 + 1) ELSE w.due END, r.t >= w.due FROM walk w JOIN r ON r.run_id = w.run_id AND r.i = w.i + 1)
    SELECT run_id, s, t FROM walk WHERE taken AND age <= 2400""",
)
def r11(spark, d):
    """Frames taken every five minutes of a run; a frame that is older than 2.4 s when it is due is dropped (ages are made up)."""

    def pick(rows):
        times, ages = itertools.tee(rows)
        return T.at_cadence((int(r[2]) for r in times), 300_000, (int(r[1]) % 3000 for r in ages), 2400)

    return T.streamed(_by_run(spark, d), ["run_id"], ["t", "s"], _picked(pick), "run_id string, s long, t long")


@core.add("r12_latest_per_trigger", f"WITH {_FRAMES} SELECT run_id, t // 60000 AS trigger, max(s) AS s, count(*) - 1 AS replaced FROM f GROUP BY 1, 2")
def r12(spark, d):
    return _frames(spark, d).groupBy("run_id", F.call_function("div", "t", F.lit(60_000)).alias("trigger")).agg(F.max("s").alias("s"), (F.count("*") - 1).alias("replaced"))


@core.add(
    "r14_micro_batches",
    f"""{_RANKED_RUNS}, walk AS (SELECT run_id, i, t, t AS first, 1 AS held, 0 AS batch FROM r WHERE i = 1
    UNION ALL SELECT r.run_id, r.i, r.t, CASE WHEN w.held >= 16 OR r.t > w.first + 900000 THEN r.t ELSE w.first END, CASE WHEN w.held >= 16 OR r.t > w.first + 900000 THEN 1 ELSE w.held + 1 END, CASE WHEN w.held >= 16 OR r.t > w.first + 900000 THEN w.batch + 1 ELSE w.batch END
      FROM walk w JOIN r ON r.run_id = w.run_id AND r.i = w.i + 1) SELECT run_id, batch, count(*) AS size FROM walk GROUP BY 1, 2""",
)
def r14(spark, d):
    """Batches of a run that close at 16 items, or a wait after the oldest (here 15 minutes, as frames are seconds apart)."""

    def fold(rows):
        rows, again = itertools.tee(rows)
        for r, batch in zip(rows, T.micro_batches((int(x[2]) for x in again), 16, 900_000), strict=True):
            yield r[0], batch

    out = T.streamed(_by_run(spark, d), ["run_id"], ["t", "s"], fold, "run_id string, batch int")
    return out.groupBy("run_id", "batch").agg(F.count("*").alias("size"))


@core.add(
    "r19_leases",
    """WITH RECURSIVE c AS (SELECT DISTINCT task_id, message_id, coalesce(ends_with(lower(trim(command_kind)), 'stop'), false) AS release, coalesce(worker_consumer, 'none') AS who, create_time_ms AS t, command_kind FROM camera_task_commands WHERE task_id IS NOT NULL AND create_time_ms IS NOT NULL AND message_id IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY t, message_id, who) AS i FROM c),
    walk AS (SELECT task_id, message_id, i, CASE WHEN release THEN NULL ELSE who END AS holder, CASE WHEN release THEN -1 ELSE t + 600000 END AS until, CASE WHEN release THEN 0 ELSE 1 END AS outcome FROM r WHERE i = 1
    UNION ALL SELECT r.task_id, r.message_id, r.i, CASE WHEN release AND live AND holder = who THEN NULL WHEN release OR live AND holder <> who THEN holder ELSE who END, CASE WHEN release OR live AND holder <> who THEN until ELSE t + 600000 END,
      CASE WHEN release THEN CAST(live AND holder = who AS INT) WHEN live AND holder <> who THEN 0 WHEN live THEN 2 ELSE 1 END
      FROM (SELECT w.*, r.t < w.until AND w.holder IS NOT NULL AS live FROM walk w JOIN r ON r.task_id = w.task_id AND r.i = w.i + 1) w JOIN r ON r.task_id = w.task_id AND r.i = w.i + 1)
    SELECT task_id, message_id, CAST(outcome AS INT) AS outcome FROM walk""",
)
def r19(spark, d):
    c = table(spark, d, "camera_task_commands").where("task_id is not null and create_time_ms is not null and message_id is not null").select("task_id", "message_id", "command_kind", F.coalesce("worker_consumer", F.lit("none")).alias("who"), F.col("create_time_ms").alias("t")).distinct()

    def fold(commands):
        rows, again = itertools.tee(commands)
        acts = ((int(t), "release" if (kind or "").strip().lower().endswith("stop") else "acquire", who, 600_000) for _, _, kind, who, t in again)
        for r, outcome in zip(rows, T.leases(acts), strict=True):
            yield r[0], r[1], outcome

    return T.streamed(c, ["task_id"], ["t", "message_id", "who"], fold, "task_id string, message_id string, outcome int")


@core.add("r24_photometric_clusters")
def r24(spark, d):
    # one number per source and value of luma, so a group is bounded by the range of luma in steps of a hundredth
    m = table(spark, d, "attribute_manifest").select("source_dataset", F.col("stage177_mean_luma").try_cast("double").alias("l")).where("l is not null").groupBy("source_dataset", "l").agg(F.count("*").alias("n"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            centres = T.three_means(pdf["l"].to_numpy(), pdf["n"].to_numpy())
        except ValueError:  # too few values, or an empty cluster: the source has no clusters
            return pd.DataFrame([(pdf["source_dataset"].iloc[0], -1, float("nan"))], columns=["source_dataset", "cluster", "centre"])
        return pd.DataFrame([(pdf["source_dataset"].iloc[0], i, round(x, 6)) for i, x in enumerate(centres)], columns=["source_dataset", "cluster", "centre"])

    return T.per_group(m, ["source_dataset"], ["l"], fold, "source_dataset string, cluster int, centre double")


@core.add(
    "w10_greedy_budget",
    """WITH RECURSIVE f AS (SELECT task_id, frame_id, min(size_bytes) AS size_bytes, min(capture_time_ms) AS t FROM camera_frames WHERE size_bytes IS NOT NULL AND frame_id IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, coalesce(task_id, '~') AS k, row_number() OVER (PARTITION BY task_id ORDER BY t, frame_id) AS i FROM f),
    walk AS (SELECT k, task_id, frame_id, size_bytes, i, CAST(CASE WHEN size_bytes <= 5000000 THEN size_bytes ELSE 0 END AS BIGINT) AS used, CAST(size_bytes <= 5000000 AS INT) AS n, size_bytes <= 5000000 AS taken FROM r WHERE i = 1
    UNION ALL SELECT r.k, r.task_id, r.frame_id, r.size_bytes, r.i, CAST(w.used + CASE WHEN w.n < 200 AND w.used + r.size_bytes <= 5000000 THEN r.size_bytes ELSE 0 END AS BIGINT), w.n + CAST(w.n < 200 AND w.used + r.size_bytes <= 5000000 AS INT), w.n < 200 AND w.used + r.size_bytes <= 5000000
      FROM walk w JOIN r ON r.k = w.k AND r.i = w.i + 1) SELECT task_id, frame_id, size_bytes FROM walk WHERE taken""",
)
def w10(spark, d):
    f = table(spark, d, "camera_frames").where("size_bytes is not null and frame_id is not null").groupBy("task_id", "frame_id").agg(F.min("size_bytes").alias("size_bytes"), F.min("capture_time_ms").alias("t"))
    fold = _picked(lambda rows: T.within_budget((int(r[2]) for r in rows), 5_000_000, 200))
    out = T.streamed(f, ["task_id"], ["t", "frame_id"], lambda rows: (r[:3] for r in fold(rows)), "task_id string, frame_id string, size_bytes long")
    return out


@core.add("w4_separate_windows")
def w4_windows(spark, d):
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        s = sorted(set(pdf["s"] // 64))  # numbered in steps of 64, so that runs of consecutive numbers occur
        starts = [a for a, b in zip(s, s[2:], strict=False) if b - a == 2]
        return pd.DataFrame([(pdf["run_id"].iloc[0], int(x)) for x in T.separate_windows(starts, 3, 10)], columns=["run_id", "start"])

    return T.per_group(_by_run(spark, d), ["run_id"], ["t", "s"], fold, "run_id string, start long")


@core.add("t13_ranked_caps")
def t13(spark, d, reach: int = 1600):
    """Rows ranked within a label; the first check that fails names the reason: class cap, source cap, near duplicate."""
    from ..functions import normal

    m = table(spark, d, "attribute_manifest").select(F.col("stage177_row_number").alias("row_number"), normal.label("body_type").alias("label"), F.col("source_dataset").alias("source"), normal.bits64("stage177_dhash64").alias("bits"), F.sha2("image_path", 256).alias("h")).where("label is not null and bits is not null")
    # The caps bound what the fold holds of a label, whatever its number of rows.
    near = lambda a, b: ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 3

    def fold(ranked):
        kept, per = [], {}
        for row, label, source, bits, _ in ranked:
            if len(kept) >= 200:
                reason = "class_cap"
            elif per.get(source, 0) >= 60:
                reason = "source_cap"
            elif any(near(int(bits), k) for k in kept):
                reason = "near_duplicate"
            else:
                reason, per[source] = "kept", per.get(source, 0) + 1
                kept.append(int(bits))
            yield int(row), label, reason

    # Once a label has all it may keep, every later row fails the cap. So only the first rows by rank are folded, more of
    # them only while some label is not full.
    scratch = Scratch(spark, "ranked-caps")
    m = scratch.keep(R.hash_rank(m, ["label"], "h", [F.col("h"), F.col("row_number")]), "ranked")
    while True:
        told = scratch.keep(T.streamed(m.where(F.col("_rank") <= reach).select("row_number", "label", "source", "bits", "h"), ["label"], ["h", "row_number"], fold, "row_number long, label string, reason string"), "told")
        full = told.groupBy("label").agg((F.count_if(F.col("reason") == "kept") >= 200).alias("full")).where("full").select("label")
        rest = m.where(F.col("_rank") > reach).select("row_number", "label")
        if rest.join(full, "label", "left_anti").isEmpty():
            return told.union(rest.select("row_number", "label", F.lit("class_cap")))
        scratch.drop(told)
        reach *= 4


@core.add("t9_seeded_split")
def t9(spark, d):
    from ..operators.sampling import seeded_split

    # the groups of a seeded shuffle are a list on the driver: cameras of the task table, not records
    groups = [r["task_id"] for r in table(spark, d, "camera_tasks").select("task_id").distinct().collect()]
    plan = spark.createDataFrame(list(seeded_split(groups).items()), "task_id string, split string")
    return table(spark, d, "camera_frames").join(F.broadcast(plan), "task_id").groupBy("split").agg(F.count("*").alias("n"))


@core.add("t11_rarity_split")
def t11(spark, d):
    """Videos go, those with the rarest labels first, to the split that lacks most of what they hold and still has room.

    A split's lack of a label is what is missing of its share, in proportion; ties go to the emptier split, then to a
    stable key. One stream of a row per video, with one number per label and split in memory.
    """
    from ..functions import normal
    from ..functions.predicates import BODY_TYPES

    m = table(spark, d, "attribute_manifest").select(normal.key("video_id").alias("g"), normal.label("body_type").alias("label")).where("g is not null").where(F.col("label").isin(*BODY_TYPES))
    per = m.groupBy("g", "label").agg(F.count("*").alias("n"))
    total = {r["label"]: r["n"] for r in per.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # a vocabulary
    per = per.join(F.broadcast(spark.createDataFrame(list(total.items()) or [("", 1)], "label string, total long")), "label")
    groups = per.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("counts"), F.round(-F.sum(F.col("n") / F.col("total")), 12).alias("rarity")).withColumn("one", F.lit(1)).withColumn("key", F.sha2(F.concat(F.lit("seed:"), F.col("g")), 256))
    number = groups.count()

    def fold(rows):
        for g, s in rarest_first(((r[1], r[2]) for r in rows), total, number):
            yield g, s

    return T.streamed(groups.select("one", "g", "counts", "rarity", "key"), ["one"], ["rarity", "key"], fold, "g string, split string")


def rarest_first(groups, total: dict[str, int], number: int, shares: tuple = (("train", 0.7), ("validation", 0.15), ("test", 0.15))):
    """(group, split) for groups (name, counts per label) that come rarest first; number: how many there are."""
    import hashlib

    room = {s: int(share * number) for s, share in shares}
    room[shares[0][0]] += number - sum(room.values())
    size = dict(room)
    wanted = {(s, label): n * room[s] / number for s in room for label, n in total.items()}
    lack = dict(wanted)
    for g, counts in groups:
        def score(s, g=g, counts=counts):
            missing = sum(max(0.0, lack[s, k]) * n / max(wanted[s, k], 1.0) for k, n in counts.items())
            return missing, room[s] / size[s], hashlib.sha256(f"seed:{g}:{s}".encode()).hexdigest()

        best = max((s for s in room if room[s]), key=score)
        room[best] -= 1
        for k, n in counts.items():
            lack[best, k] -= n
        yield g, best


@core.add("t12_bounded_plan")
def t12(spark, d):
    """Per task strata of frames up to a quota each, the scarcest first (available over wanted), then whatever else fits in
    order, within a number of frames and of bytes."""
    stratum = F.concat_ws("x", F.min("width"), F.min("height")).alias("stratum")
    f = table(spark, d, "camera_frames").where("size_bytes is not null and frame_id is not null").groupBy("task_id", "frame_id").agg(stratum, F.min("size_bytes").alias("size_bytes"))
    f = f.withColumn("h", F.sha2("frame_id", 256)).withColumn("scarce", F.count("*").over(Window.partitionBy("task_id", "stratum")) / 40.0)
    twice = f.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    first = F.col("turn") == 0
    order = twice.select("task_id", "stratum", "frame_id", "size_bytes", "turn", F.when(first, F.col("scarce")).otherwise(0.0).alias("scarce"), F.when(first, F.col("stratum")).otherwise("").alias("by"), "h")

    def fold(rows):
        for task, of, frame in bounded_plan(((r[:3], r[1], int(r[3]), r[4]) for r in rows), 40, 120, 20_000_000):
            yield task, of, frame

    return T.streamed(order, ["task_id"], ["turn", "scarce", "by", "h"], fold, "task_id string, stratum string, frame_id string")


def bounded_plan(offers, quota: int, most: int, budget: int):
    """What is taken of offers (item, stratum, size, turn): in turn 0 up to `quota` of each stratum, in turn 1 what is left."""
    taken, used, per = set(), 0, {}
    for item, stratum, size, turn in offers:
        if len(taken) == most:
            return
        if item in taken or used + size > budget or turn == 0 and per.get(stratum, 0) >= quota:
            continue
        taken.add(item)
        used += size
        per[stratum] = per.get(stratum, 0) + 1
        yield item


# ---- sources and sinks


def _scratch(spark, purpose):
    from ..session import Scratch

    return Scratch(spark, purpose).path("files")


@core.add("s3_csv_manifest", "SELECT CAST(stage177_row_number AS VARCHAR) AS stage177_row_number, coalesce(image_path, '') AS image_path, coalesce(color, '') AS color, coalesce(split, '') AS split FROM attribute_manifest")
def s3(spark, d):
    """Writes the manifest as CSV and reads it as strings: sink and scan in one."""
    at, names = _scratch(spark, "csv"), ["stage177_row_number", "image_path", "color", "split"]
    files.write_csv(table(spark, d, "attribute_manifest"), at, names)
    return files.csv_manifest(spark, at, names)


@core.add("s4_last_line_wins", "SELECT event_id, arg_max(status, (outbox_id, updated_at_ms, created_at_ms, status)) AS status FROM callback_outbox WHERE event_id IS NOT NULL GROUP BY event_id")
def s4(spark, d):
    at = _scratch(spark, "jsonl")
    o = table(spark, d, "callback_outbox").where("event_id is not null")
    # Files are named in the order of their ranges, so the order of lines is the order of the rows.
    o.repartitionByRange(4, "outbox_id", "updated_at_ms", "created_at_ms", "status").sortWithinPartitions("outbox_id", "updated_at_ms", "created_at_ms", "status").select("event_id", "status").write.json(at)
    return files.json_lines(spark, at, "event_id", "event_id string, status string")


@core.add("s7_coco", "SELECT relative_path AS file_name, task_id AS category, CAST(source_sequence % 100 AS DOUBLE) AS x, CAST(width AS DOUBLE) AS w FROM camera_frames WHERE frame_id IS NOT NULL AND task_id IS NOT NULL AND source_sequence IS NOT NULL AND relative_path IS NOT NULL")
def s7(spark, d):
    """One document per run, written as text and read as nested arrays."""
    at = _scratch(spark, "coco")
    f = table(spark, d, "camera_frames").where("frame_id is not null and task_id is not null and source_sequence is not null and relative_path is not null").withColumn("id", F.monotonically_increasing_id())
    part = f.withColumn("part", F.pmod(F.col("id"), F.lit(64)))
    docs = part.groupBy("run_id", "part").agg(
        F.collect_list(F.struct("id", F.col("relative_path").alias("file_name"), "width", "height")).alias("images"), F.array(F.struct(F.lit(1).alias("id"), F.min("task_id").alias("name"))).alias("categories"),
        F.collect_list(F.struct("id", F.col("id").alias("image_id"), F.lit(1).alias("category_id"), F.array((F.col("source_sequence") % 100).cast("double"), F.lit(0.0), F.col("width").cast("double"), F.col("height").cast("double")).alias("bbox"))).alias("annotations"),
    )
    docs.select(F.to_json(F.struct("images", "categories", "annotations")).alias("value")).write.text(at)
    # the lines are documents of their own, told apart by the position of the line
    lines = spark.read.text(at).select(F.monotonically_increasing_id().alias("doc"), F.from_json("value", files.COCO).alias("r")).select("doc", "r.*")
    images = lines.select("doc", F.explode("images").alias("i")).select("doc", F.col("i.id").alias("image_id"), "i.file_name")
    names = lines.select("doc", F.explode("categories").alias("c")).select("doc", F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    boxes = lines.select("doc", F.explode("annotations").alias("a")).select("doc", "a.image_id", "a.category_id", "a.bbox")
    return boxes.join(images, ["doc", "image_id"]).join(names, ["doc", "category_id"]).select("file_name", "category", F.get("bbox", 0).alias("x"), F.get("bbox", 2).alias("w"))


@core.add("s8_track_xml", "SELECT camera_id AS sequence, CAST(track_id AS INT) AS target, vehicle_class AS vehicle_type, count(*) AS n FROM vehicle_track_results WHERE camera_id IS NOT NULL AND track_id IS NOT NULL AND regexp_full_match(vehicle_class, '[a-z_]+') GROUP BY 1, 2, 3")
def s8(spark, d):
    """Sequences of frames of targets, written and read by the built-in XML source."""
    at = _scratch(spark, "xml")
    t = table(spark, d, "vehicle_track_results").where("camera_id is not null and track_id is not null").where(F.col("vehicle_class").rlike("^[a-z_]+$"))
    box = F.struct(*[F.lit(float(i)).alias(f"_{c}") for i, c in enumerate(("left", "top", "width", "height"))])
    target = F.struct(F.col("track_id").cast("int").alias("_id"), box.alias("box"), F.struct(F.col("vehicle_class").alias("_vehicle_type")).alias("attribute"))
    frame = F.struct(F.lit(1).alias("_num"), F.struct(F.array(target).alias("target")).alias("target_list"))
    part = F.pmod(F.xxhash64("event_id"), F.lit(32)).alias("part")
    seq = t.groupBy(F.col("camera_id").alias("_name"), part).agg(F.collect_list(frame).alias("frame"))
    seq = seq.select("_name", F.struct(F.lit("sunny").alias("_sence_weather")).alias("sequence_attribute"), "frame")
    seq.write.format("xml").option("rootTag", "sequences").option("rowTag", "sequence").save(at)
    return files.track_xml(spark, at).groupBy("sequence", "target", "vehicle_type").agg(F.count("*").alias("n"))


@core.add(
    "k1_insert_new",
    """WITH n AS (SELECT event_id, created_at_ms, row_number() OVER (PARTITION BY event_id ORDER BY created_at_ms, fingerprint) AS k FROM security_alert_events), held AS (SELECT DISTINCT event_id FROM callback_outbox WHERE event_id IS NOT NULL)
    SELECT event_id, created_at_ms, CASE WHEN n.event_id IS NULL THEN 'not_null_violation' WHEN k > 1 OR event_id IN (SELECT event_id FROM held) THEN 'unique_violation' ELSE 'inserted' END AS outcome FROM n""",
)
def k1(spark, d):
    """Every row offered with what becomes of it: inserted, or the constraint that it breaks."""
    new = table(spark, d, "security_alert_events").select("event_id", "created_at_ms", "fingerprint")
    return R.inserted(table(spark, d, "callback_outbox"), new, "event_id", [F.asc("created_at_ms"), F.asc("fingerprint")]).select("event_id", "created_at_ms", "outcome")


@core.add("k5_write_once", "SELECT count(*) AS n, CAST(sum(severity) AS BIGINT) AS severity FROM security_alert_events")
def k5(spark, d):
    at = _scratch(spark, "once")
    files.publish(table(spark, d, "security_alert_events"), at)
    return spark.read.parquet(at).agg(F.count("*").alias("n"), F.sum("severity").alias("severity"))


@core.add("k7_metric_lines", "SELECT 'frames_total{task=\"' || task_id || '\"} ' || count(*) AS line FROM camera_frames WHERE task_id IS NOT NULL GROUP BY task_id")
def k7(spark, d):
    m = table(spark, d, "camera_frames").where("task_id is not null").groupBy("task_id").agg(F.count("*").alias("value")).withColumn("name", F.lit("frames_total"))
    return files.metric_lines(m, labels={"task": "task_id"})


@core.add("s10_stream_gaps", f"WITH {_FRAMES}, u AS (SELECT DISTINCT run_id, s FROM f), g AS (SELECT run_id, s - lag(s) OVER (PARTITION BY run_id ORDER BY s) - 1 AS gap FROM u) SELECT run_id, count(*) AS frames, CAST(coalesce(sum(greatest(0, gap)), 0) AS BIGINT) AS missed FROM g GROUP BY run_id")
def s10(spark, d):
    w = Window.partitionBy("run_id").orderBy("s")
    g = _frames(spark, d).select("run_id", "s").distinct().withColumn("gap", F.col("s") - F.lag("s").over(w) - 1)
    return g.groupBy("run_id").agg(F.count("*").alias("frames"), F.coalesce(F.sum(F.greatest(F.lit(0), F.col("gap"))), F.lit(0)).alias("missed"))


@core.add("s11_reclaimable", f"SELECT message_id, task_id, delivered_at_ms FROM camera_task_commands WHERE delivered_at_ms IS NOT NULL AND {NOW} - delivered_at_ms >= 30000")
def s11(spark, d):
    return table(spark, d, "camera_task_commands").where(F.col("delivered_at_ms").isNotNull() & (F.lit(NOW) - F.col("delivered_at_ms") >= 30_000)).select("message_id", "task_id", "delivered_at_ms")


@core.add("s5_json_documents", "SELECT task_id, version, algorithms[1] AS first_algorithm, len(algorithms) AS n FROM camera_tasks")
def s5(spark, d):
    """A document per row, indented over several lines, read back as nested objects."""
    at = _scratch(spark, "documents")
    body = F.to_json(F.struct("task_id", "version", "algorithms"), {"pretty": "true"})
    t = table(spark, d, "camera_tasks")
    t.select(body.alias("value")).repartitionByRange(t.count() or 1, "value").write.text(at)  # a file per task of the task table
    docs = files.json_document(spark, at, "task_id string, version int, algorithms array<string>").where("task_id is not null")
    return docs.select("task_id", "version", F.get("algorithms", 0).alias("first_algorithm"), F.size("algorithms").cast("long").alias("n"))


@core.add("s6_box_files", "SELECT count(*) AS lines, count(*) FILTER (source_sequence % 11 <> 0) AS valid, CAST(sum(source_sequence % 10) FILTER (source_sequence % 11 <> 0) AS BIGINT) AS classes FROM camera_frames WHERE source_sequence IS NOT NULL")
def s6(spark, d):
    at = _scratch(spark, "boxes")
    s = F.col("source_sequence")
    line = F.concat_ws(" ", (s % 10).cast("string"), F.lit("0.5 0.5 0.25"), F.when(s % 11 != 0, "0.25"))
    table(spark, d, "camera_frames").where("source_sequence is not null").select(line.alias("value")).repartition(32).write.text(at)
    b = files.box_lines(spark, at)
    return b.agg(F.count("*").alias("lines"), F.count_if("valid").alias("valid"), F.sum(F.when(F.col("valid"), F.col("class_id"))).alias("classes"))


@core.add(
    "k2_multi_table_insert",
    """WITH e AS (SELECT event_id, min(created_at_ms) AS c FROM vehicle_track_results WHERE event_id IS NOT NULL GROUP BY event_id)
    SELECT 'vision_events' AS table_name, count(*) AS n, CAST(sum(c % 1000) AS BIGINT) AS checksum FROM e UNION ALL SELECT 'vehicle_track_results', count(*), CAST(sum(c % 1000) AS BIGINT) FROM e UNION ALL SELECT 'callback_outbox', count(*), CAST(sum(c % 1000) AS BIGINT) FROM e""",
)
def k2(spark, d):
    """Three tables from one written batch, which readers see together or not at all."""
    at = _scratch(spark, "batch")
    batch = table(spark, d, "vehicle_track_results").where("event_id is not null").groupBy("event_id").agg(F.min("created_at_ms").alias("c"))
    batch.write.parquet(f"{at}/batch")
    kept = spark.read.schema(batch.schema).parquet(f"{at}/batch")
    names = ("vision_events", "vehicle_track_results", "callback_outbox")
    files.commit_batch({n: kept for n in names}, f"{at}/store", "batch-1")
    out = None
    for n in names:
        one = files.committed(spark, f"{at}/store", n, batch.schema).agg(F.count("*").alias("n"), F.sum(F.col("c") % 1000).alias("checksum")).select(F.lit(n).alias("table_name"), "n", "checksum")
        out = one if out is None else out.union(one)
    return out


@core.add("k4_report", """SELECT '{' || chr(10) || '  "frames": ' || count(*) || ',' || chr(10) || '  "tasks": ' || count(DISTINCT task_id) || chr(10) || '}' || chr(10) AS report FROM camera_frames""")
def k4(spark, d):
    """The report as its file holds it: indented by two, with a final line end."""
    g = table(spark, d, "camera_frames").agg(F.count("*").alias("frames"), F.count_distinct("task_id").alias("tasks"))
    return spark.createDataFrame([(files.report_json(g),)], "report string")


@core.add("s9_archive_members", "SELECT task_id AS archive, 'task.csv' AS member, 'version,' || version AS text FROM camera_tasks")
def s9(spark, d):
    """An archive per task, with one member that is allowed and two that are not, packed and read again."""
    import io
    import zipfile

    def pack(frames):
        for pdf in frames:
            out = []
            for task, version in zip(pdf["task_id"], pdf["version"], strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    for name in ("task.csv", "../task.csv", "task.txt"):
                        z.writestr(name, f"version,{version}")
                out.append((task, held.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    packed = table(spark, d, "camera_tasks").select("task_id", "version").mapInPandas(pack, "path string, content binary")
    return files.members_of(packed).select("archive", "member", F.decode("content", "UTF-8").alias("text"))


@core.add(
    "v10_content_pins",
    """SELECT 'vision_events' AS table_name, count(*) AS n, bit_xor(CAST('0x' || substr(sha256(event_id || '|' || created_at_ms), 1, 15) AS BIGINT)) AS pin FROM vision_events WHERE event_id IS NOT NULL AND created_at_ms IS NOT NULL
    UNION ALL SELECT 'camera_frames', count(*), bit_xor(CAST('0x' || substr(sha256(frame_id || '|' || save_time_ms), 1, 15) AS BIGINT)) FROM camera_frames WHERE frame_id IS NOT NULL AND save_time_ms IS NOT NULL""",
)
def v10(spark, d):
    """A pin of a table's content that depends on neither order nor files."""
    out = None
    for name, key, at in (("vision_events", "event_id", "created_at_ms"), ("camera_frames", "frame_id", "save_time_ms")):
        digest = F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.col(at).cast("string")), 256), 1, 15), 16, 10).cast("long")
        t = table(spark, d, name).where(F.col(key).isNotNull() & F.col(at).isNotNull())
        one = t.agg(F.count("*").alias("n"), F.bit_xor(digest).alias("pin")).select(F.lit(name).alias("table_name"), "n", "pin")
        out = one if out is None else out.union(one)
    return out


@core.add(
    "s12_produce_and_acknowledge",
    """WITH m AS (SELECT message_id, min(create_time_ms) AS t, coalesce(bool_or(delivered_at_ms - create_time_ms <= 500), false) AS acknowledged FROM camera_task_commands WHERE message_id IS NOT NULL GROUP BY message_id)
    SELECT message_id, t, row_number() OVER (ORDER BY t, message_id) AS place FROM m WHERE NOT acknowledged""",
)
def s12(spark, d):
    """Messages are appended to a stream, a consumer acknowledges what it got within half a second; what is pending comes out, oldest first."""
    at = _scratch(spark, "stream")
    m = table(spark, d, "camera_task_commands").where("message_id is not null")
    files.produce(m.groupBy("message_id").agg(F.min("create_time_ms").alias("t")), f"{at}/messages")
    files.acknowledge(m.where("delivered_at_ms - create_time_ms <= 500").select("message_id"), f"{at}/acknowledged")
    pending = files.pending(spark, f"{at}/messages", f"{at}/acknowledged", "message_id")
    return pending.select("message_id", "t", F.row_number().over(Window.orderBy("t", "message_id")).cast("long").alias("place"))  # what is not acknowledged


@core.add(
    "s10_latest_after_cursor",
    f"WITH {_FRAMES}, u AS (SELECT run_id, s, min(t) AS t FROM f GROUP BY 1, 2), c AS (SELECT run_id, min(s) + 100 AS cursor FROM u GROUP BY 1) SELECT run_id, cursor, max(s) AS s, arg_max(t, s) AS t, max(s) - cursor - 1 AS gap FROM u JOIN c USING (run_id) WHERE s > cursor GROUP BY 1, 2",
)
def s10_latest(spark, d):
    """What a hub that keeps the latest frame only returns to a reader at a cursor: the newest frame after it, if there is
    one, and how many the reader has missed."""
    u = _by_run(spark, d)
    cursors = u.groupBy("run_id").agg((F.min("s") + 100).alias("cursor"))
    return files.latest_after(u, cursors, "run_id", "s").select("run_id", "cursor", "s", "t", "gap")


@core.add(
    "s11_group_reads",
    f"""WITH m AS (SELECT message_id, min(create_time_ms) AS t, max(delivered_at_ms) AS delivered, arg_max(worker_consumer, coalesce(delivered_at_ms, 0)) AS held FROM camera_task_commands WHERE message_id IS NOT NULL GROUP BY 1),
    w AS (SELECT worker_consumer AS worker, row_number() OVER (ORDER BY worker_consumer) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT worker_consumer FROM camera_task_commands WHERE worker_consumer IS NOT NULL)),
    fresh AS (SELECT message_id, row_number() OVER (ORDER BY t, message_id) AS k FROM m WHERE delivered IS NULL), idle AS (SELECT message_id, 1 + (row_number() OVER (ORDER BY delivered, message_id) - 1) % (SELECT max(n) FROM w) AS k FROM m WHERE delivered IS NOT NULL AND {NOW} - delivered >= 30000)
    SELECT message_id, worker, 'new' AS how FROM fresh JOIN w USING (k) UNION ALL SELECT message_id, worker, 'reclaimed' FROM idle JOIN w USING (k)""",
)
def s11_groups(spark, d):
    """A consumer group: each worker takes one of the oldest new messages; messages that somebody took and left for half a
    minute go round the workers, the longest idle first."""
    c = table(spark, d, "camera_task_commands")
    m = c.where("message_id is not null").groupBy("message_id").agg(F.min("create_time_ms").alias("t"), F.max("delivered_at_ms").alias("delivered"))
    workers = c.where("worker_consumer is not null").select(F.col("worker_consumer").alias("worker")).distinct()
    return files.group_reads(m, workers, F.lit(NOW), 30_000)
