"""Queries over observations and predictions: counts, votes, metrics, windows, thresholds, samples, audits, near matches.

The stream of observations is the table `events`: a user is a track, the event's number its position, the type its label
('error' stands for unknown), the number k in props its confidence in per cent and the value its quality. As predictions,
the same rows carry a truth that agrees the more often the higher the confidence. Weights are whole numbers, so that sums
do not depend on the order of addition.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import normal
from ..functions import predicates as P
from ..functions import scalar as X
from ..operators import calibration as C
from ..operators import consensus as V
from ..operators import relational as R
from ..operators import sampling as S
from ..operators import similarity as H
from ..session import Scratch
from ..sources.tables import table
from . import spell
from .registry import core

OBS = """obs AS (SELECT user_id AS track, event_id AS pos, CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS label, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS c,
    least(500, coalesce(CAST(round(value) AS BIGINT), 0)) AS q FROM events)"""
PRED = """pred AS (SELECT user_id AS track, event_id AS id, event_type AS label, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS c, event_id % 4 AS domain,
    CASE WHEN (event_id * 7) % 100 < coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) THEN event_type WHEN event_type = 'click' THEN 'view' ELSE 'click' END AS truth FROM events)"""


def obs(spark, d):
    label = F.when(F.col("event_type") == "error", "unknown").otherwise(F.col("event_type"))
    return table(spark, d, "events").select(
        F.col("user_id").alias("track"), F.col("event_id").alias("pos"), label.alias("label"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("c"),
        F.least(F.lit(500), F.coalesce(F.round("value").cast("long"), F.lit(0))).alias("q"),
    )


def pred(spark, d):
    c = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    truth = F.when((F.col("event_id") * 7) % 100 < c, F.col("event_type")).when(F.col("event_type") == "click", "view").otherwise("click")
    return table(spark, d, "events").select(F.col("user_id").alias("track"), F.col("event_id").alias("id"), F.col("event_type").alias("label"), c.alias("c"), (F.col("event_id") % 4).alias("domain"), truth.alias("truth"))


def manifest(spark, d):
    return table(spark, d, "attribute_manifest").withColumnRenamed("stage177_row_number", "row_number")


SPLIT, BODY, COLOR = spell.split_name("split"), spell.key("body_type"), spell.color("color")

def _yes(c):
    return f"lower(trim(coalesce({c}, ''), ' ')) IN ('1', 'true', 'yes', 'y', 'on')"


# ---- counts


#: The counters of a manifest: one key or two, joined by a bar.
_COUNTERS = {"split": 1, "source": 1, "license": 1, "body": 1, "color": 1, "split|body": 2, "split|color": 2, "source|body": 2, "source|color": 2, "split|source": 2}
_SETS = [tuple(k.split("|")) for k in _COUNTERS]


def _name_sql(names=("split", "source", "license", "body", "color")) -> tuple[str, str]:
    case = "CASE " + " ".join("WHEN " + " AND ".join(f"grouping({n}) = {int(n not in s)}" for n in names) + f" THEN '{'|'.join(s)}'" for s in _SETS) + " END"
    key = "CASE " + " ".join("WHEN " + " AND ".join(f"grouping({n}) = {int(n not in s)}" for n in names) + f" THEN {' || chr(124) || '.join(s)}" for s in _SETS) + " END"
    return case, key


@core.add(
    "a3_group_counters",
    f"""WITH m AS (SELECT coalesce({SPLIT}, 'unknown') AS split, coalesce({spell.key('source_dataset')}, 'unknown') AS source, coalesce({spell.key('source_license')}, 'unknown') AS license,
      CASE WHEN {_yes('body_type_supervised')} THEN {BODY} END AS body, CASE WHEN {_yes('color_supervised')} THEN {COLOR} END AS color,
      unnest([{', '.join(f"CASE WHEN {_yes(t)} THEN '{t}' END" for t in ('blur', 'occluded', 'truncated', 'night'))}]) AS tag, unnest([1, 2, 3, 4]) AS i FROM attribute_manifest),
    c AS (SELECT {_name_sql()[0]} AS counter, {_name_sql()[1]} AS key, count(*) AS n FROM m WHERE i = 1 GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(s) + ')' for s in _SETS)}))
    SELECT counter, key, n FROM c WHERE key IS NOT NULL UNION ALL SELECT 'hard_tags', tag, count(*) FROM m WHERE tag IS NOT NULL GROUP BY tag""",
)
def a3(spark, d):
    """Eleven counters in one pass of grouping sets, and the tags. Labels count where they are supervised and known."""
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    m = manifest(spark, d).select(
        known(normal.split_name("split")).alias("split"), known(normal.key("source_dataset")).alias("source"), known(normal.key("source_license")).alias("license"),
        F.when(P.truthy("body_type_supervised"), normal.label("body_type")).alias("body"), F.when(P.truthy("color_supervised"), normal.color("color")).alias("color"),
        F.array_compact(F.array(*[F.when(P.truthy(t), F.lit(t)) for t in ("blur", "occluded", "truncated", "night")])).alias("tags"),
    )
    names = ["split", "source", "license", "body", "color"]
    g = m.groupingSets([[m[n] for n in s] for s in _SETS], *names).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    counter = key = F
    for s in _SETS:
        here = F.col("level") == sum(1 << (len(names) - 1 - i) for i, n in enumerate(names) if n not in s)
        counter = counter.when(here, "|".join(s))
        key = key.when(here, F.concat(*[x for n in s for x in (F.lit("|"), F.col(n))][1:]))
    tags = m.select(F.explode("tags").alias("key")).groupBy("key").agg(F.count("*").alias("n")).select(F.lit("hard_tags").alias("counter"), "key", "n")
    return g.select(counter.alias("counter"), key.alias("key"), "n").where("key is not null").union(tags)


@core.add("a4_tag_counts", "SELECT tag, count(*) AS n FROM (SELECT unnest(algorithms) AS tag FROM camera_task_commands) WHERE tag <> '' GROUP BY tag")
def a4(spark, d):
    return table(spark, d, "camera_task_commands").select(F.explode("algorithms").alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))


@core.add(
    "a5_distinct_tuples",
    f"SELECT source_dataset, count(DISTINCT {spell.key('camera_id')}) AS cameras, count(DISTINCT video_id) AS videos, count(DISTINCT CASE WHEN {spell.key('track_group')} IS NOT NULL THEN video_id || '|' || {spell.key('track_group')} END) AS tracks FROM attribute_manifest GROUP BY source_dataset",
)
def a5(spark, d):
    track = normal.key("track_group")
    return manifest(spark, d).groupBy("source_dataset").agg(F.count_distinct(normal.key("camera_id")).alias("cameras"), F.count_distinct("video_id").alias("videos"), F.count_distinct(F.when(track.isNotNull(), F.concat_ws("|", "video_id", track))).alias("tracks"))


# ---- votes


@core.add(
    "a6_weighted_vote",
    f"""WITH {OBS}, p AS (SELECT track, label, CAST(sum(c * q) AS BIGINT) AS w, CAST(sum(q * 100) AS BIGINT) AS b, count(*) AS n FROM obs GROUP BY 1, 2), a AS (SELECT track, CAST(sum(b) AS BIGINT) AS b FROM p GROUP BY 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY w DESC, label) AS k FROM p WHERE label <> 'unknown')
    SELECT a.track, CASE WHEN coalesce(n, 0) >= 3 AND coalesce(w / nullif(a.b, 0), 0) >= 0.12 THEN label ELSE 'unknown' END AS label, coalesce(w / nullif(a.b, 0), 0) AS confidence, coalesce(n, 0) AS samples,
    coalesce(n, 0) >= 3 AND coalesce(w / nullif(a.b, 0), 0) >= 0.12 AS stable FROM a LEFT JOIN k ON k.track = a.track AND k = 1""",
)
def a6(spark, d):
    return V.weighted_vote(obs(spark, d), ["track"], "label", F.col("c") * F.col("q"), F.col("q") * 100, 3, 0.12)


@core.add(
    "a7_share_margin_vote",
    f"""WITH {OBS}, p AS (SELECT track, label, CAST(sum(c * q) AS BIGINT) AS w FROM obs WHERE label <> 'unknown' GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY w DESC, label) AS k, CAST(sum(w) OVER (PARTITION BY track) AS BIGINT) AS a FROM p),
    t AS (SELECT track, max(label) FILTER (k = 1) AS label, max(a) AS a, max(w) FILTER (k = 1) AS f, coalesce(max(w) FILTER (k = 2), 0) AS s FROM k GROUP BY 1)
    SELECT o.track, CASE WHEN a > 0 AND f / a >= 0.3 AND (f - s) / a >= 0.02 THEN label ELSE 'unknown' END AS label, coalesce(f / nullif(a, 0), 0) AS share, coalesce((f - s) / nullif(a, 0), 0) AS margin FROM (SELECT DISTINCT track FROM obs) o LEFT JOIN t ON t.track = o.track""",
)
def a7(spark, d):
    return V.share_margin_vote(obs(spark, d), ["track"], "label", F.col("c") * F.col("q"), 0.3, 0.02)


@core.add(
    "a8_majority",
    f"""WITH {OBS}, p AS (SELECT track, label, count(*) AS n FROM obs GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY n DESC, label) AS k FROM p WHERE label <> 'unknown'), a AS (SELECT track, CAST(sum(n) AS BIGINT) AS a FROM p GROUP BY 1)
    SELECT a.track, CASE WHEN coalesce(n / a, 0) >= 0.24 THEN label ELSE 'unknown' END AS label, coalesce(n / a, 0) AS share FROM a LEFT JOIN k ON k.track = a.track AND k = 1""",
)
def a8(spark, d):
    return V.majority(obs(spark, d), ["track"], "label", 0.24)


@core.add(
    "a9_view_consensus",
    f"""WITH {OBS}, p AS (SELECT track, label, count(*) AS n, min(c) AS c FROM obs WHERE c >= 20 GROUP BY 1, 2) SELECT track, label, c AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY n DESC, label DESC) AS k FROM p) WHERE k = 1 AND n >= 4 AND c >= 22""",
)
def a9(spark, d):
    return V.view_consensus(obs(spark, d).where("c >= 20"), ["track"], "label", "c", 4, 22)


@core.add(
    "a10_unanimity",
    f"""WITH {OBS}, v AS (SELECT pos // 3 AS item, pos % 3 AS teacher, label, c FROM obs) SELECT item, min(label) AS label, min(c) AS confidence FROM v GROUP BY item HAVING count(*) = 3 AND min(label) = max(label)""",
)
def a10(spark, d):
    v = obs(spark, d).select(F.call_function("div", "pos", F.lit(3)).alias("item"), "label", "c")
    return V.unanimous(v, ["item"], "label", "c", 3)


@core.add(
    "a11_mean_vector",
    """WITH v AS (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings), m AS (SELECT label, i - 1 AS position, avg(CAST(embedding[i] AS DOUBLE)) AS mean FROM v GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean DESC, position) AS k FROM m)
    SELECT label, max(position) FILTER (k = 1) AS top, round(max(mean) FILTER (k = 1) - max(mean) FILTER (k = 2), 6) AS margin FROM k GROUP BY label""",
)
def a11(spark, d):
    e = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    w = Window.partitionBy("label").orderBy(F.desc("mean"), "position")
    k = V.mean_vector(e, ["label"], "v").withColumn("k", F.row_number().over(w))
    at = lambda c, i: F.max(F.when(F.col("k") == i, F.col(c)))
    return k.groupBy("label").agg(at("position", 1).cast("long").alias("top"), F.round(at("mean", 1) - at("mean", 2), 6).alias("margin"))


_WEATHER = {"rain": "rain|regen|lluvia|大雨", "fog": "fog|nebel|niebla|浓雾", "snow": "snow|schnee|nieve|小雪"}
#: What a text is about if it is about none of the labels: it says nothing, whatever else it mentions.
_NOT_MEANT = "power supply|netzteil|fuente|电源"


@core.add(
    "a31_text_consensus",
    f"""WITH t AS (SELECT coalesce(task_id, '') AS task_id, {', '.join(f"CAST(regexp_matches(lower(text), '{p}') AS INT) AS {n}" for n, p in _WEATHER.items())}, regexp_matches(lower(text), '{_NOT_MEANT}') AS other FROM documents WHERE text IS NOT NULL),
    u AS (SELECT task_id, CASE WHEN rain = 1 THEN 'rain' WHEN fog = 1 THEN 'fog' ELSE 'snow' END AS label FROM t WHERE rain + fog + snow = 1 AND NOT other)
    SELECT task_id, count(*) AS usable, CASE WHEN count(DISTINCT label) = 1 AND count(*) >= 2 THEN min(label) ELSE 'unknown' END AS label, CASE WHEN count(DISTINCT label) > 1 THEN 'conflict' WHEN count(*) < 2 THEN 'too_few' ELSE 'agreed' END AS reason FROM u GROUP BY task_id""",
)
def a31(spark, d):
    """A text counts if it matches exactly one label and nothing that voids it; a task's texts have to agree, two at least."""
    has = {n: F.lower("text").rlike(p) for n, p in _WEATHER.items()}
    t = table(spark, d, "documents").where("text is not null").select(F.coalesce("task_id", F.lit("")).alias("task_id"), *[c.alias(n) for n, c in has.items()], F.lower("text").rlike(_NOT_MEANT).alias("other"))
    u = t.where((sum(F.col(n).cast("int") for n in _WEATHER) == 1) & ~F.col("other")).select("task_id", F.when(F.col("rain"), "rain").when(F.col("fog"), "fog").otherwise("snow").alias("label"))
    g = u.groupBy("task_id").agg(F.count("*").alias("usable"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    reason = P.first_reason(("conflict", F.col("lo") != F.col("hi")), ("too_few", F.col("usable") < 2), otherwise="agreed")
    return g.select("task_id", "usable", F.when(reason == "agreed", F.col("lo")).otherwise("unknown").alias("label"), reason.alias("reason"))


@core.add(
    "a32_strong_tracks",
    f"""WITH {OBS}, g AS (SELECT track, count(*) FILTER (c >= 98 AND label <> 'unknown') AS n_strong, count(*) AS n, min(label) FILTER (c >= 98 AND label <> 'unknown') AS lo, max(label) FILTER (c >= 98 AND label <> 'unknown') AS hi FROM obs GROUP BY 1)
    SELECT track, CASE WHEN n_strong >= 1 AND lo = hi AND n_strong >= 0.001 * n THEN lo END AS label, n_strong, n FROM g""",
)
def a32(spark, d):
    strong = (F.col("c") >= 98) & (F.col("label") != "unknown")
    return V.strong_track(obs(spark, d), ["track"], "label", strong, 1, 0.001)


@core.add(
    "a25_exact_group_merge",
    f"""WITH m AS (SELECT {spell.digest('stage177_pixel_sha256')} AS h, image_path, {COLOR} AS color, lower(trim(coalesce(night, ''), ' ')) IN ('1', 'true', 'yes', 'y', 'on') AS night FROM attribute_manifest)
    SELECT h, min(image_path) AS image_path, CASE WHEN count(DISTINCT color) = 1 THEN min(color) ELSE 'unknown' END AS color, count(DISTINCT color) > 1 AS conflict, bool_or(night) AS night, count(*) AS n FROM m WHERE h IS NOT NULL GROUP BY h""",
)
def a25(spark, d):
    m = manifest(spark, d).select(normal.digest("stage177_pixel_sha256").alias("h"), "image_path", normal.color("color").alias("color"), P.truthy("night").alias("night")).where("h is not null")
    # min and max tell whether there are several values, without collecting them
    g = m.groupBy("h").agg(F.min("image_path").alias("image_path"), F.min("color").alias("lo"), F.max("color").alias("hi"), F.bool_or("night").alias("night"), F.count("*").alias("n"))
    return g.select("h", "image_path", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("unknown").alias("color"), F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("conflict"), "night", "n")


@core.add(
    "a24_scene_groups",
    f"SELECT video_id, count(*) AS n, avg(CASE WHEN lower(trim(stage177_scene_label, ' ')) = 'night' THEN 1.0 ELSE 0.0 END) AS fraction, avg(CASE WHEN try_cast(stage177_mean_luma AS DOUBLE) <= 89.25 THEN 1.0 ELSE 0.0 END) AS dark, median(1 - try_cast(stage177_mean_luma AS DOUBLE) / 255) AS score,"
    " coalesce(dark >= 0.8 AND score >= 0.65, false) AS low_light, coalesce(fraction >= 0.8 AND score >= 0.78, false) AS night FROM attribute_manifest WHERE video_id IS NOT NULL GROUP BY video_id HAVING count(*) >= 3",
)
def a24(spark, d):
    """Scenes of at least three pictures and what they agree on: a share of 0.8 and a median score (darkness) of 0.65 or 0.78."""
    luma = F.col("stage177_mean_luma").try_cast("double")
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    g = manifest(spark, d).where("video_id is not null").groupBy("video_id").agg(
        F.count("*").alias("n"), share(F.lower(F.trim("stage177_scene_label")) == "night").alias("fraction"), share(luma <= 89.25).alias("dark"), F.median(1 - luma / 255).alias("score")
    ).where("n >= 3")
    agreed = lambda c, score: F.coalesce((F.col(c) >= 0.8) & (F.col("score") >= score), F.lit(False))
    return g.withColumn("low_light", agreed("dark", 0.65)).withColumn("night", agreed("fraction", 0.78))


# ---- metrics


@core.add(
    "a12_selective_metrics",
    f"""WITH {PRED}, g AS (SELECT domain, count(*) AS evaluated, count(*) FILTER (label <> 'error' AND c >= 60) AS selected, count(*) FILTER (label <> 'error' AND c >= 60 AND label = truth) AS correct FROM pred GROUP BY domain)
    SELECT *, coalesce(correct / nullif(selected, 0), 0) AS precision, coalesce(selected / nullif(evaluated, 0), 0) AS coverage, 1 - coalesce(selected / nullif(evaluated, 0), 0) AS unknown_rate FROM g""",
)
def a12(spark, d):
    sel = (F.col("label") != "error") & (F.col("c") >= 60)
    g = pred(spark, d).groupBy("domain").agg(F.count("*").alias("evaluated"), F.count_if(sel).alias("selected"), F.count_if(sel & (F.col("label") == F.col("truth"))).alias("correct"))
    return g.select("*", X.ratio("correct", "selected").alias("precision"), X.ratio("selected", "evaluated").alias("coverage"), (1 - X.ratio("selected", "evaluated")).alias("unknown_rate"))


@core.add(
    "a13_macro_f1",
    f"""WITH {PRED}, l AS (SELECT label AS k, count(*) FILTER (label = truth) AS tp, count(*) AS p, 0 AS t FROM pred GROUP BY 1 UNION ALL SELECT truth, 0, 0, count(*) FROM pred GROUP BY 1), g AS (SELECT k, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(p) + sum(t) AS BIGINT) AS d FROM l GROUP BY 1)
    SELECT round(avg(2 * tp / d), 9) AS macro_f1, count(*) AS classes FROM g WHERE d > 0""",
)
def a13(spark, d):
    p = pred(spark, d)
    each = p.groupBy(F.col("label").alias("k")).agg(F.count_if(F.col("label") == F.col("truth")).alias("tp"), F.count("*").alias("n")).union(p.groupBy("truth").agg(F.lit(0).cast("long"), F.count("*")))
    g = each.groupBy("k").agg(F.sum("tp").alias("tp"), F.sum("n").alias("d")).where("d > 0")
    return g.agg(F.round(F.avg(2 * F.col("tp") / F.col("d")), 9).alias("macro_f1"), F.count("*").alias("classes"))


@core.add("a14_confusion", f"WITH {PRED} SELECT truth || '->' || label AS pair, count(*) AS n FROM pred GROUP BY 1")
def a14(spark, d):
    return pred(spark, d).groupBy(F.concat_ws("->", "truth", "label").alias("pair")).agg(F.count("*").alias("n"))


@core.add("a14_confusion_pivot", f"WITH {PRED} SELECT truth, count(*) FILTER (label = 'click') AS click, count(*) FILTER (label = 'view') AS view, count(*) FILTER (label = 'error') AS error FROM pred GROUP BY truth")
def a14_pivot(spark, d):
    out = pred(spark, d).groupBy("truth").pivot("label", ["click", "view", "error"]).count()
    return out.select("truth", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("click", "view", "error")])


@core.add(
    "a15_per_class",
    f"""WITH {PRED}, e AS (SELECT label AS k, count(*) AS emitted, count(*) FILTER (label = truth) AS correct FROM pred WHERE c >= 60 GROUP BY 1), t AS (SELECT truth AS k, count(*) AS total FROM pred GROUP BY 1)
    SELECT coalesce(e.k, t.k) AS label, coalesce(emitted, 0) AS emitted, coalesce(total, 0) AS total, coalesce(correct / nullif(emitted, 0), 0) AS precision, coalesce(correct / nullif(total, 0), 0) AS recall FROM e FULL JOIN t ON e.k = t.k""",
)
def a15(spark, d):
    p = pred(spark, d)
    e = p.where("c >= 60").groupBy(F.col("label").alias("k")).agg(F.count("*").alias("emitted"), F.count_if(F.col("label") == F.col("truth")).alias("correct"))
    t = p.groupBy(F.col("truth").alias("k")).agg(F.count("*").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return e.join(t, "k", "full").select(F.col("k").alias("label"), zero("emitted"), zero("total"), X.ratio("correct", "emitted").alias("precision"), X.ratio("correct", "total").alias("recall"))


@core.add(
    "a16_stratified_metrics",
    f"""WITH {PRED}, s AS (SELECT unnest(['domain', 'truth', 'confident']) AS field, unnest([CAST(domain AS VARCHAR), truth, CASE WHEN c >= 50 THEN 'yes' ELSE 'no' END]) AS value, label = truth AS ok FROM pred)
    SELECT field, value, count(*) AS n, count(*) FILTER (ok) AS correct, count(*) FILTER (ok) / count(*) AS accuracy FROM s GROUP BY 1, 2""",
)
def a16(spark, d):
    p = pred(spark, d).select((F.col("label") == F.col("truth")).alias("ok"), F.col("domain").cast("string").alias("domain"), "truth", F.when(F.col("c") >= 50, "yes").otherwise("no").alias("confident"))
    return p.unpivot("ok", ["domain", "truth", "confident"], "field", "value").groupBy("field", "value").agg(F.count("*").alias("n"), F.count_if("ok").alias("correct"), (F.count_if("ok") / F.count("*")).alias("accuracy"))


@core.add(
    "a17_wilson",
    f"""WITH {PRED}, g AS (SELECT label, CAST(count(*) AS DOUBLE) AS m, CAST(count(*) FILTER (label = truth) AS DOUBLE) AS k FROM pred GROUP BY 1)
    SELECT label, round((k / m + 3.8416 / (2 * m) - 1.96 * sqrt(k / m * (1 - k / m) / m + 3.8416 / (4 * m * m))) / (1 + 3.8416 / m), 6) AS low FROM g""",
)
def a17(spark, d):
    g = pred(spark, d).groupBy("label").agg(F.count("*").alias("m"), F.count_if(F.col("label") == F.col("truth")).alias("k"))
    return g.select("label", F.round(X.wilson_lower("k", "m"), 6).alias("low"))


@core.add(
    "a18_auroc",
    f"""WITH {PRED}, s AS (SELECT domain, c, count(*) FILTER (label = truth) AS p, count(*) FILTER (label <> truth) AS n FROM pred GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
    SELECT domain, round(CAST(sum(p * (2 * below + n)) AS DOUBLE) / (2 * nullif(sum(p) * sum(n), 0)), 9) AS auroc FROM b GROUP BY domain""",
)
def a18(spark, d):
    ok = F.col("label") == F.col("truth")
    s = pred(spark, d).groupBy("domain", "c").agg(F.count_if(ok).alias("p"), F.count_if(~ok).alias("n"))
    w = Window.partitionBy("domain").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return s.groupBy("domain").agg(F.round(F.try_divide(F.sum(F.col("p") * (2 * F.col("below") + F.col("n"))).cast("double"), 2 * F.sum("p") * F.sum("n")), 9).alias("auroc"))


_KNOWN = f"{OBS}, k AS (SELECT *, lag(label) OVER (PARTITION BY track ORDER BY pos) AS before FROM obs WHERE label <> 'unknown')"


@core.add(
    "a19_dominant_stability",
    f"""WITH {OBS}, n AS (SELECT track, count(*) AS frames FROM obs GROUP BY 1 HAVING count(*) >= 3), l AS (SELECT track, label, count(*) AS m FROM obs WHERE label <> 'unknown' GROUP BY 1, 2), t AS (SELECT track, max(m) AS dominant, CAST(sum(m) AS BIGINT) AS emitted FROM l GROUP BY 1)
    SELECT n.track, frames, coalesce(emitted, 0) AS emitted, coalesce(dominant / nullif(emitted, 0), 0) AS stability, 1 - coalesce(emitted, 0) / frames AS abstention FROM n LEFT JOIN t ON t.track = n.track""",
)
def a19(spark, d):
    per = obs(spark, d).groupBy("track", "label").agg(F.count("*").alias("m"))
    known = F.when(F.col("label") != "unknown", F.col("m"))
    t = per.groupBy("track").agg(F.sum("m").alias("frames"), F.coalesce(F.sum(known), F.lit(0)).alias("emitted"), F.max(known).alias("dominant")).where("frames >= 3")
    return t.select("track", "frames", "emitted", X.ratio("dominant", "emitted").alias("stability"), (1 - F.col("emitted") / F.col("frames")).alias("abstention"))


@core.add("a19_transition_stability", f"WITH {_KNOWN} SELECT track, count(*) FILTER (before IS NOT NULL) AS transitions, count(*) FILTER (before <> label) AS switches, coalesce(1 - count(*) FILTER (before <> label) / nullif(count(*) FILTER (before IS NOT NULL), 0), 0) AS stability FROM k GROUP BY track")
def a19_transitions(spark, d):
    w = Window.partitionBy("track").orderBy("pos")
    k = obs(spark, d).where("label <> 'unknown'").withColumn("before", F.lag("label").over(w))
    g = k.groupBy("track").agg(F.count("before").alias("transitions"), F.count_if(F.col("before") != F.col("label")).alias("switches"))
    return g.withColumn("stability", F.coalesce(1 - F.try_divide("switches", "transitions"), F.lit(0.0)))


@core.add("w5_label_switches", f"WITH {_KNOWN} SELECT track, pos, before, label FROM k WHERE before <> label")
def w5(spark, d):
    w = Window.partitionBy("track").orderBy("pos")
    return obs(spark, d).where("label <> 'unknown'").select("track", "pos", F.lag("label").over(w).alias("before"), "label").where("before <> label")


@core.add(
    "a20_percentiles",
    f"""WITH {OBS}, r AS (SELECT track, c, row_number() OVER (PARTITION BY track ORDER BY c, pos) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM obs)
    SELECT track, max(c) FILTER (i = round_even((n - 1) * 0.95, 0)) AS half_even, max(c) FILTER (i = CAST(floor(least(n - 1, n * 0.95)) AS BIGINT)) AS truncated, max(c) FILTER (i = CAST(ceil(n * 0.95) AS BIGINT) - 1) AS ceiling_rank, least(CAST(floor(max(c) FILTER (i = CAST(ceil(n * 0.95) AS BIGINT) - 1) / 0.5) AS BIGINT), 201) * CAST(0.5 AS DOUBLE) AS histogram_rank, round(quantile_cont(c, 0.95), 6) AS linear FROM r GROUP BY track""",
)
def a20(spark, d):
    w = Window.partitionBy("track")
    n = F.count("*").over(w)
    r = obs(spark, d).select("track", "c", (F.row_number().over(w.orderBy("c", "pos")) - 1).alias("i"), n.alias("n"))
    at = lambda e: F.max(F.when(F.col("i") == e.cast("long"), F.col("c")))
    dec = F.col("n").cast("decimal(20,0)") * F.lit("0.95").cast("decimal(3,2)")
    last = (F.col("n") - 1).cast("decimal(20,0)")
    return r.groupBy("track").agg(
        at(F.bround(last * F.lit("0.95").cast("decimal(3,2)"))).alias("half_even"), at(F.floor(F.least(last.cast("decimal(23,2)"), dec.cast("decimal(23,2)")))).alias("truncated"),
        at(F.ceil(dec) - 1).alias("ceiling_rank"),
        # the bucket in which a histogram of 202 buckets of 0.5 reaches that rank is the bucket of the value of that rank
        (F.least(F.floor(at(F.ceil(dec) - 1) / 0.5), F.lit(201)) * 0.5).alias("histogram_rank"), F.round(F.percentile("c", 0.95), 6).alias("linear"),
    )


@core.add("a21_histogram", f"WITH {OBS} SELECT least(CAST(floor(q / 0.5) AS BIGINT), 201) AS bucket, count(*) AS n FROM obs GROUP BY 1")
def a21(spark, d):
    return obs(spark, d).groupBy(F.least(F.floor(F.col("q") / 0.5).cast("long"), F.lit(201)).alias("bucket")).agg(F.count("*").alias("n"))


@core.add(
    "a23_supervision_ratios",
    f"""WITH m AS (SELECT coalesce({SPLIT}, 'none') AS split, lower(trim(coalesce(color_supervised, ''), ' ')) IN ('1', 'true', 'yes', 'y', 'on') AS s, {COLOR} IS NOT NULL AS k FROM attribute_manifest)
    SELECT split, count(*) AS n, count(*) FILTER (s) AS supervised, count(*) FILTER (s AND k) AS usable, coalesce(count(*) FILTER (s AND k) / nullif(count(*) FILTER (s), 0), 0) AS fraction FROM m GROUP BY split""",
)
def a23(spark, d):
    m = manifest(spark, d).select(F.coalesce(normal.split_name("split"), F.lit("none")).alias("split"), P.truthy("color_supervised").alias("s"), normal.color("color").isNotNull().alias("k"))
    return m.groupBy("split").agg(F.count("*").alias("n"), F.count_if("s").alias("supervised"), F.count_if(F.col("s") & F.col("k")).alias("usable")).withColumn("fraction", X.ratio("usable", "supervised"))


@core.add(
    "a26_class_weights",
    f"WITH g AS (SELECT {COLOR} AS label, count(*) AS n FROM attribute_manifest WHERE {COLOR} IS NOT NULL GROUP BY 1) SELECT label, n, round((1 / sqrt(n)) / avg(1 / sqrt(n)) OVER (), 6) AS weight, round(least(4.0, sqrt(max(n) OVER () / n)), 6) AS sampler FROM g",
)
def a26(spark, d):
    g = manifest(spark, d).select(normal.color("color").alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    w = Window.partitionBy()  # over one row per label
    rs = 1 / F.sqrt("n")
    return g.select("label", "n", F.round(rs / F.avg(rs).over(w), 6).alias("weight"), F.round(F.least(F.lit(4.0), F.sqrt(F.max("n").over(w) / F.col("n"))), 6).alias("sampler"))


@core.add(
    "a27_row_weight",
    f"SELECT stage177_row_number AS row_number, round(CAST(least(10.0, greatest(0.1, CASE WHEN {_yes('night')} THEN 1.5 ELSE 1.0 END * CASE WHEN {_yes('occluded')} THEN 1.25 ELSE 1.0 END * CASE WHEN {_yes('blur')} THEN 0.5 ELSE 1.0 END)) AS DOUBLE), 6) AS weight FROM attribute_manifest",
)
def a27(spark, d):
    f = lambda c, x: F.when(P.truthy(c), x).otherwise(1.0)
    return manifest(spark, d).select("row_number", F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.1), X.product([f("night", 1.5), f("occluded", 1.25), f("blur", 0.5)]))), 6).alias("weight"))


@core.add(
    "x24_weight_reasons",
    f"""SELECT stage177_row_number AS row_number, round(CAST(least(2.5, CASE WHEN {_yes('night')} THEN 1.5 ELSE 1.0 END * CASE WHEN {_yes('occluded')} THEN 1.4 ELSE 1.0 END * CASE WHEN {_yes('truncated')} THEN 1.3 ELSE 1.0 END) AS DOUBLE), 6) AS weight,
    concat_ws('+', CASE WHEN {_yes('night')} THEN 'night' END, CASE WHEN {_yes('occluded')} THEN 'occluded' END, CASE WHEN {_yes('truncated')} THEN 'truncated' END) AS reasons FROM attribute_manifest""",
)
def x24(spark, d):
    rules = [("night", 1.5), ("occluded", 1.4), ("truncated", 1.3)]
    w = X.product([F.when(P.truthy(c), x).otherwise(1.0) for c, x in rules])
    return manifest(spark, d).select("row_number", F.round(F.least(F.lit(2.5), w), 6).alias("weight"), F.concat_ws("+", *[F.when(P.truthy(c), F.lit(c)) for c, _ in rules]).alias("reasons"))


_X10 = [("low_light", _yes("night"), 1.5, lambda: P.truthy("night")), ("occlusion", f"({_yes('occluded')} OR {_yes('truncated')})", 3.0, lambda: P.truthy("occluded") | P.truthy("truncated")), ("motion_blur", _yes("blur"), 2.0, lambda: P.truthy("blur")),
        ("crop_quality", "lower(coalesce(crop_quality, '')) IN ('usable', 'poor')", 1.0, lambda: F.lower(F.coalesce("crop_quality", F.lit(""))).isin("usable", "poor")), ("unknown_head", "(body_type = 'unknown' OR color = 'unknown')", 0.25, lambda: (F.col("body_type") == "unknown") | (F.col("color") == "unknown"))]


@core.add(
    "x10_hard_score",
    f"""WITH m AS (SELECT stage177_row_number AS row_number, list_sort(list_filter([{', '.join(f"CASE WHEN {s} THEN '{n}' END" for n, s, _, _ in _X10)}], lambda x: x IS NOT NULL)) AS t, {' + '.join(f'CASE WHEN {s} THEN {w} ELSE 0 END' for _, s, w, _ in _X10)} AS score FROM attribute_manifest)
    SELECT row_number, CASE WHEN len(t) = 0 THEN 'normal' ELSE array_to_string(t, ';') END AS tags, CAST(score AS DOUBLE) AS score FROM m""",
)
def x10(spark, d):
    t = F.sort_array(P.tags(*[(n, f()) for n, _, _, f in _X10]))
    score = sum((F.when(f(), w).otherwise(0.0) for _, _, w, f in _X10), F.lit(0.0))
    return manifest(spark, d).select("row_number", F.when(F.size(t) == 0, "normal").otherwise(F.array_join(t, ";")).alias("tags"), score.alias("score"))


@core.add(
    "a28_segment_summary",
    f"WITH {OBS} SELECT pos // 500 AS segment, count(*) AS n, count(*) FILTER (label = 'unknown') AS empty, CAST(sum(c) AS BIGINT) AS total, count(*) FILTER (label = 'click') AS clicks, round(quantile_cont(c, 0.95), 6) AS p95 FROM obs GROUP BY 1",
)
def a28(spark, d):
    return obs(spark, d).groupBy(F.call_function("div", "pos", F.lit(500)).alias("segment")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == "unknown").alias("empty"), F.sum("c").alias("total"), F.count_if(F.col("label") == "click").alias("clicks"), F.round(F.percentile("c", 0.95), 6).alias("p95"))


@core.add(
    "a29_max_min_threshold",
    f"""WITH {PRED}, t AS (SELECT unnest([20, 40, 60, 80]) AS threshold), g AS (SELECT threshold, domain, count(*) FILTER (c >= threshold AND label = truth) AS tp, count(*) FILTER (c >= threshold) AS p, count(*) FILTER (label = truth) AS t FROM pred, t GROUP BY 1, 2),
    m AS (SELECT threshold, min(2 * tp / (p + t)) AS worst FROM g GROUP BY 1) SELECT threshold, round(worst, 9) AS worst FROM m ORDER BY m.worst DESC, threshold LIMIT 1""",
)
def a29(spark, d):
    grid = spark.createDataFrame([(20,), (40,), (60,), (80,)], "threshold int")
    ok, sel = F.col("label") == F.col("truth"), F.col("c") >= F.col("threshold")
    g = C.grid(pred(spark, d), grid, ["threshold", "domain"], tp=F.count_if(sel & ok), p=F.count_if(sel), t=F.count_if(ok))
    m = g.groupBy("threshold").agg(F.min(2 * F.col("tp") / (F.col("p") + F.col("t"))).alias("worst"))
    return m.orderBy(F.desc("worst"), "threshold").limit(1).select("threshold", F.round("worst", 9).alias("worst"))


# ---- windows


@core.add("w3_trailing_window", f"WITH {OBS} SELECT track, pos, CAST(sum(c) OVER w AS BIGINT) AS c_sum, count(*) OVER w AS n, max(label) OVER w AS last_label FROM obs WINDOW w AS (PARTITION BY track ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def w3(spark, d):
    w = Window.partitionBy("track").orderBy("pos").rowsBetween(-4, 0)
    return obs(spark, d).select("track", "pos", F.sum("c").over(w).alias("c_sum"), F.count("*").over(w).alias("n"), F.max("label").over(w).alias("last_label"))


@core.add(
    "w4_contiguous_runs",
    """WITH s AS (SELECT DISTINCT run_id, source_sequence AS s FROM camera_frames WHERE source_sequence IS NOT NULL), g AS (SELECT *, s - row_number() OVER (PARTITION BY run_id ORDER BY s) AS island FROM s)
    SELECT run_id, min(s) AS first_sequence, max(s) AS last_sequence, count(*) AS length FROM g GROUP BY run_id, island""",
)
def w4(spark, d):
    s = table(spark, d, "camera_frames").where("source_sequence is not null").select("run_id", F.col("source_sequence").alias("s")).distinct()
    g = s.withColumn("island", F.col("s") - F.row_number().over(Window.partitionBy("run_id").orderBy("s")))
    return g.groupBy("run_id", "island").agg(F.min("s").alias("first_sequence"), F.max("s").alias("last_sequence"), F.count("*").alias("length")).drop("island")


@core.add(
    "w6_evenly_spaced",
    f"""WITH {OBS}, r AS (SELECT track, pos, row_number() OVER (PARTITION BY track ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM obs)
    SELECT track, pos FROM r WHERE n <= 5 OR i IN (round_even(0.0, 0), round_even(1 * (n - 1) / 4, 0), round_even(2 * (n - 1) / 4, 0), round_even(3 * (n - 1) / 4, 0), n - 1)""",
)
def w6(spark, d):
    return S.evenly_spaced(obs(spark, d).select("track", "pos"), ["track"], [F.col("pos")], 5)


@core.add("w8_fold_assignment", f"SELECT stage177_row_number AS row_number, (row_number() OVER (PARTITION BY coalesce({BODY}, 'none') ORDER BY sha256(image_path), stage177_row_number) - 1) % 5 AS fold FROM attribute_manifest")
def w8(spark, d):
    m = manifest(spark, d).select("row_number", F.coalesce(normal.label("body_type"), F.lit("none")).alias("label"), F.sha2("image_path", 256).alias("h"))
    return R.hash_rank(m, ["label"], "h", [F.col("h"), F.col("row_number")]).select("row_number", ((F.col("_rank") - 1) % 5).cast("long").alias("fold"))


@core.add("w9_group_size", "SELECT stage177_row_number AS row_number FROM (SELECT stage177_row_number, count(*) OVER (PARTITION BY video_id) AS n FROM attribute_manifest WHERE video_id IS NOT NULL) WHERE n >= 4")
def w9(spark, d):
    m = manifest(spark, d).where("video_id is not null").select("row_number", "video_id")
    big = m.groupBy("video_id").agg(F.count("*").alias("n")).where("n >= 4")
    return m.join(big, "video_id", "left_semi").select("row_number")


# ---- samples and splits


@core.add(
    "t8_class_quota",
    f"""WITH m AS (SELECT stage177_row_number AS r, {BODY} AS b, sha256('quota|' || image_path) AS h, image_path FROM attribute_manifest WHERE {BODY} IS NOT NULL), k AS (SELECT b, count(*) AS held, row_number() OVER (ORDER BY b) - 1 AS i, count(*) OVER () AS k FROM m GROUP BY b),
    q AS (SELECT b, held, 2000 // k + CASE WHEN i < 2000 % k THEN 1 ELSE 0 END AS quota FROM k), r AS (SELECT m.*, quota, row_number() OVER (PARTITION BY m.b ORDER BY h, image_path) AS n FROM m JOIN q ON q.b = m.b),
    l AS (SELECT r, row_number() OVER (ORDER BY h, image_path) AS n FROM r WHERE n > quota) SELECT r AS row_number FROM r WHERE n <= quota UNION ALL SELECT r FROM l WHERE n <= (SELECT sum(greatest(0, quota - held)) FROM q)""",
)
def t8(spark, d):
    m = manifest(spark, d).select("row_number", normal.label("body_type").alias("b"), "image_path").where("b is not null")
    return S.quotas(m, "b", "image_path", 2000).select("row_number")


@core.add(
    "t10_hash_split",
    "SELECT stage177_row_number AS row_number, CASE WHEN CAST('0x' || substr(sha256(video_id), 1, 8) AS BIGINT) % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM attribute_manifest WHERE video_id IS NOT NULL",
)
def t10(spark, d):
    return manifest(spark, d).where("video_id is not null").select("row_number", F.when(X.stable_fraction(F.col("video_id"), 5) == 0, "validation").otherwise("train").alias("split"))


@core.add("t14_oversample", f"WITH m AS (SELECT stage177_row_number AS row_number, CASE WHEN {SPLIT} = 'train' AND {BODY} = 'bus' THEN 3 ELSE 1 END AS n FROM attribute_manifest) SELECT row_number, CAST(unnest(generate_series(0, n - 1)) AS INT) AS copy FROM m")
def t14(spark, d):
    n = F.when((normal.split_name("split") == "train") & (normal.label("body_type") == "bus"), 3).otherwise(1)
    return S.repeated(manifest(spark, d).select("row_number", n.alias("n")), F.col("n")).select("row_number", "copy")


@core.add(
    "t15_until_target",
    f"""WITH m AS (SELECT video_id, min({COLOR}) AS color, count(*) AS n FROM attribute_manifest WHERE {COLOR} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {COLOR}) = 1), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY color ORDER BY sha256('pick|' || video_id), video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM m)
    SELECT video_id, color, n FROM b WHERE b < 40""",
)
def t15(spark, d):
    m = manifest(spark, d).select("video_id", normal.color("color").alias("color")).where("color is not null").groupBy("video_id").agg(F.min("color").alias("color"), F.max("color").alias("hi"), F.count("*").alias("n")).where("color = hi").drop("hi")
    return S.until_target(m, "color", "video_id", "n", 40, "pick|")


@core.add(
    "t16_group_split",
    f"""WITH m AS (SELECT video_id, coalesce({BODY}, 'none') AS label, source_dataset AS source FROM attribute_manifest), g AS (SELECT video_id, min(label) AS label, min(source) AS source FROM m GROUP BY 1 HAVING count(DISTINCT label) = 1 AND count(DISTINCT source) = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY sha256('split|' || video_id), video_id) AS k, count(*) OVER (PARTITION BY source, label) AS n FROM g)
    SELECT video_id, source, label, CASE WHEN n >= 2 AND k <= greatest(1, round_even(n * 0.2, 0)) THEN 'validation' ELSE 'train' END AS split FROM r""",
)
def t16(spark, d):
    m = manifest(spark, d).select("video_id", F.coalesce(normal.label("body_type"), F.lit("none")).alias("label"), F.col("source_dataset").alias("source"))
    return S.group_split(m, "video_id", "label", "source", 0.2, "split|").select("video_id", "source", "label", "split")


@core.add(
    "t17_negative_cap",
    f"""WITH m AS (SELECT stage177_row_number AS r, source_dataset AS s, image_path, {_yes('night')} AS p FROM attribute_manifest), n AS (SELECT s, count(*) FILTER (p) AS k FROM m GROUP BY 1),
    q AS (SELECT m.*, k, row_number() OVER (PARTITION BY m.s, p ORDER BY sha256('negative|' || image_path), image_path) AS i FROM m JOIN n ON n.s = m.s) SELECT r AS row_number FROM q WHERE p OR i <= greatest(50, 2 * greatest(1, k))""",
)
def t17(spark, d):
    m = manifest(spark, d).select("row_number", F.col("source_dataset").alias("s"), "image_path", P.truthy("night").alias("p"))
    return S.cap_negatives(m, "s", F.col("p"), "image_path", 2, 50).select("row_number")


# ---- sets and near matches


_HUMAN = f"CASE WHEN starts_with({spell.key('annotation_source')}, 'human') THEN 0 ELSE 1 END"


@core.add(
    "u1_union_priority",
    f"""WITH m AS (SELECT stage177_row_number AS row_number, {SPLIT} AS s, {_HUMAN} AS h, image_path, video_id FROM attribute_manifest), r AS (SELECT *, CASE s WHEN 'test' THEN 0 WHEN 'validation' THEN 1 WHEN 'train' THEN 2 ELSE 3 END AS p FROM m)
    SELECT row_number, row_number() OVER (PARTITION BY video_id ORDER BY p, h, image_path) AS priority FROM r""",
)
def u1(spark, d):
    """The union of the manifests of each split, in one order of priority: held-out rows first, then human labels, then paths."""
    split = normal.split_name("split")
    p = F.when(split == "test", 0).when(split == "validation", 1).when(split == "train", 2).otherwise(3)
    m = manifest(spark, d).select("row_number", "video_id", p.alias("p"), F.when(normal.key("annotation_source").startswith("human"), 0).otherwise(1).alias("h"), "image_path")
    return m.select("row_number", F.row_number().over(Window.partitionBy("video_id").orderBy("p", "h", "image_path")).cast("long").alias("priority"))


@core.add(
    "u2_exact_dedup",
    f"""WITH m AS (SELECT stage177_row_number AS r, {spell.digest('stage177_pixel_sha256')} AS h, {COLOR} AS c FROM attribute_manifest), g AS (SELECT h, min(r) AS row_number, count(*) AS n, count(DISTINCT c) > 1 AS conflict FROM m WHERE h IS NOT NULL GROUP BY h) SELECT row_number, n, conflict FROM g""",
)
def u2(spark, d):
    m = manifest(spark, d).select("row_number", normal.digest("stage177_pixel_sha256").alias("h"), normal.color("color").alias("c")).where("h is not null")
    g = m.groupBy("h").agg(F.min("row_number").alias("row_number"), F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    return g.select("row_number", "n", F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("conflict"))


_BITS = f"h AS (SELECT DISTINCT CAST(CASE WHEN b > 9223372036854775807 THEN CAST(b AS HUGEINT) - 18446744073709551616 ELSE b END AS BIGINT) AS bits FROM (SELECT {spell.bits64('stage177_dhash64')} AS b FROM attribute_manifest) WHERE b IS NOT NULL)"


def _bits(spark, d):
    return manifest(spark, d).select("row_number", normal.bits64("stage177_dhash64").alias("bits"), normal.split_name("split").alias("split"), normal.color("color").alias("color"))


@core.add("j10_hamming_exact", f"WITH {_BITS} SELECT a.bits AS left_bits, b.bits AS right_bits, bit_count(xor(a.bits, b.bits)) AS distance FROM h a JOIN h b ON a.bits < b.bits AND bit_count(xor(a.bits, b.bits)) <= 4")
def j10(spark, d):
    b = _bits(spark, d).select("bits")
    return H.hamming_pairs(b, b, 4).where("left_bits < right_bits").select("left_bits", "right_bits", F.col("distance").cast("byte").alias("distance"))


_BANDS = " OR ".join(f"(xor(a.bits, b.bits) >> {s}) & 65535 = 0" for s in (0, 16, 32, 48))


@core.add("j11_hamming_bands", f"WITH {_BITS} SELECT a.bits AS left_bits, b.bits AS right_bits, bit_count(xor(a.bits, b.bits)) AS distance FROM h a JOIN h b ON a.bits < b.bits AND bit_count(xor(a.bits, b.bits)) <= 4 AND ({_BANDS})")
def j11(spark, d):
    b = _bits(spark, d).select("bits")
    return H.hamming_pairs(b, b, 4, exact=False).where("left_bits < right_bits").select("left_bits", "right_bits", F.col("distance").cast("byte").alias("distance"))


@core.add("j12_hamming_radius_2", f"WITH {_BITS} SELECT a.bits AS left_bits, b.bits AS right_bits, bit_count(xor(a.bits, b.bits)) AS distance FROM h a JOIN h b ON a.bits < b.bits AND bit_count(xor(a.bits, b.bits)) <= 2")
def j12(spark, d):
    b = _bits(spark, d).select("bits")
    return H.hamming_pairs(b, b, 2).where("left_bits < right_bits").select("left_bits", "right_bits", F.col("distance").cast("byte").alias("distance"))


_LABELLED = f"l AS (SELECT DISTINCT {COLOR} AS color, CAST(CASE WHEN b > 9223372036854775807 THEN CAST(b AS HUGEINT) - 18446744073709551616 ELSE b END AS BIGINT) AS bits FROM (SELECT color, {spell.bits64('stage177_dhash64')} AS b FROM attribute_manifest) WHERE b IS NOT NULL)"


def _labelled(spark, d):
    """Pairs of hashes within 3 bits that share a color."""
    b = _bits(spark, d).select("color", "bits")
    return H.hamming_pairs(b, b, 3, within="color").where("left_bits < right_bits")


@core.add("j13_hamming_within_label", f"WITH {_LABELLED} SELECT a.color, a.bits AS left_bits, b.bits AS right_bits FROM l a JOIN l b ON a.color = b.color AND a.bits < b.bits AND bit_count(xor(a.bits, b.bits)) <= 3")
def j13(spark, d):
    return _labelled(spark, d).select("color", "left_bits", "right_bits")


_ORDERED = f"""WITH RECURSIVE m AS (SELECT stage177_row_number AS r, {SPLIT} AS split, {_HUMAN} AS h, coalesce(image_path, '') AS path, {spell.digest('stage177_pixel_sha256')} AS d,
      CAST(CASE WHEN {spell.bits64('stage177_dhash64')} > 9223372036854775807 THEN CAST({spell.bits64('stage177_dhash64')} AS HUGEINT) - 18446744073709551616 ELSE {spell.bits64('stage177_dhash64')} END AS BIGINT) AS bits FROM attribute_manifest),
    ranked AS (SELECT *, (CASE split WHEN 'test' THEN '0' WHEN 'validation' THEN '1' WHEN 'train' THEN '2' ELSE '3' END) || h || path || chr(1) || lpad(CAST(r AS VARCHAR), 20, '0') AS o FROM m),
    contents AS (SELECT arg_min(r, o) AS r, arg_min(split, o) AS split, min(o) AS o, arg_min(bits, o) FILTER (bits IS NOT NULL) AS bits FROM ranked GROUP BY coalesce(d, '#' || r)),
    firsts AS (SELECT bits, min(o) AS o FROM contents WHERE bits IS NOT NULL GROUP BY bits),
    pairs AS (SELECT a.o AS a, b.o AS b FROM firsts a JOIN firsts b ON a.o < b.o AND bit_count(xor(a.bits, b.bits)) <= 4),
    involved AS (SELECT o, row_number() OVER (ORDER BY o) AS i FROM (SELECT a AS o FROM pairs UNION SELECT b FROM pairs)),
    earlier AS (SELECT y.i, list(x.i) AS before FROM pairs JOIN involved x ON x.o = a JOIN involved y ON y.o = b GROUP BY y.i),
    walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL
      SELECT w.i + 1, CASE WHEN e.before IS NOT NULL AND list_has_any(w.kept, e.before) THEN w.kept ELSE list_append(w.kept, w.i + 1) END FROM walk w LEFT JOIN earlier e ON e.i = w.i + 1 WHERE w.i < (SELECT count(*) FROM involved)),
    last AS (SELECT kept FROM walk ORDER BY i DESC LIMIT 1), dropped AS (SELECT o FROM involved, last WHERE NOT list_contains(kept, i))"""


@core.add("u3_leader_dedup", f"{_ORDERED} SELECT r AS row_number, split FROM contents WHERE bits IS NULL OR o IN (SELECT o FROM firsts WHERE o NOT IN (SELECT o FROM dropped))")
def u3(spark, d):
    """The rows kept, held-out splits first, then human labels, then paths: of equal contents the first row, and of these a row
    only if no kept one has a hash within 4 bits. A content's hash is that of its first row that has one; without a hash a
    row is kept."""
    split = normal.split_name("split")
    p = F.when(split == "test", "0").when(split == "validation", "1").when(split == "train", "2").otherwise("3")
    human = F.when(normal.key("annotation_source").startswith("human"), "0").otherwise("1")
    order = F.concat(p, human, F.coalesce("image_path", F.lit("")), F.lit(chr(1)), F.lpad(F.col("row_number").cast("string"), 20, "0"))
    m = manifest(spark, d).select("row_number", split.alias("split"), normal.bits64("stage177_dhash64").alias("bits"), F.coalesce(normal.digest("stage177_pixel_sha256"), F.concat(F.lit("#"), F.col("row_number").cast("string"))).alias("content"), order.alias("o"))
    contents = m.groupBy("content").agg(F.min(F.struct("o", "row_number", "split")).alias("first"), F.min(F.when(F.col("bits").isNotNull(), F.struct("o", "bits"))).getField("bits").alias("bits")).select("first.*", "bits")
    scratch = Scratch(spark, "leaders")
    contents = scratch.keep(contents, "contents")
    firsts = scratch.keep(contents.where("bits is not null").groupBy("bits").agg(F.min("o").alias("id")), "firsts")
    near = H.hamming_pairs(firsts, firsts, 4).where("left_bits < right_bits")
    at = lambda side: firsts.select(F.col("bits").alias(f"{side}_bits"), F.col("id").alias(side))
    pairs = near.join(at("left"), "left_bits").join(at("right"), "right_bits").select(F.col("left").alias("a"), F.col("right").alias("b"))
    kept = H.leaders(firsts.select("id"), pairs, scratch).where("kept")
    return contents.where("bits is null").select("row_number", "split").union(contents.join(kept, F.col("o") == F.col("id")).select("row_number", "split"))


@core.add(
    "u4_conflict_deletion",
    f"""WITH {_LABELLED}, x AS (SELECT a.bits AS p, b.bits AS q FROM l a JOIN l b ON a.bits < b.bits AND a.color <> b.color AND bit_count(xor(a.bits, b.bits)) <= 2) SELECT DISTINCT bits FROM l WHERE bits NOT IN (SELECT p FROM x UNION ALL SELECT q FROM x)""",
)
def u4(spark, d):
    b = _bits(spark, d).where("bits is not null").select("bits", "color").distinct()
    p = H.hamming_pairs(b.select("bits"), b.select("bits"), 2).where("left_bits < right_bits")
    # what colors a hash has is all that matters, so two differing values can be told from the least and the greatest
    c = b.where("color is not null").groupBy("bits").agg(F.min("color").alias("lo"), F.max("color").alias("hi"))
    j = p.join(c.toDF("left_bits", "l1", "h1"), "left_bits").join(c.toDF("right_bits", "l2", "h2"), "right_bits").where("l1 <> l2 or h1 <> h2 or l1 <> h1")
    bad = j.select("left_bits").union(j.select("right_bits")).toDF("bits")
    return b.select("bits").distinct().join(bad, "bits", "left_anti")


@core.add(
    "u5_transitive_clusters",
    f"""WITH RECURSIVE {_BITS}, e AS (SELECT a.bits AS a, b.bits AS b FROM h a JOIN h b ON a.bits <> b.bits AND bit_count(xor(a.bits, b.bits)) <= 4), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a""",
)
def u5(spark, d):
    b = _bits(spark, d).select("bits")
    pairs = H.hamming_pairs(b, b, 4).where("left_bits < right_bits").select(F.col("left_bits").alias("a"), F.col("right_bits").alias("b"))
    return H.components(pairs)


_SIDES = f"s AS (SELECT stage177_row_number AS r, {SPLIT} AS s, {spell.bits64('stage177_dhash64')} AS b FROM attribute_manifest)"


@core.add("u6_cross_split_filter", f"WITH {_SIDES}, t AS (SELECT DISTINCT b FROM s WHERE s = 'train' AND b IS NOT NULL), v AS (SELECT DISTINCT b FROM s WHERE s IN ('validation', 'test') AND b IS NOT NULL), n AS (SELECT t.b, min(bit_count(xor(t.b, v.b))) AS distance FROM t JOIN v ON bit_count(xor(t.b, v.b)) <= 4 GROUP BY 1) SELECT r AS row_number, distance FROM s JOIN n ON n.b = s.b WHERE s = 'train'")
def u6(spark, d):
    b = _bits(spark, d)
    near = H.hamming_pairs(b.where("split = 'train'"), b.where("split in ('validation', 'test')"), 4).groupBy("left_bits").agg(F.min("distance").cast("byte").alias("distance"))
    return b.where("split = 'train'").join(near, F.col("bits") == F.col("left_bits")).select("row_number", "distance")


@core.add("u7_cross_group_pairs", f"WITH g AS (SELECT source_dataset AS g, {spell.bits64('stage177_dhash64')} AS b FROM attribute_manifest), x AS (SELECT DISTINCT g, b FROM g WHERE b IS NOT NULL) SELECT a.g AS left_group, c.g AS right_group, count(*) AS n FROM x a JOIN x c ON a.g < c.g AND bit_count(xor(a.b, c.b)) <= 2 GROUP BY 1, 2")
def u7(spark, d):
    b = manifest(spark, d).select(F.col("source_dataset").alias("g"), normal.bits64("stage177_dhash64").alias("bits")).where("bits is not null").distinct()
    p = H.hamming_pairs(b.select("bits"), b.select("bits"), 2)
    j = p.join(b.toDF("left_group", "left_bits"), "left_bits").join(b.toDF("right_group", "right_bits"), "right_bits").where("left_group < right_group")
    return j.groupBy("left_group", "right_group").agg(F.count("*").alias("n"))


@core.add("u8_set_difference", "SELECT DISTINCT event_id FROM vision_events WHERE event_id NOT IN (SELECT event_id FROM callback_outbox WHERE event_id IS NOT NULL)")
def u8(spark, d):
    return table(spark, d, "vision_events").select("event_id").distinct().join(table(spark, d, "callback_outbox").select("event_id"), "event_id", "left_anti")


_KEY8 = f"coalesce(CASE WHEN regexp_full_match({spell.digest('stage177_pixel_sha256')}, '[0-9a-f]{{64}}') THEN {spell.digest('stage177_pixel_sha256')} END, {spell.path('image_path')})"


@core.add("u8b_novelty", f"WITH m AS (SELECT stage177_row_number AS r, {SPLIT} AS s, {_KEY8} AS k, {_yes('night')} AS adverse FROM attribute_manifest) SELECT r AS row_number, adverse FROM m WHERE s = 'train' AND k NOT IN (SELECT k FROM m WHERE s IN ('validation', 'test') AND k IS NOT NULL)")
def u8b(spark, d):
    h = normal.digest("stage177_pixel_sha256")
    m = manifest(spark, d).select("row_number", normal.split_name("split").alias("s"), F.coalesce(F.when(h.rlike("^[0-9a-f]{64}$"), h), normal.path("image_path")).alias("k"), P.truthy("night").alias("adverse"))
    return m.where("s = 'train' and k is not null").join(m.where("s in ('validation', 'test')").select("k"), "k", "left_anti").select("row_number", "adverse")


# ---- thresholds

_SWEEP = f"{PRED}, per AS (SELECT label, c, count(*) AS n, count(*) FILTER (label = truth) AS k FROM pred WHERE label <> 'error' GROUP BY 1, 2), sw AS (SELECT label, c AS threshold, CAST(sum(n) OVER w AS BIGINT) AS selected, CAST(sum(k) OVER w AS BIGINT) AS correct FROM per WINDOW w AS (PARTITION BY label ORDER BY c DESC ROWS UNBOUNDED PRECEDING))"


def _swept(spark, d):
    return C.sweep(pred(spark, d).where("label <> 'error'"), ["label"], "c", F.col("label") == F.col("truth"))


@core.add(
    "c1_threshold_sweep",
    f"""WITH {PRED}, t AS (SELECT unnest([10, 20, 30, 40, 50, 60, 70, 80, 90]) AS threshold), g AS (SELECT threshold, count(*) FILTER (c >= threshold) AS selected, count(*) FILTER (c >= threshold AND label = truth) AS correct, count(*) AS n FROM pred, t GROUP BY 1)
    SELECT threshold, correct / selected AS precision, selected / n AS coverage FROM g WHERE selected > 0 ORDER BY correct / selected >= 0.7 DESC, CASE WHEN correct / selected >= 0.7 THEN selected / n ELSE correct / selected END DESC, CASE WHEN correct / selected >= 0.7 THEN correct / selected ELSE selected / n END DESC, threshold LIMIT 1""",
)
def c1(spark, d):
    t = spark.createDataFrame([(i,) for i in range(10, 100, 10)], "threshold int")
    sel = F.col("c") >= F.col("threshold")
    g = C.grid(pred(spark, d), t, ["threshold"], selected=F.count_if(sel), correct=F.count_if(sel & (F.col("label") == F.col("truth"))), n=F.count("*")).where("selected > 0")
    g = g.select("threshold", (F.col("correct") / F.col("selected")).alias("precision"), (F.col("selected") / F.col("n")).alias("coverage"))
    ok = F.col("precision") >= 0.7
    return g.orderBy(F.desc(ok), F.desc(F.when(ok, F.col("coverage")).otherwise(F.col("precision"))), F.desc(F.when(ok, F.col("precision")).otherwise(F.col("coverage"))), "threshold").limit(1)


@core.add("c2_per_class_threshold", f"WITH {_SWEEP} SELECT label, threshold, selected, correct / selected AS precision FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY selected DESC, threshold) AS k FROM sw WHERE correct / selected >= 0.7) WHERE k = 1")
def c2(spark, d):
    return C.best_threshold(_swept(spark, d), ["label"], F.col("precision") >= 0.7, [F.desc("selected"), F.asc("threshold")]).select("label", "threshold", "selected", "precision")


@core.add("c3_first_passing", f"WITH {_SWEEP} SELECT label, min(threshold) AS threshold FROM sw WHERE selected >= 20 AND correct / selected >= 0.7 GROUP BY label")
def c3(spark, d):
    return _swept(spark, d).where("selected >= 20 and precision >= 0.7").groupBy("label").agg(F.min("threshold").alias("threshold"))


# Per class every threshold of a grid of thousandths, or none; two classes at a time, of which only those stay that have
# more to spare (ten times correct less seven times selected) than all that select more; then both halves together.
def _half(name: str, labels: str) -> str:
    return f"""{name}_all AS (SELECT a.n + b.n AS n, a.s + b.s AS s, a.t + b.t AS t, a.label AS l1, a.t AS t1, b.label AS l2, b.t AS t2 FROM opt a, opt b WHERE a.label = {labels[0]} AND b.label = {labels[1]}),
    {name} AS (SELECT * FROM (SELECT *, max(s) OVER (ORDER BY n DESC, s DESC, t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM {name}_all) WHERE above IS NULL OR s > above)"""


@core.add(
    "c4_joint_thresholds",
    f"""WITH {_SWEEP}, names AS (SELECT list_sort(list(DISTINCT label)) AS l FROM sw), four AS (SELECT list_concat(l, ['~1', '~2', '~3', '~4'])[1:4] AS l FROM names),
    opt AS (SELECT label, selected AS n, 10 * correct - 7 * selected AS s, threshold / 100 AS t FROM sw UNION ALL SELECT unnest(l), 0, 0, 1.01 FROM four),
    {_half('ha', ('(SELECT l[1] FROM four)', '(SELECT l[2] FROM four)'))}, {_half('hb', ('(SELECT l[3] FROM four)', '(SELECT l[4] FROM four)'))},
    best AS (SELECT ha.n + hb.n AS n, ha.s + hb.s AS s, [ha.l1, ha.l2, hb.l1, hb.l2] AS l, [ha.t1, ha.t2, hb.t1, hb.t2] AS t FROM ha, hb WHERE ha.n + hb.n > 0 AND ha.s + hb.s >= 0 ORDER BY ha.n + hb.n DESC, ha.s + hb.s DESC, ha.t + hb.t DESC LIMIT 1),
    each AS (SELECT unnest(l) AS label, unnest(t) AS threshold, n, s FROM best)
    SELECT label, CAST(threshold AS DOUBLE) AS threshold, CAST(n AS BIGINT) AS selected, (s + 7 * n) / 10 / n AS precision FROM each WHERE NOT starts_with(label, '~')""",
)
def c4(spark, d):
    # one row per class and thousandth, whatever the number of predictions
    scored = C.sweep(pred(spark, d).where("label <> 'error'").withColumn("score", F.col("c") / 100), ["label"], "score", F.col("label") == F.col("truth"))
    steps = [(r["label"], r["selected"], r["correct"], round(r["threshold"], 3)) for r in C.on_grid(scored, ["label"], 0.001).collect()]
    try:
        best = C.joint_thresholds(steps, 0.7)
    except ValueError:
        return spark.createDataFrame([], "label string, threshold double, selected long, precision double")
    return spark.createDataFrame([(k, v, best["selected"], best["precision"]) for k, v in best["thresholds"].items()], "label string, threshold double, selected long, precision double")


#: Ten classes; the logit of a class adds up every tenth number of the vector, so that all of it counts.
CLASSES = 10


def _folded(first: str, last: str, scale: int) -> str:
    return f"list_transform(generate_series(0, {CLASSES - 1}), lambda k: {scale} * list_sum(list_transform(embedding[{first} + k : {last} : {CLASSES}], lambda x: CAST(x AS DOUBLE))))"


def _class_scores(vector, scale: int):
    at = lambda k: F.filter(vector, lambda x, i: i % CLASSES == k)
    return F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: scale * F.aggregate(at(k), F.lit(0.0), lambda a, x: a + x.cast("double")))


_LOGITS = f"l AS (SELECT vec_id, label, {_folded('1', 'len(embedding)', 4)} AS z FROM embeddings)"


def _logits(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", _class_scores(F.col("embedding"), 4).alias("z"))


@core.add("x6_softmax_top1", f"WITH {_LOGITS}, m AS (SELECT vec_id, z, list_max(z) AS m FROM l) SELECT vec_id, list_position(z, m) - 1 AS top, round(1 / list_sum(list_transform(z, lambda x: exp(x - m))), 6) AS confidence FROM m")
def x6(spark, d):
    return _logits(spark, d).select("vec_id", X.argmax(F.col("z")).alias("top"), F.round(F.array_max(X.softmax(F.col("z"))), 6).alias("confidence"))


@core.add(
    "c5_temperature_sweep",
    f"""WITH {_LOGITS}, t AS (SELECT CAST(round(0.25 + unnest(generate_series(0, 190)) * 0.025, 6) AS DOUBLE) AS t), p AS (SELECT t, list_position(z, list_max(z)) - 1 = label AS ok, round(1 / list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / t))), 9) >= 0.3 AS sel FROM l, t),
    g AS (SELECT t, count(*) FILTER (sel) AS selected, coalesce(count(*) FILTER (sel AND ok) / nullif(count(*) FILTER (sel), 0), 0) AS precision, count(*) FILTER (sel) / count(*) AS coverage FROM p GROUP BY t),
    q AS (SELECT *, selected >= 20 AND precision >= 0.12 AND coverage >= 0.05 AS passes FROM g)
    SELECT t AS temperature, selected, precision, coverage, passes, row_number() OVER (ORDER BY passes DESC, CASE WHEN passes THEN selected END DESC, CASE WHEN passes THEN precision END DESC, CASE WHEN passes THEN t ELSE CAST(t = 1 AS INT) END DESC, t) = 1 AS chosen FROM q""",
)
def c5(spark, d):
    """Of the passing temperatures the one with most selected, then highest precision, then highest; if none passes, 1."""
    t = spark.createDataFrame([(round(0.25 + i * 0.025, 6),) for i in range(191)], "temperature double")
    p = _logits(spark, d).join(F.broadcast(t)).select("temperature", (X.argmax(F.col("z")) == F.col("label")).alias("ok"), (F.round(F.array_max(X.softmax(F.col("z"), F.col("temperature"))), 9) >= 0.3).alias("sel"))
    g = p.groupBy("temperature").agg(F.count_if("sel").alias("selected"), X.ratio(F.count_if(F.col("sel") & F.col("ok")), F.count_if("sel")).alias("precision"), (F.count_if("sel") / F.count("*")).alias("coverage"))
    passing = (F.col("selected") >= 20) & (F.col("precision") >= 0.12) & (F.col("coverage") >= 0.05)
    return C.chosen(g, passing, [F.col("selected"), F.col("precision"), F.col("temperature")], [(F.col("temperature") == 1).cast("int")], [F.col("temperature")])


_POINTS = f"""{PRED}, seq AS (SELECT track, label, truth, c, lag(label) OVER (PARTITION BY track ORDER BY id) AS before FROM pred),
  pts AS (SELECT track, count(*) FILTER (label = truth AND c >= 50) / nullif(count(*) FILTER (c >= 50), 0) AS p, count(*) FILTER (c >= 50) / count(*) AS v, coalesce(count(*) FILTER (label = before) / nullif(count(before), 0), 1) AS s FROM seq GROUP BY track HAVING count(*) FILTER (c >= 50) > 0)"""


@core.add(
    "c7_pareto",
    f"""WITH {_POINTS}, st AS (SELECT * FROM pts WHERE s >= 0.3), ranked AS (SELECT *, CASE WHEN p >= 0.7 AND v >= 0.45 AND s >= 0.3 THEN 2 WHEN p >= 0.7 AND s >= 0.3 THEN 1 ELSE 0 END AS tier FROM pts),
    pick AS (SELECT track, row_number() OVER (ORDER BY tier DESC, CASE WHEN tier > 0 THEN v ELSE p END DESC, CASE WHEN tier > 0 THEN p ELSE s END DESC, CASE WHEN tier > 0 THEN s ELSE v END DESC, track) = 1 AS chosen FROM ranked),
    front AS (SELECT track FROM st x WHERE NOT EXISTS (SELECT 1 FROM st y WHERE y.p >= x.p AND y.v >= x.v AND (y.p > x.p OR y.v > x.v)))
    SELECT track, p, v, s, tier = 2 AS passes, track IN (SELECT track FROM front) AS frontier, chosen FROM ranked JOIN pick USING (track) WHERE chosen OR track IN (SELECT track FROM front)""",
)
def c7(spark, d):
    """The frontier of precision and coverage among stable points, and the point chosen: the most coverage among those that
    pass all gates, else among the precise and stable ones; if there are none, the most precise."""
    sel = F.col("c") >= 50
    seq = pred(spark, d).withColumn("before", F.lag("label").over(Window.partitionBy("track").orderBy("id")))
    kept = F.coalesce(F.try_divide(F.count_if(F.col("label") == F.col("before")), F.count("before")), F.lit(1.0))
    pts = seq.groupBy("track").agg(F.try_divide(F.count_if(sel & (F.col("label") == F.col("truth"))), F.count_if(sel)).alias("p"), (F.count_if(sel) / F.count("*")).alias("v"), kept.alias("s")).where("p is not null")
    precise, steady = F.col("p") >= 0.7, F.col("s") >= 0.3
    tier = F.when(precise & steady & (F.col("v") >= 0.45), 2).when(precise & steady, 1).otherwise(0)
    ranked = C.chosen(pts.withColumn("tier", tier), F.col("tier") > 0, [F.col(c) for c in ("tier", "v", "p", "s")], [F.col(c) for c in ("p", "s", "v")], [F.col("track")])
    front = C.pareto(pts.where(steady), "track", "p", "v").select("track", F.lit(True).alias("frontier"))
    out = ranked.join(front, "track", "left").where("chosen or frontier")
    return out.select("track", "p", "v", "s", (F.col("tier") == 2).alias("passes"), F.coalesce("frontier", F.lit(False)).alias("frontier"), "chosen")


@core.add(
    "c8_max_recall",
    f"""WITH {_SWEEP}, n AS (SELECT label, count(*) FILTER (label = truth) AS total FROM pred GROUP BY 1) SELECT label, threshold, correct AS tp, correct / selected AS precision, correct / total AS recall FROM
    (SELECT sw.*, total, row_number() OVER (PARTITION BY sw.label ORDER BY correct DESC, correct / selected DESC, threshold DESC) AS k FROM sw JOIN n ON n.label = sw.label WHERE correct / selected >= 0.7 AND correct >= 8) WHERE k = 1""",
)
def c8(spark, d):
    n = pred(spark, d).groupBy("label").agg(F.count_if(F.col("label") == F.col("truth")).alias("total"))
    best = C.best_threshold(_swept(spark, d), ["label"], (F.col("precision") >= 0.7) & (F.col("correct") >= 8), [F.desc("correct"), F.desc("precision"), F.desc("threshold")])
    return best.join(n, "label").select("label", "threshold", F.col("correct").alias("tp"), "precision", (F.col("correct") / F.col("total")).alias("recall"))


@core.add(
    "c9_rule_grid",
    f"""WITH {PRED}, g AS (SELECT f, m FROM (SELECT unnest([40, 60, 80]) AS f), (SELECT unnest([1, 2, 3]) AS m)), v AS (SELECT f, m, track, label, count(*) AS n, count(*) FILTER (label = truth) AS ok FROM pred, g WHERE c >= f AND domain < m + 1 GROUP BY 1, 2, 3, 4),
    per AS (SELECT f, m, label, count(*) AS decisions, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(ok) AS BIGINT) AS correct FROM v WHERE n >= m GROUP BY 1, 2, 3),
    a AS (SELECT f, m, CAST(sum(decisions) AS BIGINT) AS decisions, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(correct) AS BIGINT) AS correct, count(*) FILTER (rows >= 10 AND correct / rows >= 0.7) AS classes FROM per GROUP BY 1, 2),
    w AS (SELECT *, correct / rows AS precision, round((correct / rows + 1.96 * 1.96 / (2 * rows) - 1.96 * sqrt((correct / rows * (1 - correct / rows) + 1.96 * 1.96 / (4 * rows)) / rows)) / (1 + 1.96 * 1.96 / rows), 9) AS wilson FROM a),
    q AS (SELECT *, rows >= 150 AND precision >= 0.7 AND wilson >= 0.65 AND classes >= 1 AS passes FROM w)
    SELECT f AS floor, m AS views, decisions, rows, correct, classes, precision, wilson, passes, row_number() OVER (ORDER BY passes DESC, CASE WHEN passes THEN rows ELSE precision END DESC, CASE WHEN passes THEN precision ELSE rows END DESC, f, m) = 1 AS chosen FROM q""",
)
def c9(spark, d):
    """Each rule with its gates: rows selected, precision, its lower Wilson bound, classes that are precise enough; chosen is
    the passing rule that selects most, else the most precise."""
    g = spark.createDataFrame([(f, m) for f in (40, 60, 80) for m in (1, 2, 3)], "floor int, views int")
    p = pred(spark, d).join(F.broadcast(g), (F.col("c") >= F.col("floor")) & (F.col("domain") < F.col("views") + 1))
    v = p.groupBy("floor", "views", "track", "label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("truth")).alias("ok")).where("n >= views")
    per = v.groupBy("floor", "views", "label").agg(F.count("*").alias("decisions"), F.sum("n").alias("rows"), F.sum("ok").alias("correct"))
    a = per.groupBy("floor", "views").agg(*[F.sum(c).alias(c) for c in ("decisions", "rows", "correct")], F.count_if((F.col("rows") >= 10) & (F.col("correct") / F.col("rows") >= 0.7)).alias("classes"))
    share, n, z = F.col("correct") / F.col("rows"), F.col("rows"), 1.96
    wilson = (share + z * z / (2 * n) - z * F.sqrt((share * (1 - share) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    a = a.withColumn("precision", share).withColumn("wilson", F.round(wilson, 9))
    passing = (n >= 150) & (F.col("precision") >= 0.7) & (F.col("wilson") >= 0.65) & (F.col("classes") >= 1)
    return C.chosen(a, passing, [F.col("rows"), F.col("precision")], [F.col("precision"), F.col("rows")], [F.col("floor"), F.col("views")])


@core.add(
    "c10_tie_aware_cutoff",
    f"""WITH {PRED}, r AS (SELECT domain, c, sum(CASE WHEN label = truth THEN 1 ELSE 0 END) OVER w AS tp, count(*) OVER w AS n FROM pred WINDOW w AS (PARTITION BY domain ORDER BY c DESC RANGE UNBOUNDED PRECEDING)), q AS (SELECT DISTINCT domain, c, CAST(tp AS BIGINT) AS tp, n FROM r)
    SELECT domain, c AS threshold, n AS predicted, tp FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY tp DESC, c DESC) AS k FROM q WHERE n >= 10 AND tp / n >= 0.7) WHERE k = 1""",
)
def c10(spark, d):
    s = C.sweep(pred(spark, d), ["domain"], "c", F.col("label") == F.col("truth"))
    best = C.best_threshold(s, ["domain"], (F.col("selected") >= 10) & (F.col("precision") >= 0.7), [F.desc("correct"), F.desc("threshold")])
    return best.select("domain", "threshold", F.col("selected").alias("predicted"), F.col("correct").alias("tp"))


_ROUTER = {"base_gate": (80, 85, 90, 95), "candidate_gate": tuple(range(45, 95, 5)), "margin": (-10, -5, 0, 5), "accept": tuple(range(45, 85, 5))}
_ROUTER_SQL = ", ".join(f"(SELECT unnest({list(v)}) AS {k})" for k, v in _ROUTER.items())


@core.add(
    "c11_router_grid",
    f"""WITH {PRED}, b AS (SELECT CASE WHEN label = 'error' THEN 0 ELSE c END AS base, (c * 13 + id) % 100 AS cand, label <> 'error' AS named, label = truth AS ok, truth = 'click' AS cok FROM pred), g AS (SELECT * FROM {_ROUTER_SQL}),
    r AS (SELECT g.*, base < base_gate AND cand >= candidate_gate AND cand >= base + margin AS routed, base, cand, named, ok, cok FROM b, g),
    s AS (SELECT *, CASE WHEN routed THEN cand >= accept ELSE named AND base >= 80 END AS sel, CASE WHEN routed THEN cok ELSE ok END AS good FROM r),
    m AS (SELECT base_gate, candidate_gate, margin, accept, count(*) FILTER (routed) AS routed, count(*) FILTER (sel) AS selected, coalesce(count(*) FILTER (sel AND good) / nullif(count(*) FILTER (sel), 0), 0) AS precision, count(*) FILTER (sel) / count(*) AS coverage FROM s GROUP BY 1, 2, 3, 4),
    q AS (SELECT *, precision >= 0.7 AS passes FROM m)
    SELECT *, row_number() OVER (ORDER BY passes DESC, CASE WHEN passes THEN coverage ELSE precision END DESC, CASE WHEN passes THEN precision END DESC, base_gate, candidate_gate, margin, accept) = 1 AS chosen FROM q""",
)
def c11(spark, d):
    """A row goes to the candidate if the base is unsure and the candidate sure and ahead by the margin; it is accepted by a
    gate of its own. Chosen is the most coverage at the precision wanted, else the most precise. 'error' is no prediction."""
    named = F.col("label") != "error"
    b = pred(spark, d).select(F.when(named, F.col("c")).otherwise(0).alias("base"), ((F.col("c") * 13 + F.col("id")) % 100).alias("cand"), named.alias("named"), (F.col("label") == F.col("truth")).alias("ok"), (F.col("truth") == "click").alias("cok"))
    b = b.groupBy("base", "cand", "named", "ok", "cok").agg(F.count("*").alias("w"))  # the grid meets distinct scores, not rows
    g = spark.createDataFrame(list(itertools.product(*_ROUTER.values())), ", ".join(f"{k} int" for k in _ROUTER))
    routed = (F.col("base") < F.col("base_gate")) & (F.col("cand") >= F.col("candidate_gate")) & (F.col("cand") >= F.col("base") + F.col("margin"))
    sel = F.when(routed, F.col("cand") >= F.col("accept")).otherwise(F.col("named") & (F.col("base") >= 80))
    good = F.when(routed, F.col("cok")).otherwise(F.col("ok"))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("w"))), F.lit(0)).cast("long")
    m = C.grid(b, g, list(_ROUTER), routed=count(routed), selected=count(sel), right=count(sel & good), n=F.sum("w"))
    m = m.select(*_ROUTER, "routed", "selected", X.ratio("right", "selected").alias("precision"), (F.col("selected") / F.col("n")).alias("coverage"))
    return C.chosen(m, F.col("precision") >= 0.7, [F.col("coverage"), F.col("precision")], [F.col("precision")], [F.col(k) for k in _ROUTER])


_SOFT = lambda z: f"list_transform({z}, lambda x: exp(x - list_max({z})) / list_sum(list_transform({z}, lambda y: exp(y - list_max({z})))))"


@core.add(
    "c12_probability_blend",
    f"""WITH v AS (SELECT label, {_folded('1', 'len(embedding) // 2', 6)} AS a, {_folded('len(embedding) // 2 + 1', 'len(embedding)', 6)} AS b FROM embeddings), s AS (SELECT label, {_SOFT('a')} AS a, {_SOFT('b')} AS b FROM v),
    w AS (SELECT unnest(generate_series(0, 20)) / 20 AS alpha), z AS (SELECT alpha, label, list_transform(generate_series(1, {CLASSES}), lambda i: round(alpha * a[i] + (1 - alpha) * b[i], 9)) AS z FROM s, w),
    m AS (SELECT alpha, count(*) AS n, count(*) FILTER (list_max(z) >= 0.3) AS selected, count(*) FILTER (list_max(z) >= 0.3 AND list_position(z, list_max(z)) - 1 = label) AS correct FROM z GROUP BY alpha),
    q AS (SELECT *, coalesce(correct / nullif(selected, 0), 0) AS precision, selected / n AS coverage, coalesce(correct / nullif(selected, 0), 0) >= 0.1 AND selected / n >= 0.1 AS passes FROM m)
    SELECT *, row_number() OVER (ORDER BY passes DESC, CASE WHEN passes THEN coverage ELSE CAST(alpha = 1 AS INT) END DESC, CASE WHEN passes THEN precision END DESC, alpha) = 1 AS chosen FROM q""",
)
def c12(spark, d):
    """Two models' probabilities mixed: chosen is the passing share with most coverage, then precision; if none passes, 1."""
    half = F.call_function("div", F.size("embedding"), F.lit(2)).cast("int")
    parts = [X.softmax(_class_scores(v, 6)) for v in (F.slice("embedding", F.lit(1), half), F.slice("embedding", half + 1, F.size("embedding")))]
    e = table(spark, d, "embeddings").select("label", *[p.alias(n) for p, n in zip(parts, "ab", strict=True)])
    w = spark.createDataFrame([(i / 20,) for i in range(21)], "alpha double")
    z = e.join(F.broadcast(w)).select("alpha", "label", F.zip_with("a", "b", lambda x, y: F.round(F.col("alpha") * x + (1 - F.col("alpha")) * y, 9)).alias("z"))
    sure = F.array_max("z") >= 0.3
    m = z.groupBy("alpha").agg(F.count("*").alias("n"), F.count_if(sure).alias("selected"), F.count_if(sure & (X.argmax(F.col("z")) == F.col("label"))).alias("correct"))
    m = m.withColumn("precision", X.ratio("correct", "selected")).withColumn("coverage", F.col("selected") / F.col("n"))
    return C.chosen(m, (F.col("precision") >= 0.1) & (F.col("coverage") >= 0.1), [F.col("coverage"), F.col("precision")], [(F.col("alpha") == 1).cast("int")], [F.col("alpha")])


# ---- audits

_UNPIVOT = f"u AS (SELECT unnest(['camera', 'video', 'track']) AS field, unnest([{spell.key('camera_id')}, {spell.key('video_id')}, {spell.key('track_group')}]) AS value, {SPLIT} AS split FROM attribute_manifest)"


@core.add("v1_group_leakage", f"WITH {_UNPIVOT} SELECT field, value, count(DISTINCT split) AS splits, count(*) AS n FROM u WHERE value IS NOT NULL AND split IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT split) > 1")
def v1(spark, d):
    m = manifest(spark, d).select(normal.split_name("split").alias("split"), normal.key("camera_id").alias("camera"), normal.key("video_id").alias("video"), normal.key("track_group").alias("track"))
    u = m.unpivot("split", ["camera", "video", "track"], "field", "value").where("value is not null and split is not null")
    per = u.groupBy("field", "value", "split").agg(F.count("*").alias("k"))
    return per.groupBy("field", "value").agg(F.count("*").alias("splits"), F.sum("k").alias("n")).where("splits > 1")


_RULES = [
    ("missing_split", f"{SPLIT} IS NULL", lambda: normal.split_name("split").isNull()),
    ("unknown_split", f"{SPLIT} NOT IN ('train', 'validation', 'test')", lambda: ~normal.split_name("split").isin("train", "validation", "test")),
    ("missing_hash", f"{spell.digest('stage177_pixel_sha256')} IS NULL", lambda: normal.digest("stage177_pixel_sha256").isNull()),
    ("bad_hash", f"NOT regexp_full_match({spell.digest('stage177_pixel_sha256')}, '[0-9a-f]{{64}}')", lambda: ~normal.digest("stage177_pixel_sha256").rlike("^[0-9a-f]{64}$")),
    ("bad_flag", f"{spell.trimmed('night')} NOT IN ('1', 'true', 'yes', 'y', 'on', '0', 'false', 'no', 'n', 'off', '')", lambda: P.strict_flag("night").isNull() & F.col("night").isNotNull()),
    ("self_pointer", f"{spell.path('stage177_near_duplicate_of')} = {spell.path('image_path')}", lambda: normal.path("stage177_near_duplicate_of") == normal.path("image_path")),
    ("no_source", f"{spell.key('source_dataset')} IS NULL OR {spell.key('source_license')} IS NULL", lambda: normal.key("source_dataset").isNull() | normal.key("source_license").isNull()),
    ("no_license_review", f"{spell.key('review_status')} = 'approved' AND {spell.key('source_license')} IS NULL", lambda: F.coalesce(normal.key("review_status") == "approved", F.lit(False)) & normal.key("source_license").isNull()),
    ("unsafe_path", f"image_path IS NULL OR starts_with(image_path, '/') OR regexp_matches(image_path, '^[A-Za-z]:') OR len(list_filter(string_split(replace(image_path, chr(92), '/'), '/'), lambda x: x = '..')) > 0",
     lambda: F.col("image_path").isNull() | F.col("image_path").startswith("/") | F.col("image_path").rlike("^[A-Za-z]:") | F.array_contains(F.split(F.translate("image_path", "\\", "/"), "/"), "..")),
    ("repeated_path", "path_count > 1", lambda: F.col("path_count") > 1),
    *[(f"no_{c}", f"{spell.key(c)} IS NULL", lambda c=c: normal.key(c).isNull()) for c in ("camera_id", "video_id", "track_group")],
    *[(f"leaking_{c}", f"{c}_splits > 1", lambda c=c: F.col(f"{c}_splits") > 1) for c in ("camera_id", "video_id", "track_group")],
    *[(f"unknown_{c}", f"{e} NOT IN ({spell.members(v)})", lambda f=f, v=v: ~f().isin(*v)) for c, e, f, v in (
        ("body_type", BODY, lambda: normal.label("body_type"), P.BODY_TYPES), ("color", COLOR, lambda: normal.color("color"), P.COLORS),
        ("crop_quality", spell.key("crop_quality"), lambda: normal.key("crop_quality"), P.QUALITIES), ("viewpoint", spell.key("viewpoint"), lambda: normal.key("viewpoint"), P.VIEWPOINTS))],
    ("poor_crop_has_label", f"{spell.key('crop_quality')} = 'poor' AND ({BODY} IS NOT NULL OR {COLOR} IS NOT NULL)", lambda: (normal.key("crop_quality") == "poor") & (normal.label("body_type").isNotNull() | normal.color("color").isNotNull())),
]


def _checked(spark, d):
    """The manifest with what rules need to know of other rows: path_count, and per key the number of splits it is in."""
    m = manifest(spark, d).withColumn("_path", normal.path("image_path"))
    often = m.where("_path is not null").groupBy("_path").agg(F.count("*").alias("path_count")).where("path_count > 1")
    m = m.join(often, "_path", "left").drop("_path")
    for c in ("camera_id", "video_id", "track_group"):
        key = manifest(spark, d).select(normal.key(c).alias("_key"), normal.split_name("split").alias("_split")).where("_key is not null and _split is not null")
        torn = key.groupBy("_key", "_split").agg(F.lit(1).alias("one")).groupBy("_key").agg(F.count("*").alias(f"{c}_splits")).where(f"{c}_splits > 1")
        m = m.join(torn, normal.key(c) == F.col("_key"), "left").drop("_key")
    return m


_CHECKED = f"""k AS (SELECT stage177_row_number AS r, {SPLIT} AS s, {spell.path('image_path')} AS p, {spell.key('camera_id')} AS c, {spell.key('video_id')} AS v, {spell.key('track_group')} AS t FROM attribute_manifest),
  paths AS (SELECT p, count(*) AS path_count FROM k WHERE p IS NOT NULL GROUP BY p), cs AS (SELECT c, count(DISTINCT s) AS camera_id_splits FROM k WHERE c IS NOT NULL GROUP BY c), vs AS (SELECT v, count(DISTINCT s) AS video_id_splits FROM k WHERE v IS NOT NULL GROUP BY v),
  ts AS (SELECT t, count(DISTINCT s) AS track_group_splits FROM k WHERE t IS NOT NULL GROUP BY t), checked AS (SELECT m.*, path_count, camera_id_splits, video_id_splits, track_group_splits
  FROM attribute_manifest m JOIN k ON k.r = stage177_row_number LEFT JOIN paths USING (p) LEFT JOIN cs USING (c) LEFT JOIN vs USING (v) LEFT JOIN ts USING (t))"""


@core.add("v2_manifest_rules", f"WITH {_CHECKED}, r AS (SELECT stage177_row_number AS row_number, unnest([{', '.join(f'CASE WHEN {q} THEN {chr(39)}{n}{chr(39)} END' for n, q, _ in _RULES)}]) AS rule FROM checked) SELECT row_number, rule FROM r WHERE rule IS NOT NULL")
def v2(spark, d):
    """One row per row and rule it breaks, in one pass over the manifest and what other rows say."""
    return _checked(spark, d).select("row_number", F.explode(P.tags(*[(n, f()) for n, _, f in _RULES])).alias("rule"))


_APPROVED = f"coalesce({spell.key('review_status')} = 'approved', false)"
_HEADS = {h: f"coalesce({_flag}, {_APPROVED})" for h, _flag in ((h, f"(CASE WHEN {spell.key(f'{h}_supervised')} IN ('1', 'true', 'yes', 'y', 'on') THEN true WHEN {spell.key(f'{h}_supervised')} IN ('0', 'false', 'no', 'n', 'off') THEN false END)") for h in ("body_type", "color"))}
#: Checks of a table of crops as it was typed in: an approved row has to be whole, another may lack what it does not say.
_CROP_CHECKS = [
    *[(f"invalid_{c}", f"({_APPROVED} OR trim(coalesce({c}, '')) <> '') AND NOT coalesce({c} IN ({spell.members(v)}), false)", lambda c=c, v=v: (_approved() | (F.trim(F.coalesce(c, F.lit(""))) != "")) & ~F.coalesce(F.col(c).isin(*v), F.lit(False)))
      for c, v in (("body_type", P.BODY_TYPES), ("color", P.COLORS), ("crop_quality", P.QUALITIES), ("viewpoint", P.VIEWPOINTS))],
    ("invalid_split", "NOT coalesce(split IN ('train', 'validation', 'test'), false)", lambda: ~F.coalesce(F.col("split").isin("train", "validation", "test"), F.lit(False))),
    *[(f"invalid_{c}", f"({_APPROVED} OR trim(coalesce({c}, '')) <> '') AND {spell.trimmed(c)} NOT IN ('1', 'true', 'yes', 'y', 'on', '0', 'false', 'no', 'n', 'off')", lambda c=c: (_approved() | (F.trim(F.coalesce(c, F.lit(""))) != "")) & F.col(c).isNotNull() & normal.flag(c).isNull()) for c in ("blur", "occluded", "truncated", "night")],
    ("poor_crop_named", f"{_APPROVED} AND crop_quality = 'poor' AND (body_type <> 'unknown' OR color <> 'unknown')", lambda: _approved() & (F.col("crop_quality") == "poor") & ((F.col("body_type") != "unknown") | (F.col("color") != "unknown"))),
    ("poor_crop_unsupervised", f"{_APPROVED} AND crop_quality = 'poor' AND NOT ({_HEADS['body_type']} AND {_HEADS['color']})", lambda: _approved() & (F.col("crop_quality") == "poor") & ~(_supervised("body_type") & _supervised("color"))),
    *[(f"unsupervised_{h}_named", f"{_APPROVED} AND NOT {_HEADS[h]} AND {h} <> 'unknown'", lambda h=h: _approved() & ~_supervised(h) & (F.col(h) != "unknown")) for h in ("body_type", "color")],
]
_LEAST_CROPS = 100_000


def _approved():
    return F.coalesce(normal.key("review_status") == "approved", F.lit(False))


def _supervised(head):
    return F.coalesce(normal.flag(f"{head}_supervised"), _approved())


@core.add(
    "v3_manifest_rule_counts",
    f"""WITH r AS (SELECT unnest([{', '.join(f'CASE WHEN {q} THEN {chr(39)}{n}{chr(39)} END' for n, q, _ in _CROP_CHECKS)}]) AS rule FROM attribute_manifest),
    n AS (SELECT count(*) FILTER ({_APPROVED} AND coalesce(crop_quality <> 'poor', true) AND ({_HEADS['body_type']} AND coalesce(body_type IN ({spell.members(P.BODY_TYPES[:-1])}), false) OR {_HEADS['color']} AND coalesce(color IN ({spell.members(P.COLORS[:-1])}), false))) AS n FROM attribute_manifest)
    SELECT rule, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY rule UNION ALL SELECT 'fewer_than_required', n FROM n WHERE n < {_LEAST_CROPS}""",
)
def v3(spark, d):
    """Checks of the crops as typed, counted, and a gate on the number of approved crops that are supervised and named."""
    m = manifest(spark, d)
    broken = m.select(F.explode(P.tags(*[(n, f()) for n, _, f in _CROP_CHECKS])).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    named = lambda h, v: _supervised(h) & F.coalesce(F.col(h).isin(*v[:-1]), F.lit(False))
    good = _approved() & F.coalesce(F.col("crop_quality") != "poor", F.lit(True)) & (named("body_type", P.BODY_TYPES) | named("color", P.COLORS))
    return broken.union(m.agg(F.count_if(good).alias("n")).where(F.col("n") < _LEAST_CROPS).select(F.lit("fewer_than_required"), "n"))


@core.add(
    "v4_box_lines",
    """WITH l AS (SELECT frame_id, capture_time_ms, (source_sequence % 12) || ' ' || (source_sequence % 11) / 10.0 || ' 0.5 ' || (source_sequence % 6) / 5.0 || ' 0.25' || CASE WHEN source_sequence % 17 = 0 THEN ' x' ELSE '' END AS line FROM camera_frames WHERE source_sequence IS NOT NULL), p AS (SELECT *, string_split(line, ' ') AS t FROM l)
    SELECT frame_id, capture_time_ms, CASE WHEN len(t) <> 5 THEN 'field_count' WHEN try_cast(t[1] AS INT) IS NULL OR try_cast(t[1] AS INT) NOT BETWEEN 0 AND 9 THEN 'class_id' WHEN try_cast(t[2] AS DOUBLE) NOT BETWEEN 0 AND 1 OR try_cast(t[4] AS DOUBLE) <= 0 OR try_cast(t[4] AS DOUBLE) > 1 THEN 'coordinates' ELSE 'valid' END AS outcome FROM p""",
)
def v4(spark, d):
    s = F.col("source_sequence")
    num = lambda c: c.cast("double").cast("string")
    line = F.concat_ws(" ", (s % 12).cast("string"), num((s % 11) / 10.0), F.lit("0.5"), num((s % 6) / 5.0), F.lit("0.25"), F.when(s % 17 == 0, "x"))
    t = F.col("t")
    f = table(spark, d, "camera_frames").where("source_sequence is not null").select("frame_id", "capture_time_ms", F.split(line, " ").alias("t"))
    klass, cx, w = F.get(t, 0).try_cast("int"), F.get(t, 1).try_cast("double"), F.get(t, 3).try_cast("double")
    outcome = P.first_reason(("field_count", F.size(t) != 5), ("class_id", klass.isNull() | ~klass.between(0, 9)), ("coordinates", ~cx.between(0.0, 1.0) | (w <= 0) | (w > 1)), otherwise="valid")
    return f.select("frame_id", "capture_time_ms", outcome.alias("outcome"))


@core.add(
    "v5_first_failing_rule",
    "SELECT event_id, created_at_ms, CASE WHEN detector_artifact IS NULL OR detector_artifact = '' THEN 'detector' WHEN NOT regexp_full_match(detector_artifact, '[a-z]+-[a-z]+-r\\d+') THEN 'detector_form' WHEN attribute_artifact IS NULL OR attribute_artifact = '' THEN 'attribute' WHEN coalesce(labels_version, '') <> 'labels-1' THEN 'labels' ELSE 'valid' END AS outcome FROM vehicle_track_results",
)
def v5(spark, d):
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    rule = P.first_reason(("detector", blank("detector_artifact")), ("detector_form", ~F.col("detector_artifact").rlike(r"^[a-z]+-[a-z]+-r\d+$")), ("attribute", blank("attribute_artifact")), ("labels", F.coalesce("labels_version", F.lit("")) != "labels-1"), otherwise="valid")
    return table(spark, d, "vehicle_track_results").select("event_id", "created_at_ms", rule.alias("outcome"))


@core.add("v6_uniqueness", "SELECT 'task_id' AS field, count(*) - count(DISTINCT task_id) AS repeated FROM camera_tasks UNION ALL SELECT 'name', count(name) - count(DISTINCT name) FROM camera_tasks")
def v6(spark, d):
    t = table(spark, d, "camera_tasks")
    return t.agg((F.count("*") - F.count_distinct("task_id")).alias("repeated")).select(F.lit("task_id").alias("field"), "repeated").union(t.agg((F.count("name") - F.count_distinct("name")).alias("repeated")).select(F.lit("name"), "repeated"))


@core.add(
    "v7_evidence_gate",
    f"""WITH {PRED}, m AS (SELECT unnest(['accuracy', 'coverage', 'rows']) AS metric, unnest([count(*) FILTER (label = truth) / count(*), count(*) FILTER (c >= 60) / count(*), CAST(count(*) AS DOUBLE)]) AS value FROM pred), p(metric, least) AS (VALUES ('accuracy', 0.5), ('coverage', 0.6), ('rows', 100.0), ('latency', 1.0))
    SELECT p.metric, CAST(p.least AS DOUBLE) AS least, m.value, coalesce(m.value >= p.least, false) AS passed FROM p LEFT JOIN m ON m.metric = p.metric""",
)
def v7(spark, d):
    policy = spark.createDataFrame([("accuracy", 0.5), ("coverage", 0.6), ("rows", 100.0), ("latency", 1.0)], "metric string, least double")
    g = pred(spark, d).agg((F.count_if(F.col("label") == F.col("truth")) / F.count("*")).alias("accuracy"), (F.count_if(F.col("c") >= 60) / F.count("*")).alias("coverage"), F.count("*").cast("double").alias("rows"))
    m = g.unpivot([], ["accuracy", "coverage", "rows"], "metric", "value")
    return policy.join(m, "metric", "left").select("metric", "least", "value", F.coalesce(F.col("value") >= F.col("least"), F.lit(False)).alias("passed"))


@core.add(
    "v8_regression_gate",
    f"WITH {PRED}, b AS (SELECT label, count(*) FILTER (label = truth) / count(*) AS v FROM pred WHERE domain < 2 GROUP BY 1), n AS (SELECT label, count(*) FILTER (label = truth) / count(*) AS v FROM pred WHERE domain >= 2 GROUP BY 1) SELECT b.label, b.v AS before, n.v AS after, n.v >= b.v - 0.005 AS passed FROM b JOIN n ON n.label = b.label",
)
def v8(spark, d):
    acc = F.count_if(F.col("label") == F.col("truth")) / F.count("*")
    p = pred(spark, d)
    b, n = p.where("domain < 2").groupBy("label").agg(acc.alias("before")), p.where("domain >= 2").groupBy("label").agg(acc.alias("after"))
    return b.join(n, "label").select("label", "before", "after", (F.col("after") >= F.col("before") - 0.005).alias("passed"))


@core.add("v9_gates", f"WITH {PRED} SELECT domain, count(*) >= 100 AS enough_rows, count(*) FILTER (label = truth) / count(*) >= 0.5 AS precise, count(DISTINCT label) >= 3 AS all_classes FROM pred GROUP BY domain")
def v9(spark, d):
    return pred(spark, d).groupBy("domain").agg((F.count("*") >= 100).alias("enough_rows"), (F.count_if(F.col("label") == F.col("truth")) / F.count("*") >= 0.5).alias("precise"), (F.count_distinct("label") >= 3).alias("all_classes"))
