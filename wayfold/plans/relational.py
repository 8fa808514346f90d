"""Queries over the relational store: scans, filters, joins, counts, windows, paging, mutations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import normal
from ..functions import predicates as P
from ..functions import scalar as X
from ..operators import relational as R
from ..sources.tables import table
from . import spell
from .registry import core

#: The time at which queries over the event tables stand (2026-08-04 00:00 UTC), in ms.
NOW = 1_785_801_600_000
DAY = 86_400_000


def _t(name):
    return lambda spark, d: table(spark, d, name)


vision, tracks, alerts, outbox, frames, tasks, commands, manifest = map(
    _t, ("vision_events", "vehicle_track_results", "security_alert_events", "callback_outbox", "camera_frames", "camera_tasks", "camera_task_commands", "attribute_manifest")
)

# ---- scans


@core.add("s1_parameterized_scan", "SELECT event_id, task_id, severity, occurred_at_ms FROM security_alert_events WHERE category = 'safety' AND severity >= 2")
def s1(spark, d):
    return spark.sql("SELECT event_id, task_id, severity, occurred_at_ms FROM {rows} WHERE category = :category AND severity >= :least", args={"category": "safety", "least": 2}, rows=alerts(spark, d))


@core.add("s2_point_lookup", "SELECT task_id, name, version, desired_state FROM camera_tasks WHERE task_id = 'gate_harbor_01'")
def s2(spark, d):
    return tasks(spark, d).where(F.col("task_id") == "gate_harbor_01").select("task_id", "name", "version", "desired_state")


# ---- filters


@core.add("f1_optional_filters", "SELECT event_id, task_id, event_kind FROM vision_events WHERE event_kind = 'algorithm_alert'")
def f1(spark, d):
    return vision(spark, d).where(P.optional_equals("task_id", "") & P.optional_equals("event_kind", "algorithm_alert")).select("event_id", "task_id", "event_kind")


@core.add("f2_time_range", f"SELECT event_id, occurred_at_ms FROM security_alert_events WHERE occurred_at_ms >= {NOW} AND occurred_at_ms <= {NOW + 2 * DAY}")
def f2(spark, d):
    return alerts(spark, d).where(P.optional_range("occurred_at_ms", NOW, NOW + 2 * DAY)).select("event_id", "occurred_at_ms")


@core.add("f2_open_range", f"SELECT event_id, occurred_at_ms FROM security_alert_events WHERE occurred_at_ms >= {NOW}")
def f2_open(spark, d):
    return alerts(spark, d).where(P.optional_range("occurred_at_ms", NOW, 0)).select("event_id", "occurred_at_ms")


@core.add("f3_severity", "SELECT event_id, severity FROM security_alert_events WHERE severity >= 5")
def f3(spark, d):
    return alerts(spark, d).where(P.at_least_severity("severity", 9)).select("event_id", "severity")


@core.add("f4_soft_delete", "SELECT task_id, deleted_at_ms FROM camera_tasks WHERE deleted_at_ms IS NULL")
def f4(spark, d):
    return tasks(spark, d).where(P.visible()).select("task_id", "deleted_at_ms")


@core.add("f5_status_in", "SELECT outbox_id, event_id, status FROM callback_outbox WHERE status IN ('pending', 'retry', 'delivering')")
def f5(spark, d):
    return outbox(spark, d).where(F.col("status").isin("pending", "retry", "delivering")).select("outbox_id", "event_id", "status")


_W = "lower(trim(coalesce(color_supervised, ''), ' '))"
_TRUE = "('1', 'true', 'yes', 'y', 'on')"


@core.add(
    "f6_supervision",
    f"""SELECT stage177_row_number AS row_number, {_W} = '' OR {_W} IN {_TRUE} AS blank_true, {_W} IN {_TRUE} AS blank_false,
    CASE WHEN {_W} = '' THEN lower(trim(coalesce(review_status, ''), ' ')) = 'approved' ELSE {_W} IN {_TRUE} END AS blank_approved FROM attribute_manifest""",
)
def f6(spark, d):
    s = lambda mode: P.supervised("color_supervised", blank=mode).alias(f"blank_{mode}")
    return manifest(spark, d).select(F.col("stage177_row_number").alias("row_number"), s("true"), s("false"), s("approved"))


_N = "lower(trim(coalesce(night, ''), ' '))"


@core.add(
    "f7_flag_vocabularies",
    f"""SELECT stage177_row_number AS row_number, {_N} IN {_TRUE} AS wide, {_N} IN ('1', 'true', 'yes') AS narrow,
    CASE WHEN {_N} IN {_TRUE} THEN true WHEN {_N} IN ('0', 'false', 'no', 'n', 'off', '') THEN false END AS strict FROM attribute_manifest""",
)
def f7(spark, d):
    return manifest(spark, d).select(F.col("stage177_row_number").alias("row_number"), P.truthy("night").alias("wide"), P.truthy("night", P.TRUE_NARROW).alias("narrow"), P.strict_flag("night").alias("strict"))


_ID = "regexp_full_match(coalesce({0}, ''), '[A-Za-z0-9_.-]{{1,160}}')"
_EVENT_RULES = [
    ("bad_event_id", f"NOT {_ID.format('event_id')}", lambda: ~P.identifier("event_id")),
    ("bad_task_id", f"NOT {_ID.format('task_id')}", lambda: ~P.identifier("task_id")),
    ("bad_run_id", f"NOT {_ID.format('run_id')}", lambda: ~P.identifier("run_id")),
    ("bad_camera_id", f"NOT {_ID.format('camera_id')}", lambda: ~P.identifier("camera_id")),
    ("camera_is_not_task", "task_id IS DISTINCT FROM camera_id", lambda: ~F.col("task_id").eqNullSafe(F.col("camera_id"))),
    ("bad_track", "coalesce(track_id, 0) <= 0", lambda: F.coalesce("track_id", F.lit(0)) <= 0),
    ("bad_first_time", "coalesce(first_seen_at_ms, 0) <= 0", lambda: F.coalesce("first_seen_at_ms", F.lit(0)) <= 0),
    ("times_out_of_order", "NOT coalesce(first_seen_at_ms <= last_seen_at_ms AND last_seen_at_ms <= occurred_at_ms AND occurred_at_ms <= created_at_ms, false)", lambda: ~F.coalesce((F.col("first_seen_at_ms") <= F.col("last_seen_at_ms")) & (F.col("last_seen_at_ms") <= F.col("occurred_at_ms")) & (F.col("occurred_at_ms") <= F.col("created_at_ms")), F.lit(False))),
    *[(f"unknown_{c}", f"NOT coalesce({c} IN ({spell.members(v)}), false)", lambda c=c, v=v: ~F.coalesce(F.col(c).isin(*v), F.lit(False))) for c, v in (("vehicle_class", P.VEHICLE_CLASSES), ("body_type", P.BODY_TYPES), ("color", P.COLORS))],
    ("class_confidence", "NOT coalesce(vehicle_class_confidence BETWEEN 0 AND 1, false)", lambda: ~P.between01("vehicle_class_confidence")),
    ("body_confidence", "NOT coalesce(body_type_confidence BETWEEN 0 AND 1, false)", lambda: ~P.between01("body_type_confidence")),
    ("color_confidence", "NOT coalesce(color_confidence BETWEEN 0 AND 1, false)", lambda: ~P.between01("color_confidence")),
    ("samples", "NOT coalesce(body_type_samples_used BETWEEN 0 AND 64 AND color_samples_used BETWEEN 0 AND 64, false)", lambda: ~F.coalesce(F.col("body_type_samples_used").between(0, 64) & F.col("color_samples_used").between(0, 64), F.lit(False))),
    ("stable_without_samples", "coalesce((body_type_stable AND body_type_samples_used = 0) OR (color_stable AND color_samples_used = 0), false)", lambda: F.coalesce((F.col("body_type_stable") & (F.col("body_type_samples_used") == 0)) | (F.col("color_stable") & (F.col("color_samples_used") == 0)), F.lit(False))),
    ("crop_quality", "NOT coalesce(crop_quality BETWEEN 0 AND 1, false)", lambda: ~P.between01("crop_quality")),
    *[(f"bad_{c}", f"NOT {_ID.format(c)}", lambda c=c: ~P.identifier(c)) for c in ("detector_artifact", "attribute_artifact", "labels_version", "config_version")],
    ("bad_evidence", f"coalesce(evidence_frame_id, '') <> '' AND NOT {_ID.format('evidence_frame_id')}", lambda: (F.coalesce("evidence_frame_id", F.lit("")) != "") & ~P.identifier("evidence_frame_id")),
    ("bad_reason", f"NOT coalesce(finalized_reason IN ({spell.members(P.FINAL_REASONS)}), false)", lambda: ~F.coalesce(F.col("finalized_reason").isin(*P.FINAL_REASONS), F.lit(False))),
    ("unsafe_path", "snapshot_relative_path IS NOT NULL AND snapshot_relative_path <> '' AND (starts_with(snapshot_relative_path, '/') OR contains(snapshot_relative_path, chr(92)) OR regexp_matches(snapshot_relative_path, '^[A-Za-z]:') OR len(list_filter(string_split(snapshot_relative_path, '/'), lambda x: x IN ('', '.', '..'))) > 0)", lambda: F.col("snapshot_relative_path").isNotNull() & (F.col("snapshot_relative_path") != "") & ~P.safe_path("snapshot_relative_path")),
]


@core.add("f8_event_validation", f"SELECT event_id, track_id, CASE {' '.join(f'WHEN {sql} THEN {chr(39)}{name}{chr(39)}' for name, sql, _ in _EVENT_RULES)} ELSE 'accepted' END AS reason, created_at_ms FROM vehicle_track_results")
def f8(spark, d):
    return tracks(spark, d).select("event_id", "track_id", P.first_reason(*[(n, f()) for n, _, f in _EVENT_RULES]).alias("reason"), "created_at_ms")


_TASK_OK = """coalesce(frame_interval_ms BETWEEN 100 AND 3600000 AND output_mode IN ('latest', 'archive', 'both') AND jpeg_quality BETWEEN 1 AND 100
    AND (max_width = 0 OR max_width BETWEEN 64 AND 8192) AND (max_height = 0 OR max_height BETWEEN 64 AND 8192) AND retention_days BETWEEN 1 AND 3650
    AND max_saved_frames BETWEEN 1 AND 1000000 AND target_infer_fps BETWEEN 0.1 AND 120, false)
    AND len(coalesce(algorithms, [])) <= 32 AND len(list_distinct(coalesce(algorithms, []))) = len(coalesce(algorithms, []))"""


@core.add("f9_task_bounds", f"SELECT task_id, {_TASK_OK} AS valid FROM camera_tasks")
def f9(spark, d):
    dim = lambda c: (F.col(c) == 0) | F.col(c).between(64, 8192)
    algorithms = F.coalesce("algorithms", F.array().cast("array<string>"))
    ok = (
        F.col("frame_interval_ms").between(100, 3_600_000) & F.col("output_mode").isin("latest", "archive", "both") & F.col("jpeg_quality").between(1, 100) & dim("max_width") & dim("max_height")
        & F.col("retention_days").between(1, 3650) & F.col("max_saved_frames").between(1, 1_000_000) & F.col("target_infer_fps").between(0.1, 120.0)
    )
    return tasks(spark, d).select("task_id", (F.coalesce(ok, F.lit(False)) & (F.size(algorithms) <= 32) & (F.size(F.array_distinct(algorithms)) == F.size(algorithms))).alias("valid"))


@core.add("f10_alert_bounds", "SELECT event_id, severity BETWEEN 1 AND 5 AND (confidence IS NULL OR confidence BETWEEN 0 AND 1) AND length(coalesce(payload_json, '')) <= 65536 AS valid, created_at_ms FROM security_alert_events")
def f10(spark, d):
    ok = F.col("severity").between(1, 5) & (F.col("confidence").isNull() | F.col("confidence").between(0.0, 1.0)) & (F.length(F.coalesce("payload_json", F.lit(""))) <= 65536)
    return alerts(spark, d).select("event_id", ok.alias("valid"), "created_at_ms")


_SAFE = "coalesce(NOT starts_with({0}, '/') AND NOT contains({0}, chr(92)) AND NOT regexp_matches({0}, '^[A-Za-z]:') AND len(list_filter(string_split({0}, '/'), lambda x: x IN ('', '.', '..'))) = 0, false)"


@core.add("f11_safe_paths", f"SELECT stage177_row_number AS row_number, {_SAFE.format('image_path')} AS image, {_SAFE.format('stage177_near_duplicate_of')} AS pointer FROM attribute_manifest")
def f11(spark, d):
    return manifest(spark, d).select(F.col("stage177_row_number").alias("row_number"), P.safe_path("image_path").alias("image"), P.safe_path("stage177_near_duplicate_of").alias("pointer"))


@core.add(
    "f12_box_validity",
    """WITH b AS (SELECT frame_id, capture_time_ms, (source_sequence % 11) / 10.0 AS x1, (source_sequence % 7) / 10.0 AS y1, (source_sequence % 13) / 10.0 AS x2, (source_sequence % 5) / 4.0 AS y2 FROM camera_frames)
    SELECT frame_id, capture_time_ms, coalesce(0 <= x1 AND x1 < x2 AND x2 <= 1 AND 0 <= y1 AND y1 < y2 AND y2 <= 1, false) AS valid FROM b""",
)
def f12(spark, d):
    s = F.col("source_sequence")
    return frames(spark, d).select("frame_id", "capture_time_ms", P.valid_box((s % 11) / 10.0, (s % 7) / 10.0, (s % 13) / 10.0, (s % 5) / 4.0).alias("valid"))


_LIMITS = {"white": 0.6, "black": 0.7, "gray": 0.65, "red": 0.5, "blue": 0.8}


@core.add(
    "f13_threshold_gate",
    f"""WITH t(label, threshold) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in _LIMITS.items())})
    SELECT event_id, created_at_ms, CASE WHEN color <> 'unknown' AND color_confidence >= coalesce(threshold, 1.01) THEN color ELSE 'unknown' END AS emitted FROM vehicle_track_results LEFT JOIN t ON label = color""",
)
def f13(spark, d):
    limits = spark.createDataFrame(list(_LIMITS.items()), "label string, threshold double")
    return tracks(spark, d).join(F.broadcast(limits), F.col("color") == F.col("label"), "left").select("event_id", "created_at_ms", P.gated("color", "color_confidence", "threshold").alias("emitted"))


@core.add("f14_marker_exclusion", "SELECT stage177_row_number AS row_number FROM attribute_manifest WHERE NOT (contains(coalesce(source_manifest, ''), 'harbor') OR contains(coalesce(image_path, ''), 'harbor') OR contains(coalesce(source_manifest, ''), 'synth') OR contains(coalesce(image_path, ''), 'synth'))")
def f14(spark, d):
    return manifest(spark, d).where(~P.marked(["source_manifest", "image_path"], ["harbor", "synth"])).select(F.col("stage177_row_number").alias("row_number"))


@core.add("f15_geometry", "SELECT frame_id, capture_time_ms FROM camera_frames WHERE width > 0 AND height > 0 AND CAST(width AS DOUBLE) / height BETWEEN 0.45 AND 4 AND least(width, height) >= 480 AND coalesce(size_bytes, 0) BETWEEN 100000 AND 900000")
def f15(spark, d):
    aspect = F.col("width").cast("double") / F.col("height")
    return frames(spark, d).where((F.col("width") > 0) & (F.col("height") > 0)).where(aspect.between(0.45, 4.0) & (F.least("width", "height") >= 480) & F.coalesce("size_bytes", F.lit(0)).between(100_000, 900_000)).select("frame_id", "capture_time_ms")


_GATE = """WITH s AS (SELECT event_id, created_at_ms, CAST(track_id % 40 + 60 AS DOUBLE) AS w, CAST(track_id % 30 + 40 AS DOUBLE) AS h, coalesce(color_confidence, 0) / 20 AS sharp, coalesce(body_type_confidence, 0) AS expo,
    1 - coalesce(crop_quality, 0) AS occ, coalesce(color_samples_used, 0) % 5 = 0 AS cut FROM vehicle_track_results)"""


def _gate_rows(spark, d):
    return tracks(spark, d).select(
        "event_id", "created_at_ms", (F.col("track_id") % 40 + 60).cast("double").alias("w"), (F.col("track_id") % 30 + 40).cast("double").alias("h"), (F.coalesce("color_confidence", F.lit(0.0)) / 20).alias("sharp"),
        F.coalesce("body_type_confidence", F.lit(0.0)).alias("expo"), (1 - F.coalesce("crop_quality", F.lit(0.0))).alias("occ"), (F.coalesce("color_samples_used", F.lit(0)) % 5 == 0).alias("cut"),
    )


@core.add(
    "f16_crop_gate",
    f"""{_GATE} SELECT event_id, created_at_ms, CASE WHEN w IS NULL OR h IS NULL THEN 'invalid_input' WHEN w <= 0 OR h <= 0 THEN 'empty_crop' WHEN w < 64 OR h < 48 THEN 'crop_too_small' WHEN sharp < 0.02 THEN 'crop_too_blurry'
    WHEN expo < 0.1 OR expo > 0.95 THEN 'exposure_out_of_range' WHEN occ > 0.6 THEN 'too_occluded' WHEN cut THEN 'truncated' ELSE 'accepted' END AS reason FROM s""",
)
def f16(spark, d):
    c = F.col
    reason = P.first_reason(
        ("invalid_input", c("w").isNull() | c("h").isNull()), ("empty_crop", (c("w") <= 0) | (c("h") <= 0)), ("crop_too_small", (c("w") < 64) | (c("h") < 48)), ("crop_too_blurry", c("sharp") < 0.02),
        ("exposure_out_of_range", (c("expo") < 0.1) | (c("expo") > 0.95)), ("too_occluded", c("occ") > 0.6), ("truncated", c("cut")),
    )
    return _gate_rows(spark, d).select("event_id", "created_at_ms", reason.alias("reason"))


@core.add(
    "x8_crop_quality",
    f"""{_GATE} SELECT event_id, created_at_ms, round(least(1.0, greatest(0.0, 0.25 * least(least(1.0, w / 64), least(1.0, h / 48)) + 0.25 * least(1.0, sharp / 0.02)
    + 0.20 * least(1.0, greatest(0.0, 1 - abs(expo - 0.5) / 0.5)) + 0.20 * least(1.0, greatest(0.0, 1 - occ)) + 0.10 * CASE WHEN cut THEN 0.0 ELSE 1.0 END)), 6) AS quality FROM s""",
)
def x8(spark, d):
    size = F.least(F.least(F.lit(1.0), F.col("w") / 64), F.least(F.lit(1.0), F.col("h") / 48))
    return _gate_rows(spark, d).select("event_id", "created_at_ms", F.round(X.crop_quality(size, "sharp", "expo", 1 - F.col("occ"), "cut"), 6).alias("quality"))


def _is(c):
    return f"lower(trim(coalesce({c}, ''), ' ')) IN {_TRUE}"


_COMPLEX = f"({_is('night')} OR {_is('blur')} OR {_is('occluded')} OR {_is('truncated')} OR lower(trim(coalesce(crop_quality, ''), ' ')) = 'poor' OR coalesce(try_cast(stage177_mean_luma AS DOUBLE), 255) < 50)"


def _complex():
    luma = F.coalesce(F.col("stage177_mean_luma").try_cast("double"), F.lit(255.0))
    return P.truthy("night") | P.truthy("blur") | P.truthy("occluded") | P.truthy("truncated") | (F.lower(F.trim(F.coalesce("crop_quality", F.lit("")))) == "poor") | (luma < 50)


@core.add("f17_complex_scene", f"SELECT stage177_row_number AS row_number, {_COMPLEX} AS complex FROM attribute_manifest")
def f17(spark, d):
    return manifest(spark, d).select(F.col("stage177_row_number").alias("row_number"), _complex().alias("complex"))


@core.add(
    "f18_hard_tags",
    f"""WITH t AS (SELECT stage177_row_number AS row_number, list_filter([CASE WHEN {_is('night')} THEN 'night' END, CASE WHEN {_is('blur')} THEN 'blur' END, CASE WHEN {_is('occluded')} OR {_is('truncated')} THEN 'partial' END,
    CASE WHEN lower(trim(coalesce(crop_quality, ''), ' ')) = 'poor' THEN 'poor_crop' END], lambda x: x IS NOT NULL) AS t FROM attribute_manifest) SELECT row_number, array_to_string(t, ';') AS hard_tags FROM t WHERE len(t) > 0""",
)
def f18(spark, d):
    t = P.tags(("night", P.truthy("night")), ("blur", P.truthy("blur")), ("partial", P.truthy("occluded") | P.truthy("truncated")), ("poor_crop", F.lower(F.trim(F.coalesce("crop_quality", F.lit("")))) == "poor"))
    return manifest(spark, d).select(F.col("stage177_row_number").alias("row_number"), t.alias("t")).where(F.size("t") > 0).select("row_number", F.array_join("t", ";").alias("hard_tags"))


# ---- projections


@core.add(
    "proj1_strata",
    f"""SELECT stage177_row_number AS row_number, CASE WHEN {_is('truncated')} THEN 'truncated' WHEN {_is('occluded')} THEN 'occluded' WHEN trim(coalesce(truncated, ''), ' ') = '' AND trim(coalesce(occluded, ''), ' ') = '' THEN 'unknown' ELSE 'visible' END AS occlusion,
    CASE WHEN l IS NULL THEN 'unknown' WHEN l < 64 THEN 'dark' WHEN l < 128 THEN 'dim' ELSE 'bright' END AS lighting FROM (SELECT *, try_cast(stage177_mean_luma AS DOUBLE) AS l FROM attribute_manifest)""",
)
def proj1(spark, d):
    luma = F.col("stage177_mean_luma").try_cast("double")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    occlusion = P.first_reason(("truncated", P.truthy("truncated")), ("occluded", P.truthy("occluded")), ("unknown", blank("truncated") & blank("occluded")), otherwise="visible")
    lighting = P.first_reason(("unknown", luma.isNull()), ("dark", luma < 64), ("dim", luma < 128), otherwise="bright")
    return manifest(spark, d).select(F.col("stage177_row_number").alias("row_number"), occlusion.alias("occlusion"), lighting.alias("lighting"))


@core.add("proj1_frame_size", "SELECT frame_id, capture_time_ms, CASE WHEN width IS NULL OR height IS NULL THEN 'unknown' WHEN CAST(width AS BIGINT) * height < 1000000 THEN 'small' WHEN CAST(width AS BIGINT) * height < 2000000 THEN 'medium' ELSE 'large' END AS size FROM camera_frames")
def proj1_size(spark, d):
    area = F.col("width").cast("long") * F.col("height")
    return frames(spark, d).select("frame_id", "capture_time_ms", P.first_reason(("unknown", area.isNull()), ("small", area < 1_000_000), ("medium", area < 2_000_000), otherwise="large").alias("size"))


@core.add(
    "proj2_event_document",
    """WITH e AS (SELECT *, '{"event_id":"' || event_id || '","camera":"' || camera_id || '"' || CASE WHEN vehicle_class IS NULL THEN '' ELSE ',"vehicle_class":"' || vehicle_class || '"' END
    || ',"evidence":{' || CASE WHEN evidence_frame_id IS NULL THEN '' ELSE '"frame_id":"' || evidence_frame_id || '"' END || '}}' AS document FROM vehicle_track_results WHERE event_id IS NOT NULL AND camera_id IS NOT NULL)
    SELECT event_id, created_at_ms, document FROM e""",
)
def proj2(spark, d):
    doc = F.to_json(F.struct("event_id", F.col("camera_id").alias("camera"), "vehicle_class", F.struct(F.col("evidence_frame_id").alias("frame_id")).alias("evidence")))
    return tracks(spark, d).where("event_id is not null and camera_id is not null").select("event_id", "created_at_ms", doc.alias("document"))


@core.add("proj3_namespaced_keys", "SELECT stage177_row_number AS row_number, concat_ws(':', coalesce(nullif(trim(source_dataset, ' '), ''), 'unknown'), coalesce(nullif(lower(trim(split, ' ')), ''), 'none'), coalesce(nullif(trim(track_group, ' '), ''), nullif(trim(video_id, ' '), ''), image_path)) AS key FROM attribute_manifest")
def proj3(spark, d):
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    key = F.concat_ws(":", F.coalesce(some("source_dataset"), F.lit("unknown")), F.coalesce(F.lower(some("split")), F.lit("none")), F.coalesce(some("track_group"), some("video_id"), F.col("image_path")))
    return manifest(spark, d).select(F.col("stage177_row_number").alias("row_number"), key.alias("key"))


_ALIAS = {"grey": "gray", "silver": "silver_gray", "gray": "silver_gray", "light_truck": "truck", "heavy_truck": "truck", "pickup": "truck"}


@core.add(
    "proj4_taxonomy",
    f"""WITH a(old, new) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _ALIAS.items())}), t AS (SELECT color, color_confidence FROM vehicle_track_results WHERE color_confidence IS NOT NULL)
    SELECT coalesce(new, lower(trim(color, ' ')), 'unknown') AS label, count(*) AS n, round(sum(color_confidence), 4) AS mass FROM t LEFT JOIN a ON old = lower(trim(color, ' ')) GROUP BY 1""",
)
def proj4(spark, d):
    alias = spark.createDataFrame(list(_ALIAS.items()), "old string, new string")
    t = tracks(spark, d).where("color_confidence is not null").withColumn("c", F.lower(F.trim("color")))
    return t.join(F.broadcast(alias), F.col("c") == F.col("old"), "left").groupBy(F.coalesce("new", "c", F.lit("unknown")).alias("label")).agg(F.count("*").alias("n"), F.round(F.sum("color_confidence"), 4).alias("mass"))


@core.add("proj5_schema_repair", "SELECT stage177_row_number AS row_number, coalesce(nullif(lower(trim(stage177_scene_label, ' ')), ''), CASE WHEN lower(trim(coalesce(night, ''), ' ')) IN ('1', 'true', 'yes', 'y', 'on') THEN 'night' END, 'unknown') AS scene FROM attribute_manifest")
def proj5(spark, d):
    return manifest(spark, d).select(F.col("stage177_row_number").alias("row_number"), F.coalesce(F.nullif(F.lower(F.trim("stage177_scene_label")), F.lit("")), F.when(P.truthy("night"), "night"), F.lit("unknown")).alias("scene"))


# ---- joins


@core.add("j1_event_status", "WITH o AS (SELECT event_id, max(status) AS status FROM callback_outbox GROUP BY event_id) SELECT v.event_id, v.created_at_ms, coalesce(o.status, 'not_scheduled') AS delivery FROM vision_events v LEFT JOIN o ON o.event_id = v.event_id")
def j1(spark, d):
    o = outbox(spark, d).groupBy("event_id").agg(F.max("status").alias("status"))
    return vision(spark, d).join(o, "event_id", "left").select("event_id", "created_at_ms", F.coalesce("status", F.lit("not_scheduled")).alias("delivery"))


@core.add("j2_outbox_events", "SELECT o.outbox_id, o.event_id, v.event_kind, v.task_id FROM callback_outbox o JOIN vision_events v ON v.event_id = o.event_id WHERE o.status <> 'delivered'")
def j2(spark, d):
    return outbox(spark, d).where("status <> 'delivered'").join(vision(spark, d).select("event_id", "event_kind", "task_id"), "event_id").select("outbox_id", "event_id", "event_kind", "task_id")


@core.add("j3_frames_with_policy", "SELECT f.frame_id, f.capture_time_ms, t.retention_days, t.max_saved_frames FROM camera_frames f JOIN camera_tasks t ON t.task_id = f.task_id WHERE t.deleted_at_ms IS NULL")
def j3(spark, d):
    return frames(spark, d).join(tasks(spark, d).where(P.visible()), "task_id").select("frame_id", "capture_time_ms", "retention_days", "max_saved_frames")


@core.add("j4_scalar_lookup", "SELECT outbox_id, event_id, (SELECT min(task_id) FROM vision_events v WHERE v.event_id = o.event_id) AS task_id FROM callback_outbox o WHERE status = 'dead_letter'")
def j4(spark, d):
    first = vision(spark, d).groupBy("event_id").agg(F.min("task_id").alias("task_id"))
    return outbox(spark, d).where("status = 'dead_letter'").select("outbox_id", "event_id").join(first, "event_id", "left").select("outbox_id", "event_id", "task_id")


@core.add("j5_delete_by_ids", f"SELECT event_id, occurred_at_ms FROM security_alert_events WHERE event_id NOT IN (SELECT event_id FROM security_alert_events WHERE occurred_at_ms <= {NOW} AND event_id IS NOT NULL)")
def j5(spark, d):
    a = alerts(spark, d)
    return a.where("event_id is not null").join(a.where(F.col("occurred_at_ms") <= NOW).select("event_id"), "event_id", "left_anti").select("event_id", "occurred_at_ms")


@core.add(
    "j6_prediction_merge",
    """WITH p AS (SELECT event_id, max(color) AS predicted FROM vehicle_track_results WHERE color_confidence >= 0.6 GROUP BY event_id)
    SELECT v.event_id, v.created_at_ms, predicted, CASE WHEN p.event_id IS NULL THEN 'no_prediction' WHEN predicted = 'unknown' THEN 'abstained' ELSE 'merged' END AS reason FROM vision_events v LEFT JOIN p ON p.event_id = v.event_id""",
)
def j6(spark, d):
    p = tracks(spark, d).where("color_confidence >= 0.6").groupBy("event_id").agg(F.max("color").alias("predicted"), F.lit(1).alias("hit"))
    return vision(spark, d).join(p, "event_id", "left").select("event_id", "created_at_ms", "predicted", P.first_reason(("no_prediction", F.col("hit").isNull()), ("abstained", F.col("predicted") == "unknown"), otherwise="merged").alias("reason"))


@core.add(
    "j7_review_override",
    f"""WITH r AS (SELECT stage177_row_number AS k, coalesce({spell.color('color')}, 'white') AS color, coalesce({spell.key('body_type')}, 'van') AS body FROM attribute_manifest WHERE {spell.key('review_status')} = 'pending')
    SELECT m.stage177_row_number AS row_number, coalesce(r.body, m.body_type) AS body_type, coalesce(r.color, m.color) AS color, CASE WHEN k IS NULL THEN m.review_status ELSE 'approved' END AS review_status, CASE WHEN k IS NULL THEN m.annotation_source ELSE 'human_rereview' END AS annotation_source,
      CASE WHEN k IS NULL THEN m.body_type_supervised ELSE 'true' END AS body_type_supervised, CASE WHEN k IS NULL THEN m.color_supervised ELSE 'true' END AS color_supervised FROM attribute_manifest m LEFT JOIN r ON k = m.stage177_row_number""",
)
def j7(spark, d):
    """Rows whose review is pending get the reviewer's labels (here those they have, with the gaps filled) and the flags of a
    review; a review without a row is an error."""
    m = manifest(spark, d)
    r = m.where(normal.key("review_status") == "pending").select("stage177_row_number", F.coalesce(normal.label("body_type"), F.lit("van")).alias("body_type"), F.coalesce(normal.color("color"), F.lit("white")).alias("color"))
    r = r.select("*", F.lit("approved").alias("review_status"), F.lit("human_rereview").alias("annotation_source"), F.lit("true").alias("body_type_supervised"), F.lit("true").alias("color_supervised"))
    return R.overridden(m, r, "stage177_row_number").select(F.col("stage177_row_number").alias("row_number"), *r.columns[1:])


@core.add(
    "j7_unmatched_reviews",
    "WITH r AS (SELECT stage177_row_number * 3 AS k FROM attribute_manifest WHERE stage177_row_number % 11 = 0) SELECT k FROM r WHERE k NOT IN (SELECT stage177_row_number FROM attribute_manifest)",
)
def j7_unmatched(spark, d):
    m = manifest(spark, d)
    return m.where("stage177_row_number % 11 = 0").select((F.col("stage177_row_number") * 3).alias("k")).join(m.select(F.col("stage177_row_number").alias("k")), "k", "left_anti")


@core.add(
    "j8_semi_anti_pipeline",
    """SELECT f.frame_id, f.capture_time_ms, t.name FROM camera_frames f JOIN camera_tasks t ON t.task_id = f.task_id
    WHERE f.frame_id IN (SELECT evidence_frame_id FROM vision_events) AND f.frame_id NOT IN (SELECT evidence_frame_id FROM security_alert_events WHERE evidence_frame_id IS NOT NULL) AND t.enabled""",
)
def j8(spark, d):
    seen = vision(spark, d).select(F.col("evidence_frame_id").alias("frame_id"))
    out = alerts(spark, d).select(F.col("evidence_frame_id").alias("frame_id"))
    return frames(spark, d).join(seen, "frame_id", "left_semi").join(out, "frame_id", "left_anti").join(tasks(spark, d).where("enabled"), "task_id").select("frame_id", "capture_time_ms", "name")


@core.add(
    "j9_cross_split_anti",
    """SELECT stage177_row_number AS row_number FROM attribute_manifest WHERE lower(trim(split, ' ')) = 'train' AND stage177_pixel_sha256 <> '' AND stage177_pixel_sha256 NOT IN
    (SELECT stage177_pixel_sha256 FROM attribute_manifest WHERE lower(trim(split, ' ')) IN ('validation', 'val', 'test') AND stage177_pixel_sha256 IS NOT NULL)""",
)
def j9(spark, d):
    m = manifest(spark, d).select(F.col("stage177_row_number").alias("row_number"), F.lower(F.trim("split")).alias("s"), "stage177_pixel_sha256")
    held = m.where("s in ('validation', 'val', 'test')").select("stage177_pixel_sha256")
    return m.where("s = 'train' and stage177_pixel_sha256 <> ''").join(held, "stage177_pixel_sha256", "left_anti").select("row_number")


@core.add("j18_duplicate_tracks", "SELECT run_id, track_id, count(*) AS n FROM vehicle_track_results WHERE run_id IS NOT NULL AND track_id IS NOT NULL GROUP BY run_id, track_id HAVING count(*) > 1")
def j18(spark, d):
    return tracks(spark, d).where("run_id is not null and track_id is not null").groupBy("run_id", "track_id").agg(F.count("*").alias("n")).where("n > 1")


@core.add(
    "j19_best_active_command",
    """SELECT task_id, run_id, command_kind, create_time_ms FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY command_kind = 'camera_frame_stop', create_time_ms DESC, run_id DESC, message_id DESC) AS k
    FROM camera_task_commands WHERE task_id IS NOT NULL) WHERE k = 1""",
)
def j19(spark, d):
    c = commands(spark, d).where("task_id is not null")
    return R.first_per(c, ["task_id"], [F.col("command_kind") == "camera_frame_stop", F.desc("create_time_ms"), F.desc("run_id"), F.desc("message_id")]).select("task_id", "run_id", "command_kind", "create_time_ms")


@core.add(
    "j20_count_matched_groups",
    """WITH v AS (SELECT task_id, run_id, count(*) AS n FROM vision_events WHERE task_id IS NOT NULL AND run_id IS NOT NULL AND event_kind = 'algorithm_alert' GROUP BY 1, 2),
    a AS (SELECT task_id, run_id, count(*) AS n, count(DISTINCT event_type) AS kinds, min(event_type) AS kind FROM security_alert_events WHERE task_id IS NOT NULL AND run_id IS NOT NULL GROUP BY 1, 2),
    o AS (SELECT coalesce(v.task_id, a.task_id) AS task_id, coalesce(v.run_id, a.run_id) AS run_id, CASE WHEN v.n IS NULL OR a.n IS NULL THEN 'one_side' WHEN v.n <> a.n THEN 'count_mismatch' WHEN a.kinds <> 1 THEN 'mixed' ELSE 'matched' END AS outcome, kind
    FROM v FULL JOIN a ON a.task_id = v.task_id AND a.run_id = v.run_id) SELECT task_id, run_id, outcome, CASE WHEN outcome = 'matched' THEN kind END AS event_type FROM o""",
)
def j20(spark, d):
    """Groups of both sides meet only if they are equally large; the label is taken only if all of a group agree on it."""
    by = ["task_id", "run_id"]
    v = vision(spark, d).where("event_kind = 'algorithm_alert' and task_id is not null and run_id is not null").groupBy(*by).agg(F.count("*").alias("n_v"))
    a = alerts(spark, d).where("task_id is not null and run_id is not null").groupBy(*by).agg(F.count("*").alias("n_a"), F.count_distinct("event_type").alias("kinds"), F.min("event_type").alias("kind"))
    outcome = P.first_reason(("one_side", F.col("n_v").isNull() | F.col("n_a").isNull()), ("count_mismatch", F.col("n_v") != F.col("n_a")), ("mixed", F.col("kinds") != 1), otherwise="matched")
    return v.join(a, by, "full").select(*by, outcome.alias("outcome"), F.when(outcome == "matched", F.col("kind")).alias("event_type"))


@core.add(
    "j21_positional_lookup",
    """WITH c AS (SELECT message_id, task_id, delivered_at_ms, CAST(regexp_extract(message_id, '-(\\d+)', 1) AS INT) AS i FROM camera_task_commands WHERE regexp_matches(message_id, '-\\d+'))
    SELECT message_id, c.task_id, delivered_at_ms, t.algorithms[i + 1] AS algorithm FROM c JOIN camera_tasks t ON t.task_id = c.task_id""",
)
def j21(spark, d):
    c = commands(spark, d).where(F.col("message_id").rlike(r"-\d+")).select("message_id", "task_id", "delivered_at_ms", F.regexp_extract("message_id", r"-(\d+)", 1).cast("int").alias("i"))
    return c.join(tasks(spark, d).select("task_id", "algorithms"), "task_id").select("message_id", "task_id", "delivered_at_ms", F.get("algorithms", F.col("i")).alias("algorithm"))


# ---- aggregates over the store


_KPI = {
    "camera_tasks": {"tasks": "count(*)", "enabled_tasks": "count(*) FILTER (WHERE deleted_at_ms IS NULL AND enabled)", "deleted_tasks": "count(*) FILTER (WHERE deleted_at_ms IS NOT NULL)"},
    "runs": {"runs": "count(*)", "active_runs": "count(*) FILTER (WHERE NOT stopped)", "failed_runs": "count(*) FILTER (WHERE stopped AND NOT delivered)"},
    "camera_frames": {"frames": "count(*)", "frame_bytes": "CAST(coalesce(sum(size_bytes), 0) AS BIGINT)", "last_frame_ms": "coalesce(max(capture_time_ms), 0)"},
    "security_alert_events": {"alerts": "count(*)"},
    "vision_events": {"events": "count(*)"},
    "vehicle_track_results": {"vehicle_events": "count(*)", "observations": "CAST(coalesce(sum(coalesce(body_type_samples_used, 0) + coalesce(color_samples_used, 0)), 0) AS BIGINT)"},
    "callback_outbox": {s: f"count(*) FILTER (WHERE status = '{s}')" for s in ("pending", "delivering", "delivered", "retry", "dead_letter")},
}
_RUNS = "runs AS (SELECT run_id, bool_or(command_kind = 'camera_frame_stop') AS stopped, bool_and(delivered_at_ms IS NOT NULL) AS delivered FROM camera_task_commands WHERE run_id IS NOT NULL GROUP BY run_id)"


@core.add("a1_kpi_row", f"WITH {_RUNS} SELECT " + ", ".join(f"(SELECT {e} FROM {t}) AS {n}" for t, of in _KPI.items() for n, e in of.items()))
def a1(spark, d):
    """Eighteen counts and sums in one row. Each table is read once; a run is active until a stop, and has failed if a stop
    or another command of it was never delivered."""
    runs = commands(spark, d).where("run_id is not null").groupBy("run_id").agg(F.coalesce(F.bool_or(F.col("command_kind") == "camera_frame_stop"), F.lit(False)).alias("stopped"), F.bool_and(F.col("delivered_at_ms").isNotNull()).alias("delivered"))
    out = None
    for name, of in _KPI.items():
        one = (runs if name == "runs" else table(spark, d, name)).agg(*[F.expr(e).alias(n) for n, e in of.items()])
        out = one if out is None else out.crossJoin(one)  # rows of one
    return out


_STATUSES = ("pending", "delivering", "delivered", "retry", "dead_letter")


@core.add("a2_status_counts", f"SELECT callback_profile, {', '.join(f'count(*) FILTER (status = {chr(39)}{s}{chr(39)}) AS {s}' for s in _STATUSES)} FROM callback_outbox GROUP BY callback_profile")
def a2(spark, d):
    return outbox(spark, d).groupBy("callback_profile").agg(*[F.count_if(F.col("status") == s).alias(s) for s in _STATUSES])


@core.add("a22_recent_rate", "SELECT task_id, count(*) AS n, count(*) FILTER (capture_time_ms > m - 3600000) AS recent, count(*) FILTER (capture_time_ms > m - 3600000) / 3600.0 AS per_second FROM camera_frames, (SELECT max(capture_time_ms) AS m FROM camera_frames) GROUP BY task_id")
def a22(spark, d):
    f = frames(spark, d)
    last = f.agg(F.max("capture_time_ms").alias("m"))
    recent = F.count_if(F.col("capture_time_ms") > F.col("m") - 3_600_000)
    return f.crossJoin(F.broadcast(last)).groupBy("task_id").agg(F.count("*").alias("n"), recent.alias("recent"), (recent / 3600.0).alias("per_second"))  # one row


@core.add(
    "a30_worker_readiness",
    """WITH w AS (SELECT worker_consumer, count(*) AS n, coalesce(bool_and(output_mode = 'latest'), false) AS all_latest, coalesce(bool_or(analysis), false) AS any_analysis, arg_max(run_id, create_time_ms * 1000 + coalesce(definition_version, 0)) AS newest_run,
      max(create_time_ms * 1000 + coalesce(definition_version, 0)) AS since FROM
    (SELECT worker_consumer, output_mode, run_id, create_time_ms, definition_version, len(coalesce(algorithms, [])) > 1 AS analysis FROM camera_task_commands WHERE create_time_ms IS NOT NULL AND run_id IS NOT NULL) GROUP BY worker_consumer)
    SELECT worker_consumer, n, all_latest, any_analysis, newest_run, (SELECT arg_max(newest_run, since) FROM w WHERE all_latest OR any_analysis) AS newest_runtime, (SELECT count(*) FROM w) AS workers, (SELECT count(*) FROM w) = 1 AND all_latest AND any_analysis AS ready FROM w""",
)
def a30(spark, d):
    """What each worker reports, the newest run among healthy ones, and whether it is ready: only if it is the one worker."""
    c = commands(spark, d).where("create_time_ms is not null and run_id is not null")
    at = F.col("create_time_ms") * 1000 + F.coalesce("definition_version", F.lit(0))
    w = c.groupBy("worker_consumer").agg(
        F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("output_mode") == "latest"), F.lit(False)).alias("all_latest"),
        F.coalesce(F.bool_or(F.coalesce(F.size("algorithms"), F.lit(0)) > 1), F.lit(False)).alias("any_analysis"), F.max_by("run_id", at).alias("newest_run"), F.max(at).alias("at"),
    )
    healthy = F.when(F.col("all_latest") | F.col("any_analysis"), F.col("at"))
    whole = w.agg(F.max_by("newest_run", healthy).alias("newest_runtime"), F.count("*").alias("workers"))  # one row
    ready = (F.col("workers") == 1) & F.col("all_latest") & F.col("any_analysis")
    return w.crossJoin(F.broadcast(whole)).select("worker_consumer", "n", "all_latest", "any_analysis", "newest_run", "newest_runtime", "workers", ready.alias("ready"))


# ---- windows and paging


@core.add(
    "w1_retention_candidates",
    f"""SELECT frame_id, task_id, capture_time_ms, position FROM (SELECT f.frame_id, f.task_id, f.capture_time_ms, t.retention_days, t.max_saved_frames, row_number() OVER (PARTITION BY f.task_id ORDER BY f.capture_time_ms DESC, f.save_time_ms DESC, f.frame_id DESC) AS position
    FROM camera_frames f JOIN camera_tasks t ON t.task_id = f.task_id) WHERE capture_time_ms < {NOW} - CAST(retention_days AS BIGINT) * 86400000 OR position > max_saved_frames""",
)
def w1(spark, d):
    policies = tasks(spark, d).select("task_id", "retention_days", "max_saved_frames")
    return R.retention_candidates(frames(spark, d), policies, F.lit(NOW)).select("frame_id", "task_id", "capture_time_ms", "position")


@core.add("w2_latest_frame", "SELECT task_id, frame_id, capture_time_ms FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY capture_time_ms DESC, save_time_ms DESC, frame_id DESC) AS k FROM camera_frames) WHERE k = 1")
def w2(spark, d):
    return R.first_per(frames(spark, d), ["task_id"], [F.desc("capture_time_ms"), F.desc("save_time_ms"), F.desc("frame_id")]).select("task_id", "frame_id", "capture_time_ms")


@core.add(
    "w7_sequence_gaps",
    "SELECT run_id, source_sequence, greatest(0, coalesce(source_sequence - lag(source_sequence) OVER (PARTITION BY run_id ORDER BY source_sequence) - 1, 0)) AS gap FROM (SELECT DISTINCT run_id, source_sequence FROM camera_frames WHERE source_sequence IS NOT NULL)",
)
def w7(spark, d):
    w = Window.partitionBy("run_id").orderBy("source_sequence")
    s = frames(spark, d).where("source_sequence is not null").select("run_id", "source_sequence").distinct()
    return s.withColumn("gap", F.greatest(F.lit(0), F.coalesce(F.col("source_sequence") - F.lag("source_sequence").over(w) - 1, F.lit(0))))


@core.add("t1_page", "SELECT event_id, occurred_at_ms, created_at_ms FROM security_alert_events ORDER BY occurred_at_ms DESC, event_id DESC, created_at_ms DESC LIMIT 50 OFFSET 100")
def t1(spark, d):
    return R.page(alerts(spark, d), [F.desc("occurred_at_ms"), F.desc("event_id"), F.desc("created_at_ms")], 50, 100).select("event_id", "occurred_at_ms", "created_at_ms")


@core.add("t2_page_with_tiebreak", "SELECT task_id, updated_at_ms FROM camera_tasks WHERE deleted_at_ms IS NULL ORDER BY updated_at_ms DESC, task_id LIMIT 20")
def t2(spark, d):
    return R.page(tasks(spark, d).where(P.visible()), [F.desc("updated_at_ms"), F.col("task_id")], 20).select("task_id", "updated_at_ms")


@core.add("t3_filter_then_page", "SELECT task_id, updated_at_ms FROM camera_tasks WHERE enabled AND analysis_enabled ORDER BY updated_at_ms DESC, task_id LIMIT 10 OFFSET 5")
def t3(spark, d):
    return R.page(tasks(spark, d).where("enabled and analysis_enabled"), [F.desc("updated_at_ms"), F.col("task_id")], 10, 5).select("task_id", "updated_at_ms")


@core.add("t4_oldest_frames", "SELECT frame_id, capture_time_ms, save_time_ms FROM camera_frames ORDER BY capture_time_ms, save_time_ms, frame_id LIMIT 500")
def t4(spark, d):
    return R.page(frames(spark, d), [F.asc("capture_time_ms"), F.asc("save_time_ms"), F.asc("frame_id")], 500).select("frame_id", "capture_time_ms", "save_time_ms")


@core.add("t5_top_observations", "SELECT camera_id, event_id, q FROM (SELECT camera_id, event_id, coalesce(crop_quality, 0) AS q, row_number() OVER (PARTITION BY camera_id ORDER BY coalesce(crop_quality, 0) DESC, created_at_ms DESC, event_id DESC) AS k FROM vehicle_track_results) WHERE k <= 5")
def t5(spark, d):
    t = tracks(spark, d).withColumn("q", F.coalesce("crop_quality", F.lit(0.0)))
    return R.first_per(t, ["camera_id"], [F.desc("q"), F.desc("created_at_ms"), F.desc("event_id")], 5).select("camera_id", "event_id", "q")


@core.add("t6_priority_batch", "SELECT event_id, coalesce(crop_quality, 0) AS q, created_at_ms FROM vehicle_track_results ORDER BY q DESC, created_at_ms, event_id LIMIT 16")
def t6(spark, d):
    return tracks(spark, d).select("event_id", F.coalesce("crop_quality", F.lit(0.0)).alias("q"), "created_at_ms").orderBy(F.desc("q"), "created_at_ms", "event_id").limit(16)


# ---- mutations

_NEW = "new AS (SELECT task_id, name || ' (moved)' AS name, version + 1 AS version FROM camera_tasks WHERE version % 2 = 0 UNION ALL SELECT 'new_' || task_id, name, 1 FROM camera_tasks WHERE version % 3 = 0)"


def _new_tasks(spark, d):
    t = tasks(spark, d)
    return t.where("version % 2 = 0").select("task_id", F.concat("name", F.lit(" (moved)")).alias("name"), (F.col("version") + 1).alias("version")).union(t.where("version % 3 = 0").select(F.concat(F.lit("new_"), "task_id"), "name", F.lit(1)))


@core.add("u9_upsert", f"WITH {_NEW} SELECT task_id, name, version FROM new UNION ALL SELECT task_id, name, version FROM camera_tasks WHERE task_id NOT IN (SELECT task_id FROM new)")
def u9(spark, d):
    return R.upsert(tasks(spark, d).select("task_id", "name", "version"), _new_tasks(spark, d), ["task_id"], [F.desc("version")])


@core.add("u10_insert_ignore", f"WITH {_NEW} SELECT task_id, name, version FROM new WHERE task_id NOT IN (SELECT task_id FROM camera_tasks)")
def u10(spark, d):
    return R.insert_ignore(tasks(spark, d).select("task_id"), _new_tasks(spark, d), ["task_id"], [F.desc("version")]).select("task_id", "name", "version")


@core.add(
    "u11_compare_and_set",
    """WITH c AS (SELECT CASE WHEN version % 5 = 0 THEN 'gone_' || task_id ELSE task_id END AS task_id, version - version % 2 AS expected_version FROM camera_tasks)
    SELECT c.task_id, CASE WHEN t.task_id IS NULL THEN 'not_found' WHEN t.version = expected_version THEN 'updated' ELSE 'conflict' END AS outcome, CASE WHEN t.version = expected_version THEN t.version + 1 ELSE t.version END AS version
    FROM c LEFT JOIN camera_tasks t ON t.task_id = c.task_id""",
)
def u11(spark, d):
    t = tasks(spark, d)
    c = t.select(F.when(F.col("version") % 5 == 0, F.concat(F.lit("gone_"), "task_id")).otherwise(F.col("task_id")).alias("task_id"), (F.col("version") - F.col("version") % 2).alias("expected_version"))
    return R.compare_and_set(t, c, "task_id", "version", [])


@core.add("u12_mapped_state", "WITH m(a, b) AS (VALUES ('pending', 'delivering'), ('retry', 'delivering')) SELECT outbox_id, event_id, status, coalesce(b, status) AS next_status FROM callback_outbox LEFT JOIN m ON a = status")
def u12(spark, d):
    m = spark.createDataFrame([("pending", "delivering"), ("retry", "delivering")], "from_state string, to_state string")
    return R.moved(outbox(spark, d).select("outbox_id", "event_id", "status"), m, "outbox_id", "status")


@core.add("u13_stale_recovery", f"SELECT outbox_id, event_id, CASE WHEN status = 'delivering' AND updated_at_ms < {NOW} THEN 'retry' ELSE status END AS status FROM callback_outbox")
def u13(spark, d):
    return outbox(spark, d).select("outbox_id", "event_id", F.when((F.col("status") == "delivering") & (F.col("updated_at_ms") < NOW), "retry").otherwise(F.col("status")).alias("status"))


@core.add("u14_ttl_delete", f"SELECT frame_id, save_time_ms FROM camera_frames WHERE frame_id NOT IN (SELECT frame_id FROM camera_frames WHERE save_time_ms <= {NOW} ORDER BY save_time_ms, frame_id LIMIT 1000)")
def u14(spark, d):
    f = frames(spark, d).select("frame_id", "save_time_ms")
    return R.split_expired(f, ["frame_id"], "save_time_ms", F.lit(NOW), 1000, [F.col("save_time_ms"), F.col("frame_id")])[1]


@core.add(
    "u15_backfill",
    """SELECT event_id, 'algorithm_alert' AS event_kind, task_id, '{"category":"' || category || '","severity":' || severity || ',"level":"' || CASE WHEN severity >= 4 THEN 'high' ELSE 'low' END || '"}' AS payload, created_at_ms
    FROM security_alert_events WHERE category IS NOT NULL AND severity IS NOT NULL""",
)
def u15(spark, d):
    payload = F.to_json(F.struct("category", "severity", F.when(F.col("severity") >= 4, "high").otherwise("low").alias("level")))
    return alerts(spark, d).where("category is not null and severity is not null").select("event_id", F.lit("algorithm_alert").alias("event_kind"), "task_id", payload.alias("payload"), "created_at_ms")


# ---- queues and storage


@core.add("r15_due_messages", f"SELECT outbox_id, event_id, next_attempt_at_ms, created_at_ms FROM callback_outbox WHERE (status IN ('pending', 'retry') AND next_attempt_at_ms <= {NOW}) OR (status = 'delivering' AND last_attempt_at_ms <= {NOW} - 60000)")
def r15(spark, d):
    due = (F.col("status").isin("pending", "retry") & (F.col("next_attempt_at_ms") <= NOW)) | ((F.col("status") == "delivering") & (F.col("last_attempt_at_ms") <= NOW - 60_000))
    return outbox(spark, d).where(due).select("outbox_id", "event_id", "next_attempt_at_ms", "created_at_ms")


@core.add(
    "r16_delivery_outcome",
    """SELECT outbox_id, event_id, attempt, created_at_ms, CASE WHEN last_http_status BETWEEN 200 AND 299 THEN 'delivered' WHEN last_http_status IS NULL OR last_http_status IN (408, 429) OR last_http_status >= 500 THEN CASE WHEN attempt >= 8 THEN 'dead_letter' ELSE 'retry' END ELSE 'dead_letter' END AS outcome,
    least(300000, 1000 * CAST(pow(2, greatest(1, attempt) - 1) AS BIGINT)) AS delay_ms FROM callback_outbox WHERE attempt IS NOT NULL""",
)
def r16(spark, d):
    s = F.col("last_http_status")
    again = s.isNull() | s.isin(408, 429) | (s >= 500)
    outcome = F.when(s.between(200, 299), "delivered").when(again & (F.col("attempt") < 8), "retry").otherwise("dead_letter")
    return outbox(spark, d).where("attempt is not null").select("outbox_id", "event_id", "attempt", "created_at_ms", outcome.alias("outcome"), X.backoff("attempt", 1000, 300_000).alias("delay_ms"))


@core.add("r17_fenced_completion", "SELECT outbox_id, event_id, created_at_ms, CASE WHEN status = 'delivering' AND attempt = 1 + outbox_id % 3 THEN 'delivered' ELSE status END AS status FROM callback_outbox")
def r17(spark, d):
    held = (F.col("status") == "delivering") & (F.col("attempt") == 1 + F.col("outbox_id") % 3)
    return outbox(spark, d).select("outbox_id", "event_id", "created_at_ms", F.when(held, "delivered").otherwise(F.col("status")).alias("status"))


@core.add("r18_replay", f"SELECT outbox_id, event_id, created_at_ms, CASE WHEN status = 'dead_letter' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'dead_letter' THEN 0 ELSE attempt END AS attempt, CASE WHEN status = 'dead_letter' THEN {NOW} ELSE next_attempt_at_ms END AS next_attempt_at_ms FROM callback_outbox")
def r18(spark, d):
    dead = F.col("status") == "dead_letter"
    return outbox(spark, d).select("outbox_id", "event_id", "created_at_ms", F.when(dead, "pending").otherwise(F.col("status")).alias("status"), F.when(dead, 0).otherwise(F.col("attempt")).alias("attempt"), F.when(dead, F.lit(NOW)).otherwise(F.col("next_attempt_at_ms")).alias("next_attempt_at_ms"))


@core.add("r20_live_status", f"SELECT task_id, max(capture_time_ms) AS last_ms FROM camera_frames GROUP BY task_id HAVING {NOW} - max(capture_time_ms) <= {20 * DAY}")
def r20(spark, d):
    return frames(spark, d).groupBy("task_id").agg(F.max("capture_time_ms").alias("last_ms")).where(F.lit(NOW) - F.col("last_ms") <= 20 * DAY)


@core.add(
    "r21_pressure_sweep",
    """WITH f AS (SELECT DISTINCT frame_id, task_id, capture_time_ms, save_time_ms, size_bytes FROM camera_frames), s AS (SELECT *, coalesce(sum(coalesce(size_bytes, 0)) OVER (PARTITION BY task_id ORDER BY capture_time_ms, save_time_ms, frame_id, size_bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(coalesce(size_bytes, 0)) OVER (PARTITION BY task_id) AS t FROM f)
    SELECT task_id, count(*) AS n_deleted FROM s WHERE b < t - 20000000 GROUP BY task_id""",
)
def r21(spark, d):
    f = frames(spark, d).select("frame_id", "task_id", "capture_time_ms", "save_time_ms", "size_bytes").distinct()
    return R.pressure_sweep(f, F.lit(20_000_000)).groupBy("task_id").agg(F.count("*").alias("n_deleted"))


@core.add("r22_pressure_class", "SELECT task_id, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes, CASE WHEN coalesce(sum(size_bytes), 0) >= 90000000 THEN 'critical' WHEN coalesce(sum(size_bytes), 0) >= 40000000 THEN 'high' ELSE 'normal' END AS pressure FROM camera_frames GROUP BY task_id")
def r22(spark, d):
    b = F.col("bytes")
    return frames(spark, d).groupBy("task_id").agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")).withColumn("pressure", F.when(b >= 90_000_000, "critical").when(b >= 40_000_000, "high").otherwise("normal"))


@core.add("r23_event_identifier", "SELECT event_id, created_at_ms, 've_' || substr(sha256(camera_id || chr(10) || run_id || chr(10) || '1' || chr(10) || track_id), 1, 40) AS derived FROM vehicle_track_results WHERE camera_id IS NOT NULL AND run_id IS NOT NULL AND track_id IS NOT NULL")
def r23(spark, d):
    return tracks(spark, d).where("camera_id is not null and run_id is not null and track_id is not null").select("event_id", "created_at_ms", X.event_identifier("ve_", "camera_id", "run_id", F.lit(1), "track_id").alias("derived"))


_MOST_RUNS = 64


@core.add(
    "r25_recovery_plan",
    f"""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY create_time_ms DESC, run_id DESC, message_id DESC) AS k FROM camera_task_commands WHERE task_id IS NOT NULL) WHERE k = 1),
    wanted AS (SELECT * FROM camera_tasks WHERE enabled AND deleted_at_ms IS NULL AND desired_state = 'running'), plan AS (SELECT t.task_id, 'fail_run' AS action, l.run_id, 'worker_restart_recovery' AS reason FROM camera_tasks t JOIN l ON l.task_id = t.task_id WHERE l.command_kind = 'camera_frame_start'
    UNION ALL SELECT t.task_id, 'start_run', l.run_id, 'desired_running' FROM wanted t LEFT JOIN l ON l.task_id = t.task_id)
    SELECT * FROM plan WHERE (SELECT count(*) FROM wanted) <= {_MOST_RUNS} UNION ALL SELECT NULL, 'refuse', NULL, 'capacity_exceeded' WHERE (SELECT count(*) FROM wanted) > {_MOST_RUNS}""",
)
def r25(spark, d):
    return recovery_plan(tasks(spark, d), commands(spark, d), _MOST_RUNS)


def recovery_plan(tasks, commands, most: int):
    """task_id, action, run_id, reason: the newest run of a task fails if it has not ended, tasks that should run start anew;
    if more should run than there is room for, nothing is done but to refuse."""
    last = R.first_per(commands.where("task_id is not null"), ["task_id"], [F.desc("create_time_ms"), F.desc("run_id"), F.desc("message_id")]).select("task_id", "run_id", "command_kind")
    t = tasks.select("task_id", "enabled", "deleted_at_ms", "desired_state").join(last, "task_id", "left")
    wanted = "enabled and deleted_at_ms is null and desired_state = 'running'"
    said = lambda df, action, reason: df.select("task_id", F.lit(action).alias("action"), "run_id", F.lit(reason).alias("reason"))
    plan = said(t.where("command_kind = 'camera_frame_start'"), "fail_run", "worker_restart_recovery").union(said(t.where(wanted), "start_run", "desired_running"))
    room = tasks.where(wanted).agg((F.count("*") <= most).alias("room"))  # one row
    refused = room.where("not room").select(F.lit(None).cast("string").alias("task_id"), F.lit("refuse").alias("action"), F.lit(None).cast("string").alias("run_id"), F.lit("capacity_exceeded").alias("reason"))
    return plan.crossJoin(F.broadcast(room)).where("room").drop("room").union(refused)


@core.add(
    "r26_archive_admission",
    """WITH f AS (SELECT DISTINCT frame_id, task_id, save_time_ms, size_bytes FROM camera_frames), s AS (SELECT frame_id, task_id, save_time_ms, size_bytes, coalesce(sum(coalesce(size_bytes, 0)) OVER (PARTITION BY task_id ORDER BY save_time_ms, frame_id, size_bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM f)
    SELECT frame_id, save_time_ms, size_bytes, used + coalesce(size_bytes, 0) <= 50000000 AS admitted FROM s""",
)
def r26(spark, d):
    f = frames(spark, d).select("frame_id", "task_id", "save_time_ms", "size_bytes").distinct()
    used = R.sums_before(f, ["task_id"], "save_time_ms", [F.col(c) for c in ("save_time_ms", "frame_id", "size_bytes")], F.coalesce("size_bytes", F.lit(0)))
    return used.select("frame_id", "save_time_ms", "size_bytes", (F.col("_before") + F.coalesce("size_bytes", F.lit(0)) <= 50_000_000).alias("admitted"))


# ---- shards and parameters


@core.add(
    "r13_shard_assignment",
    """WITH t AS (SELECT task_id, row_number() OVER (ORDER BY created_at_ms, task_id) - 1 AS i FROM camera_tasks), held AS (SELECT task_id, CAST(i % 3 AS INT) AS shard FROM t WHERE i < 20), fresh AS (SELECT task_id, row_number() OVER (ORDER BY i) AS k FROM t WHERE i >= 20),
    loads AS (SELECT s AS shard, count(task_id) AS load FROM (SELECT CAST(unnest(generate_series(0, 3)) AS INT) AS s) LEFT JOIN held ON held.shard = s GROUP BY 1),
    slots AS (SELECT shard, row_number() OVER (ORDER BY level, shard) AS k FROM loads, (SELECT unnest(generate_series(0, 100)) AS level) WHERE level >= load)
    SELECT task_id, shard, true AS held FROM held UNION ALL SELECT task_id, shard, false FROM fresh JOIN slots USING (k)""",
)
def r13(spark, d):
    """Shards of tasks: what is assigned stays; each new task goes to the least loaded shard, in turn among equals."""
    t = tasks(spark, d).select("task_id", (F.row_number().over(Window.orderBy("created_at_ms", "task_id")) - 1).alias("i"))  # a fixed table
    held = t.where("i < 20").select("task_id", (F.col("i") % 3).cast("int").alias("shard"))
    return R.sticky_shards(t.select("task_id", "i"), held, 4, "task_id", "i")


_CLAMPS = {"retention_days": (1, 365), "max_saved_frames": (1, 10_000), "jpeg_quality": (1, 100), "frame_interval_ms": (40, 3_600_000)}


@core.add("x22_clamped_parameters", "SELECT task_id, " + ", ".join(f"least({hi}, greatest({lo}, coalesce({c}, {lo}))) AS {c}" for c, (lo, hi) in _CLAMPS.items()) + " FROM camera_tasks")
def x22(spark, d):
    """Parameters brought into their bounds; a missing one is the least allowed."""
    return tasks(spark, d).select("task_id", *[F.least(F.lit(hi), F.greatest(F.lit(lo), F.coalesce(c, F.lit(lo)))).alias(c) for c, (lo, hi) in _CLAMPS.items()])
