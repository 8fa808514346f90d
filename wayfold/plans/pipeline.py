"""Queries over the event tables: repeated deliveries, orphan references, late events."""

from __future__ import annotations

from ..operators import deliveries, lateness, orphans
from ..sources.tables import table
from . import spell
from .registry import core


def _repeated(name: str, column: str) -> str:
    return f"SELECT '{name}' AS table_name, {spell.key(column)} AS message_key FROM {name} WHERE {spell.key(column)} IS NOT NULL GROUP BY 2 HAVING count(*) > 1"


@core.add("p3_found", f"{_repeated('callback_outbox', 'event_id')} UNION ALL {_repeated('camera_task_commands', 'message_id')}")
def p3_found(spark, d):
    return deliveries.repeated({
        "callback_outbox": (table(spark, d, "callback_outbox"), deliveries.OUTBOX),
        "camera_task_commands": (table(spark, d, "camera_task_commands"), deliveries.COMMANDS),
    })


def _kept(name: str, identifier: str, order: tuple[str, ...]) -> str:
    key = spell.key(identifier)
    ranked = ", ".join(f"{c} DESC NULLS LAST" for c in order)
    return f"""SELECT message_key, n_copies, {', '.join(order)} FROM (SELECT {key} AS message_key, count(*) OVER (PARTITION BY {key}) AS n_copies, {', '.join(order)},
        row_number() OVER (PARTITION BY {key} ORDER BY {ranked}) AS k FROM {name} WHERE {key} IS NOT NULL) WHERE k = 1
        UNION ALL SELECT NULL, 1, {', '.join(order)} FROM {name} WHERE {key} IS NULL"""


@core.add("p3_outbox_once", _kept("callback_outbox", *deliveries.OUTBOX))
def p3_outbox_once(spark, d):
    return deliveries.kept_once(table(spark, d, "callback_outbox"), *deliveries.OUTBOX)


@core.add("p3_commands_once", _kept("camera_task_commands", *deliveries.COMMANDS))
def p3_commands_once(spark, d):
    return deliveries.kept_once(table(spark, d, "camera_task_commands"), *deliveries.COMMANDS)


@core.add("p3_outbox_messages", _kept("callback_outbox", deliveries.OUTBOX[0], deliveries.OUTBOX[1] + deliveries.OUTBOX_REST))
def p3_outbox_messages(spark, d):
    return deliveries.kept_once(table(spark, d, "callback_outbox"), *deliveries.OUTBOX, deliveries.OUTBOX_REST)


@core.add("p3_commands_messages", _kept("camera_task_commands", deliveries.COMMANDS[0], deliveries.COMMANDS[1] + deliveries.COMMANDS_REST))
def p3_commands_messages(spark, d):
    return deliveries.kept_once(table(spark, d, "camera_task_commands"), *deliveries.COMMANDS, deliveries.COMMANDS_REST)


_REFS = f"""refs AS (SELECT 'vision_events' AS t, 'f' AS g, {spell.key('evidence_frame_id')} AS k, {spell.key('event_id')} AS e, created_at_ms AS c FROM vision_events
    UNION ALL SELECT 'security_alert_events', 'f', {spell.key('evidence_frame_id')}, {spell.key('event_id')}, created_at_ms FROM security_alert_events
    UNION ALL SELECT 'vehicle_track_results', 'v', {spell.key('event_id')}, {spell.key('event_id')}, created_at_ms FROM vehicle_track_results),
  held AS (SELECT 'f' AS g, {spell.key('frame_id')} AS k, min(save_time_ms) AS a FROM camera_frames GROUP BY 1, 2
    UNION ALL SELECT 'v', {spell.key('event_id')}, min(created_at_ms) FROM vision_events GROUP BY 1, 2)"""


def _tables(spark, d):
    frames, vision, alerts, tracks = (table(spark, d, n) for n in ("camera_frames", "vision_events", "security_alert_events", "vehicle_track_results"))
    return orphans.observation_references(vision, alerts, tracks), orphans.observation_targets(frames, vision)


@core.add("p6_found", f"WITH {_REFS} SELECT DISTINCT t AS table_name, e AS event_id FROM refs WHERE k IS NOT NULL AND e IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held WHERE held.g = refs.g AND held.k = refs.k)")
def p6_found(spark, d):
    return orphans.orphan_events(*_tables(spark, d))


@core.add(
    "p6_orphan_report",
    f"""WITH {_REFS} SELECT t AS table_name, c - c % 86400000 AS period_ms, count(*) AS n_references, count(*) FILTER (held.k IS NULL) AS n_orphans, count(*) FILTER (c < a) AS n_early
    FROM refs LEFT JOIN held ON held.g = refs.g AND held.k = refs.k WHERE refs.k IS NOT NULL GROUP BY 1, 2""",
)
def p6_orphan_report(spark, d):
    return orphans.orphan_report(*_tables(spark, d))


_EVENTS = f"""copies AS (SELECT 'vision_events' AS t, {spell.key('event_id')} AS e, {spell.key('event_kind')} AS k, {spell.epoch_ms('occurred_at_ms')} AS o, created_at_ms AS c FROM vision_events
    UNION ALL SELECT 'vehicle_track_results', {spell.key('event_id')}, 'vehicle_passage', {spell.epoch_ms('last_seen_at_ms')}, created_at_ms FROM vehicle_track_results),
  firsts AS (SELECT t, e, arg_min(k, c) FILTER (k IS NOT NULL) AS k, arg_min(o, c) FILTER (o IS NOT NULL) AS o, min(c) AS a FROM copies WHERE e IS NOT NULL GROUP BY t, e
    UNION ALL SELECT t, e, k, o, c FROM copies WHERE e IS NULL),
  timed AS (SELECT t, e, k, o, a, o - o % 3600000 AS h, allowed_lateness_ms AS l, a > o - o % 3600000 + 3600000 + coalesce(allowed_lateness_ms, 0) AS late
    FROM firsts LEFT JOIN lateness_limits ON {spell.key('event_kind')} = k WHERE o IS NOT NULL AND a IS NOT NULL)"""


def _events(spark, d):
    return (table(spark, d, n) for n in ("vision_events", "vehicle_track_results", "lateness_limits"))


@core.add("p7_found", f"WITH {_EVENTS} SELECT t AS table_name, e AS event_id FROM timed WHERE late AND l IS NOT NULL AND e IS NOT NULL")
def p7_found(spark, d):
    return lateness.late_events(*_events(spark, d))


@core.add(
    "p7_hourly",
    f"""WITH {_EVENTS} SELECT t AS table_name, k AS kind, h AS period_ms, count(*) FILTER (NOT late) AS n_events,
    CAST(coalesce(sum(greatest(0, a - o)) FILTER (NOT late), 0) AS BIGINT) AS sum_delay_ms, count(*) FILTER (late) AS n_too_late FROM timed GROUP BY 1, 2, 3""",
)
def p7_hourly(spark, d):
    return lateness.hourly(*_events(spark, d))


_PARTS = f"""{_EVENTS}, parts AS (SELECT t, k, h, CASE WHEN a <= h + 3600000 THEN 0 ELSE (a - h - 3600000 - 1) // 300000 + 1 END AS p, count(*) AS n, CAST(sum(greatest(0, a - o)) AS BIGINT) AS s
    FROM timed WHERE NOT late GROUP BY 1, 2, 3, 4),
  state AS (SELECT t, k, h, p, n, s, CAST(sum(n) OVER w AS BIGINT) AS n_now, CAST(sum(s) OVER w AS BIGINT) AS s_now, row_number() OVER w - 1 AS v FROM parts WINDOW w AS (PARTITION BY t, k, h ORDER BY p ROWS UNBOUNDED PRECEDING))"""


@core.add(
    "p7_deltas",
    f"""WITH {_PARTS} SELECT t AS table_name, k AS kind, h AS hour_ms, v AS version, 1 AS sign, n_now AS n_events, s_now AS sum_delay_ms FROM state
    UNION ALL SELECT t, k, h, v, -1, n_now - n, s_now - s FROM state WHERE v > 0""",
)
def p7_deltas(spark, d):
    vision, tracks, limits = _events(spark, d)
    return lateness.deltas(lateness.admitted(lateness.arrivals(vision, tracks), limits))


@core.add("p7_daily", f"WITH {_EVENTS} SELECT t AS table_name, k AS kind, h - h % 86400000 AS period_ms, count(*) AS n_events, CAST(sum(greatest(0, a - o)) AS BIGINT) AS sum_delay_ms FROM timed WHERE NOT late GROUP BY 1, 2, 3")
def p7_daily(spark, d):
    vision, tracks, limits = _events(spark, d)
    return lateness.folded(lateness.deltas(lateness.admitted(lateness.arrivals(vision, tracks), limits)), 86_400_000)
