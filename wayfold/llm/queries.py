"""The queries of this package and, where SQL can say it, the SQL that states their results."""

from __future__ import annotations

from ..plans import spell
from ..plans.registry import Registry
from ..sources.tables import table

llm = Registry()

_ROWS = f"""rows AS (SELECT stage177_row_number AS r, {spell.split_name('split')} AS s, {spell.digest('stage177_pixel_sha256')} AS p,
    {spell.bits64('stage177_dhash64')} AS h, coalesce({spell.key('source_dataset')}, 'unknown') AS d FROM attribute_manifest)"""
# Blocks of 13 bits (the last has 12) from the lowest bit on; a match is a run of equal blocks, the last being followed by the first.
_EQUAL = [f"CAST((xor(t.h, e.h) >> {at}) & {(1 << w) - 1} = 0 AS INT)" for at, w in ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))]
_RUNS = f"greatest({' + '.join(f'{a} * (1 - {b})' for a, b in zip(_EQUAL, _EQUAL[1:] + _EQUAL[:1], strict=True))}, CAST(xor(t.h, e.h) = 0 AS INT))"
_SPAN = " + ".join(f"{w} * {e}" for e, w in zip(_EQUAL, (13, 13, 13, 13, 12), strict=True))
_PAIRS = f"""pairs AS (SELECT t.r AS t, e.r AS e, coalesce(t.p = e.p, false) AS same, coalesce(bit_count(xor(t.h, e.h)) <= 4, false) AS near, {_RUNS} AS runs, {_SPAN} AS span
    FROM rows t JOIN rows e ON t.s = 'train' AND e.s IN ('validation', 'test') AND (t.p = e.p OR bit_count(xor(t.h, e.h)) <= 4))"""


@llm.add("p1_found", f"WITH {_ROWS}, {_PAIRS} SELECT DISTINCT least(t, e) AS row_a, greatest(t, e) AS row_b FROM pairs")
def p1_found(spark, d):
    from . import overlap

    return overlap.row_pairs(table(spark, d, "attribute_manifest"))


@llm.add(
    "p1_overlap_report",
    f"""WITH {_ROWS}, {_PAIRS}, per AS (SELECT e, count(*) FILTER (same) AS same, count(*) FILTER (near) AS near, sum(runs) FILTER (near) AS runs, sum(span) FILTER (near) AS span FROM pairs GROUP BY e)
    SELECT s AS split, d AS source_dataset, count(*) AS n_rows, count(*) FILTER (same > 0) AS n_same_rows, count(*) FILTER (near > 0) AS n_near_rows,
      count(*) FILTER (same > 0 OR near > 0) AS n_overlap_rows, CAST(coalesce(sum(same), 0) AS BIGINT) AS n_same_pairs, CAST(coalesce(sum(near), 0) AS BIGINT) AS n_near_pairs,
      CAST(coalesce(sum(runs), 0) AS BIGINT) AS n_near_spans, CAST(coalesce(sum(span), 0) AS BIGINT) AS near_span_bits
    FROM rows LEFT JOIN per ON r = e WHERE s IN ('validation', 'test') GROUP BY s, d""",
)
def p1_overlap_report(spark, d):
    from . import overlap

    return overlap.overlap_report(table(spark, d, "attribute_manifest"))


_FIELDS = "['body_type', 'color', 'crop_quality', 'viewpoint']"
_VALUES = f"[{spell.key('body_type')}, {spell.color('color')}, {spell.key('crop_quality')}, {spell.key('viewpoint')}]"


@llm.add(
    "p2_found",
    f"""WITH long AS (SELECT stage177_row_number AS r, {spell.digest('stage177_pixel_sha256')} AS p, {spell.key('annotation_source')} AS s, reviewed_at_ms AS t,
        unnest({_FIELDS}) AS f, unnest({_VALUES}) AS v FROM attribute_manifest),
    known AS (SELECT long.*, coalesce(k.trust_rank, 0) AS q FROM long LEFT JOIN annotation_trust k ON {spell.key('k.annotation_source')} = s WHERE v IS NOT NULL AND p IS NOT NULL),
    facts AS (SELECT p, f, count(DISTINCT v) AS n, max(t) AS latest, max(q) AS top FROM known GROUP BY p, f),
    best AS (SELECT p, f, r, q, top, count(*) OVER (PARTITION BY p, f) AS n_latest FROM known JOIN facts USING (p, f) WHERE n > 1 AND t = latest)
    SELECT r AS stage177_row_number, f AS field_name FROM best WHERE n_latest = 1 AND q = top""",
)
def p2_found(spark, d):
    from . import survivors

    return survivors.clear_cases(table(spark, d, "attribute_manifest"), table(spark, d, "annotation_trust"))


@llm.add("p2_survivors")
def p2_survivors(spark, d):
    from . import survivors

    return survivors.survivors(table(spark, d, "attribute_manifest"), table(spark, d, "annotation_trust"))


def _flag(c: str) -> str:
    return f"(CASE WHEN {spell.key(c)} IN ('1', 'true', 'yes', 'y', 'on') THEN 'true' WHEN {spell.key(c)} IN ('0', 'false', 'no', 'n', 'off') THEN 'false' END)"


def _crop_fields() -> dict[str, str]:
    """The fields that are voted on, in normal form."""
    from .survivors import FIELDS, FLAGS, WORDS

    special = {"color": spell.color("color"), "split": spell.split_name("split")} | {f: _flag(f) for f in FLAGS}
    return {f: special.get(f, spell.key(f)) for f in FIELDS + FLAGS + WORDS}


_SIGNED = {c: f"(CASE WHEN coalesce({_flag(f'{c}_supervised')}, CASE WHEN {spell.key(f'{c}_supervised')} IS NULL THEN 'true' END) = 'true' THEN {v} END)" for c, v in (("body_type", spell.key("body_type")), ("color", spell.color("color")))}


@llm.add(
    "p2_representatives",
    f"""WITH r AS (SELECT m.*, {spell.digest('stage177_pixel_sha256')} AS d, coalesce(k.trust_rank, 0) AS q FROM attribute_manifest m
      LEFT JOIN annotation_trust k ON {spell.key('k.annotation_source')} = {spell.key('m.annotation_source')}),
    n AS (SELECT *, CASE WHEN regexp_matches(d, '^[0-9a-f]{{64}}$') THEN d ELSE sha256(d) END AS p FROM r),
    g AS (SELECT p, count(*) AS n_rows, {' + '.join(f"CAST(count(DISTINCT {v}) > 1 AS INT)" for v in _crop_fields().values())} AS n_disputed,
      count(DISTINCT {_SIGNED['body_type']}) > 1 OR count(DISTINCT {_SIGNED['color']}) > 1 AS conflict FROM n WHERE p IS NOT NULL GROUP BY p),
    best AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY q DESC, coalesce(reviewed_at_ms, -1) DESC, stage177_row_number) AS k FROM n WHERE p IS NOT NULL),
    every AS (SELECT p, stage177_row_number, n_rows, n_disputed, conflict, image_path, reviewed_at_ms, stage177_read_error FROM best JOIN g USING (p) WHERE k = 1
      UNION ALL SELECT NULL, stage177_row_number, 1, 0, false, image_path, reviewed_at_ms, stage177_read_error FROM n WHERE p IS NULL)
    SELECT p AS pixel_sha256, stage177_row_number AS representative, n_rows, n_disputed, CASE WHEN {spell.key('image_path')} IS NOT NULL THEN image_path END AS image_path, reviewed_at_ms,
      conflict AS stage177_label_conflict, NOT conflict AND {spell.key('stage177_read_error')} IS NULL AS stage177_effective_representative FROM every""",
)
def p2_representatives(spark, d):
    """What SQL can say of the survivors: every crop once, its best row, what is disputed, and the settled flags."""
    return p2_survivors(spark, d).select("pixel_sha256", "representative", "n_rows", "n_disputed", "image_path", "reviewed_at_ms", "stage177_label_conflict", "stage177_effective_representative")


@llm.add(
    "p2_foreign_values",
    f"SELECT unnest([{', '.join(repr(f) for f in _crop_fields())}]) AS field_name, CAST(0 AS BIGINT) AS n_foreign, CAST(0 AS BIGINT) AS n_lost",
)
def p2_foreign_values(spark, d):
    """Per field the survivors whose value no row of their crop holds, and those without a value though a row has one."""
    from pyspark.sql import functions as F

    from . import survivors

    manifest, trust = table(spark, d, "attribute_manifest"), table(spark, d, "annotation_trust")
    fields = tuple(_crop_fields())
    held = survivors.crop_rows(manifest, trust, fields).where("content is not null").groupBy(F.lower(F.hex("content")).alias("p")).agg(*[F.collect_set(f).alias(f"held_{f}") for f in fields])
    both = survivors.survivors(manifest, trust, fields).join(held, F.col("pixel_sha256") == F.col("p"))
    counts = [F.struct(F.lit(f).alias("field_name"), F.count_if(F.col(f).isNotNull() & ~F.array_contains(f"held_{f}", F.col(f))).alias("n_foreign"), F.count_if(F.col(f).isNull() & (F.size(f"held_{f}") > 0)).alias("n_lost")) for f in fields]
    return both.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


_SETS = f"""WITH RECURSIVE held AS (SELECT stage177_row_number AS r, {spell.split_name('split')} AS s, unnest([1, 2, 3]) AS i,
        unnest([{spell.key('track_group')}, {spell.key('source_group')}, {spell.key('camera_id')}]) AS k FROM attribute_manifest),
    names AS (SELECT i, k, min(r) AS v FROM held WHERE k IS NOT NULL GROUP BY i, k),
    of_row AS (SELECT r, s, v FROM held JOIN names USING (i, k)),
    edges AS (SELECT DISTINCT a.v AS a, b.v AS b FROM of_row a JOIN of_row b USING (r)),
    reach AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
    sets AS (SELECT a, min(b) AS c FROM reach GROUP BY a)"""


@llm.add(
    "p4_found",
    f"""{_SETS},
    rows AS (SELECT DISTINCT r, s, c FROM of_row JOIN sets ON a = v)
    SELECT DISTINCT r AS stage177_row_number FROM rows WHERE c IN (SELECT c FROM rows WHERE s IS NOT NULL GROUP BY c HAVING count(DISTINCT s) > 1)""",
)
def p4_found(spark, d):
    from . import splits

    return splits.torn_rows(table(spark, d, "attribute_manifest"))


@llm.add("p4_splits")
def p4_splits(spark, d):
    from . import splits

    return splits.assigned_rows(table(spark, d, "attribute_manifest"), table(spark, d, "split_targets"))


@llm.add("p4_shares")
def p4_shares(spark, d):
    from . import splits

    return splits.reached_shares(table(spark, d, "attribute_manifest"), table(spark, d, "split_targets"))


@llm.add(
    "p4_checks",
    f"""{_SETS}, rows AS (SELECT DISTINCT r, c FROM of_row JOIN sets ON a = v)
    SELECT count(*) AS n_rows, count(DISTINCT coalesce(c, -stage177_row_number)) AS n_sets, CAST(0 AS BIGINT) AS n_torn, CAST(0 AS BIGINT) AS n_without, true AS near FROM attribute_manifest LEFT JOIN rows ON r = stage177_row_number""",
)
def p4_checks(spark, d):
    from . import splits

    return splits.invariants(table(spark, d, "attribute_manifest"), table(spark, d, "split_targets"))


@llm.add("p4_labels")
def p4_labels(spark, d):
    from . import splits

    return splits.label_report(table(spark, d, "attribute_manifest"), table(spark, d, "split_targets"))


_LINKS = f"""paths AS (SELECT {spell.path('image_path')} AS p, min(stage177_row_number) AS r FROM attribute_manifest GROUP BY 1),
    said AS (SELECT stage177_row_number AS a, unnest([{spell.path('stage177_exact_duplicate_of')}, {spell.path('stage177_near_duplicate_of')}]) AS p FROM attribute_manifest),
    links AS (SELECT DISTINCT a, paths.r AS b FROM said JOIN paths USING (p) WHERE a <> paths.r),
    edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
    linked AS (SELECT a AS r, least(a, min(b)) AS g FROM reach GROUP BY a)"""


@llm.add("p5_found", f"WITH RECURSIVE {_LINKS} SELECT r AS stage177_row_number, g AS group_id FROM linked")
def p5_found(spark, d):
    from . import groups

    return groups.linked_rows(table(spark, d, "attribute_manifest"))


@llm.add(
    "p5_groups",
    f"""WITH RECURSIVE {_LINKS}, sizes AS (SELECT g, count(*) AS n FROM linked GROUP BY g)
    SELECT stage177_row_number, coalesce(g, stage177_row_number) AS group_id, coalesce(n, 1) AS group_size
    FROM attribute_manifest LEFT JOIN linked ON r = stage177_row_number LEFT JOIN sizes USING (g)""",
)
def p5_groups(spark, d):
    from . import groups

    return groups.grouped_rows(table(spark, d, "attribute_manifest"))


@llm.add("p8_containers")
def p8_containers(spark, d):
    from . import packing

    return packing.containers(table(spark, d, "documents"), table(spark, d, "pack_limits"))


@llm.add("p8_fill")
def p8_fill(spark, d):
    from . import packing

    return packing.fill_report(table(spark, d, "documents"), table(spark, d, "pack_limits"))


_TEXTS = "(SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '')"


@llm.add(
    "p8_checks",
    f"""SELECT {spell.key('container_kind')} AS container_kind, CAST(max(capacity_tokens) AS BIGINT) AS capacity, {_TEXTS} AS n_texts, CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_torn,
      CAST(0 AS BIGINT) AS n_unequal, true AS fits FROM pack_limits WHERE capacity_tokens > 0 AND {spell.key('container_kind')} IS NOT NULL GROUP BY 1""",
)
def p8_checks(spark, d):
    from . import packing

    return packing.invariants(table(spark, d, "documents"), table(spark, d, "pack_limits"))


@llm.add("p9_mix")
def p9_mix(spark, d):
    from . import mixing

    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "source_targets"))


@llm.add("p9_shares")
def p9_shares(spark, d):
    from . import mixing

    return mixing.share_report(table(spark, d, "documents"), table(spark, d, "source_targets"))


@llm.add(
    "p9_checks",
    f"""SELECT {spell.key('source')} AS source, sum(target_share) AS target_share, max(coalesce(max_repeats, 1)) AS max_repeats, CAST(0 AS BIGINT) AS n_beyond, CAST(0 AS BIGINT) AS n_twice, true AS near
    FROM source_targets WHERE {spell.key('source')} IS NOT NULL AND target_share > 0 AND coalesce(max_repeats, 1) > 0 GROUP BY 1""",
)
def p9_checks(spark, d):
    from . import mixing

    return mixing.invariants(table(spark, d, "documents"), table(spark, d, "source_targets"))


@llm.add("p10_found")
def p10_found(spark, d):
    from . import truncation

    return truncation.truncated(table(spark, d, "documents"))


@llm.add("p10_rates")
def p10_rates(spark, d):
    from . import truncation

    return truncation.rates(table(spark, d, "documents"))
