"""Predicates over rows. Each returns a boolean column; where it says so, null counts as a failed test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabularies in which manifests write truth.
TRUE_WIDE = ("1", "true", "yes", "y", "on")
TRUE_NARROW = ("1", "true", "yes")
FALSE_STRICT = ("0", "false", "no", "n", "off", "")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _word(c: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(_c(c), F.lit(""))))


def optional_equals(column: str, value: str | None) -> Column:
    """column = value, or no test at all if the value is blank."""
    return F.lit(True) if not (value or "").strip() else F.col(column) == F.lit(value)


def optional_range(column: str, start: int = 0, end: int = 0) -> Column:
    """start <= column <= end, both inclusive; 0 or less leaves a side open. Raises ValueError for start > end."""
    start, end = max(0, start), max(0, end)
    if start and end and start > end:
        raise ValueError("the range ends before it starts")
    low = F.lit(True) if not start else F.col(column) >= start
    return low if not end else low & (F.col(column) <= end)


def at_least_severity(column: str, least: int) -> Column:
    return F.col(column) >= min(5, max(1, least))


def visible(deleted: str = "deleted_at_ms", include_deleted: bool = False) -> Column:
    return F.lit(True) if include_deleted else F.col(deleted).isNull()


def truthy(c: Column | str, words: tuple[str, ...] = TRUE_WIDE) -> Column:
    """Blank and unknown words are false."""
    return _word(c).isin(*words)


def strict_flag(c: Column | str) -> Column:
    """true or false; null for a word of neither vocabulary."""
    return F.when(_word(c).isin(*TRUE_WIDE), True).when(_word(c).isin(*FALSE_STRICT), False)


def supervised(c: Column | str, review_status: Column | str = "review_status", blank: str = "true") -> Column:
    """Whether a label may be trained on; blank says what a blank cell means: 'true', 'false', or 'approved' rows only."""
    empty = _word(c) == ""
    if blank == "true":
        return empty | truthy(c)
    if blank == "false":
        return truthy(c)
    if blank == "approved":
        return F.when(empty, _word(review_status) == "approved").otherwise(truthy(c))
    raise ValueError("blank is one of true, false, approved")


def between01(c: Column | str) -> Column:
    return F.coalesce(_c(c).between(0.0, 1.0), F.lit(False))


def identifier(c: Column | str, longest: int = 160) -> Column:
    """Letters, digits, '_', '.', '-', 1 to `longest` characters."""
    return F.coalesce(_c(c).rlike(rf"^[A-Za-z0-9_.-]{{1,{longest}}}$"), F.lit(False))


def safe_path(c: Column | str) -> Column:
    """A relative path without backslash, drive, empty part, '.' or '..'."""
    p = _c(c)
    clean = ~p.startswith("/") & ~p.contains("\\") & ~p.rlike("^[A-Za-z]:")
    parts = F.forall(F.split(p, "/"), lambda x: ~x.isin("", ".", ".."))
    return F.coalesce(clean & parts, F.lit(False))


def valid_box(x1, y1, x2, y2) -> Column:
    """0 <= x1 < x2 <= 1 and the same for y."""
    a, b, c, d = map(_c, (x1, y1, x2, y2))
    return F.coalesce((a >= 0) & (a < c) & (c <= 1) & (b >= 0) & (b < d) & (d <= 1), F.lit(False))


def gated(label, confidence, threshold) -> Column:
    """The label if it is known and confident enough, else 'unknown'; a missing threshold lets nothing through."""
    lab, conf = _c(label), _c(confidence)
    return F.when((lab != "unknown") & (conf >= F.coalesce(_c(threshold), F.lit(1.01))), lab).otherwise(F.lit("unknown"))


def marked(columns: list[str], markers: list[str]) -> Column:
    """Some cell contains some marker."""
    return F.exists(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), lambda x: F.array_contains(F.array(*[x.contains(m) for m in markers]), True))


def first_reason(*rules: tuple[str, Column], otherwise: str = "accepted") -> Column:
    """The name of the first rule whose condition holds."""
    out = None
    for name, condition in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def tags(*rules: tuple[str, Column]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))


# The labels that records may carry, and why a track may end.
VEHICLE_CLASSES = ("car", "truck", "bus", "motorcycle", "vehicle")
BODY_TYPES = ("sedan", "suv", "mpv", "van", "pickup", "truck", "light_truck", "heavy_truck", "bus", "unknown")
COLORS = ("white", "black", "gray", "silver", "red", "blue", "yellow", "green", "brown", "unknown")
QUALITIES = ("good", "usable", "poor", "unknown")
VIEWPOINTS = ("front", "front_three_quarter", "side", "rear_three_quarter", "rear", "unknown")
FINAL_REASONS = ("stable", "track_exit", "run_stop")
