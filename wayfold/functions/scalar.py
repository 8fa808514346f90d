"""Scalar functions: geometry, probabilities, hashes, weights."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def clamp01(c) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(c)))


def iou(a: tuple, b: tuple, floor: float | None = None) -> Column:
    """Overlap of two boxes (x1, y1, x2, y2); 0 for an empty union, or divided by at least `floor`."""
    ax1, ay1, ax2, ay2 = map(_c, a)
    bx1, by1, bx2, by2 = map(_c, b)
    side = lambda lo, hi: F.greatest(F.lit(0.0), hi - lo)
    inter = side(F.greatest(ax1, bx1), F.least(ax2, bx2)) * side(F.greatest(ay1, by1), F.least(ay2, by2))
    union = side(ax1, ax2) * side(ay1, ay2) + side(bx1, bx2) * side(by1, by2) - inter
    if floor is not None:
        return inter / F.greatest(union, F.lit(floor))
    return F.when(union <= 0, 0.0).otherwise(F.try_divide(inter, union))


def unletterbox(c, scale, pad, size) -> Column:
    """A coordinate in a padded, scaled picture back in the original, rounded half away from zero, within [0, size]."""
    return F.least(_c(size), F.greatest(F.lit(0.0), F.round((_c(c) - _c(pad)) / _c(scale))))


def center_to_corners(cx, cy, w, h) -> tuple[Column, Column, Column, Column]:
    """Centre and size as clipped corners."""
    cx, cy, w, h = map(_c, (cx, cy, w, h))
    return clamp01(cx - w / 2), clamp01(cy - h / 2), clamp01(cx + w / 2), clamp01(cy + h / 2)


def argmax(values: Column) -> Column:
    """Position from 0 of the first greatest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    t = _c(temperature)
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def hamming(a, b) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def stable_fraction(c: Column, modulus: int, digits: int = 8) -> Column:
    """The first hexadecimal digits of a SHA-256 as a number, modulo `modulus`."""
    return F.conv(F.substring(F.sha2(c, 256), 1, digits), 16, 10).cast("long") % F.lit(modulus)


def event_identifier(prefix: str, *parts) -> Column:
    """A prefix and the first 40 digits of the SHA-256 of the parts, one per line."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\n", *[_c(p).cast("string") for p in parts]), 256), 1, 40))


def backoff(attempt, initial_ms: int, max_ms: int) -> Column:
    """initial x 2^(attempt - 1), at most max; attempts below 1 count as 1."""
    n = F.least(F.lit(40), F.greatest(F.lit(1), _c(attempt))) - 1
    return F.least(F.lit(max_ms).cast("long"), F.lit(initial_ms).cast("long") * F.pow(F.lit(2.0), n).cast("long"))


def product(factors: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, factors, F.lit(1.0))


def wilson_lower(hits, n, z: float = 1.96) -> Column:
    """The lower bound of a proportion; 0 without observations."""
    k, m = _c(hits).cast("double"), _c(n).cast("double")
    p = F.try_divide(k, m)
    z2 = z * z
    low = (p + F.try_divide(F.lit(z2), 2 * m) - z * F.sqrt(F.try_divide(p * (1 - p), m) + F.try_divide(F.lit(z2), 4 * m * m))) / (1 + F.try_divide(F.lit(z2), m))
    return F.coalesce(F.when(m > 0, low), F.lit(0.0))


def ratio(a, b) -> Column:
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def crop_quality(size, sharpness, exposure, visibility, truncated, sharp_floor: float = 0.02) -> Column:
    """Weighted mean of size, sharpness, exposure, visibility and truncation scores.

    size: the smaller of the width and height scores; exposure: mean intensity from 0 to 1.
    """
    sharp = F.least(F.lit(1.0), _c(sharpness) / F.lit(sharp_floor)) if sharp_floor > 0 else F.lit(1.0)
    light = clamp01(1 - F.abs(_c(exposure) - 0.5) / 0.5)
    return clamp01(0.25 * _c(size) + 0.25 * sharp + 0.20 * light + 0.20 * clamp01(visibility) + 0.10 * F.when(_c(truncated), 0.0).otherwise(1.0))


def masked_uri(c: Column | str) -> Column:
    """A stream address without user, query and fragment; anything that is no stream address becomes '***'."""
    u = F.trim(_c(c))
    bare = F.regexp_replace(u, "[?#].*$", "")
    return F.when(u.rlike("^(?i)rtsps?://"), F.regexp_replace(bare, "^([A-Za-z]+://)[^/@]*@", "$1***:***@")).otherwise(F.lit("***"))


def hmac_pads(secret: str) -> tuple[bytes, bytes]:
    """The inner and the outer key of an HMAC with SHA-256, 64 bytes each."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(k ^ 0x36 for k in key), bytes(k ^ 0x5C for k in key)


def hmac_sha256(secret: str):
    """A function of (timestamp, body) that gives the hexadecimal HMAC of 'timestamp\\nbody': two built-in hashes, one over
    the other, so that no row leaves the JVM."""
    inner, outer = (F.lit(bytearray(pad)) for pad in hmac_pads(secret))

    def sign(timestamp: Column, body: Column) -> Column:
        message = F.concat(timestamp, F.lit("\n"), body).cast("binary")
        return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)

    return sign


def dhash_bits(values: Column, right_greater: bool = True, rows: int = 8, columns: int = 8) -> Column:
    """The bits of a difference hash, row by row, as text: 1 where a value is less than its right neighbour, or by the other
    convention where it is greater. values: rows of columns + 1 brightness values. Hashes of the two conventions are
    never equal for the same picture and must not be compared."""
    left = lambda i: F.get(values, F.call_function("div", i, F.lit(columns)).cast("int") * (columns + 1) + i % columns)
    right = lambda i: F.get(values, F.call_function("div", i, F.lit(columns)).cast("int") * (columns + 1) + i % columns + 1)
    bit = lambda i: F.when(right(i) > left(i) if right_greater else left(i) > right(i), "1").otherwise("0")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), bit), "")


def low_light(mean, median, border, dark, p90) -> Column:
    """From 0 to 1: how dark a picture is by its mean, median, 90th percentile and border (0 to 255) and its share of dark values."""
    part = lambda c, top, width: clamp01((F.lit(top) - _c(c)) / width)
    return 0.28 * part(mean, 95.0, 65.0) + 0.22 * part(median, 90.0, 65.0) + 0.25 * part(border, 100.0, 70.0) + 0.15 * F.least(F.lit(1.0), _c(dark) / 0.60) + 0.10 * part(p90, 165.0, 105.0)


def picture_statistics(values: Column, side: int = 8, border: int = 2) -> dict[str, Column]:
    """mean, median, p90, border, dark, contrast and edges of a square picture given row by row, from 0 to 255."""
    n = side * side
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    ordered = F.array_sort(values)
    at = lambda q: F.get(ordered, F.lit(int(q * (n - 1)))) + (q * (n - 1) - int(q * (n - 1))) * (F.get(ordered, F.lit(min(n - 1, int(q * (n - 1)) + 1))) - F.get(ordered, F.lit(int(q * (n - 1)))))
    row, column = lambda i: F.call_function("div", i, F.lit(side)), lambda i: i % side
    edge = lambda k: (k < border) | (k >= side - border)
    ring = F.filter(values, lambda x, i: edge(row(i)) | edge(column(i)))
    mean = add(values) / n
    steps = F.transform(F.filter(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: column(i) < side - 1), lambda i: F.get(values, i + 1) - F.get(values, i))
    spread = lambda a: add(F.transform(a, lambda x: x * x)) / F.size(a) - F.pow(add(a) / F.size(a), F.lit(2))
    return {"mean": mean, "median": at(0.5), "p90": at(0.9), "border": add(ring) / F.size(ring), "dark": F.size(F.filter(values, lambda x: x < 55)) / n, "contrast": F.sqrt(F.greatest(F.lit(0.0), spread(values))), "edges": spread(steps)}
