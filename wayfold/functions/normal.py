"""One spelling for identifiers, labels, hashes, paths and times.

Everywhere a missing value is null, blank or a filler word, and comes out as null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for "no value", and the blanks that surround values.
FILLERS = ("", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "undefined", "unknown")
BLANKS = " \t\r\n\x0b\x0c 　﻿"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key(c: Column | str) -> Column:
    """Trimmed, lower case; null where the value is missing."""
    k = F.lower(F.btrim(_col(c), F.lit(BLANKS)))
    return F.when(~k.isin(*FILLERS), k)


def label(c: Column | str, alias: dict[str, str] | None = None) -> Column:
    """A key with aliases replaced, such as grey by gray."""
    k = key(c)
    for old, new in (alias or {}).items():
        k = F.when(k == old, F.lit(new)).otherwise(k)
    return k


def color(c: Column | str) -> Column:
    return label(c, {"grey": "gray"})


def split_name(c: Column | str) -> Column:
    return label(c, {"val": "validation"})


def flag(c: Column | str, true: tuple[str, ...] = ("1", "true", "yes", "y", "on"), false: tuple[str, ...] = ("0", "false", "no", "n", "off")) -> Column:
    """true, false, or null for anything else."""
    k = key(c)
    return F.when(k.isin(*true), F.lit(True)).when(k.isin(*false), F.lit(False))


def digest(c: Column | str) -> Column:
    """A content hash without an algorithm prefix such as 'sha256:'."""
    k = F.regexp_replace(key(c), "^(sha-?256|sha2|md5)[:=]\\s*", "")
    return F.when(~k.isin(*FILLERS), k)


def bits64(c: Column | str) -> Column:
    """A 64-bit perceptual hash written in hexadecimal, as a signed long.

    A prefix 0x and separators are ignored and leading zeros restored. Null where the text is no such number, and
    where all bits are 0 or all are 1, since those come from flat pictures and identify nothing.
    """
    k = F.regexp_replace(F.regexp_replace(key(c), "^0x", ""), "[ :_-]", "")
    h = F.lpad(F.when(k.rlike("^[0-9a-f]{1,16}$"), k), 16, "0")
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    v = F.shiftleft(half(1), 32).bitwiseOR(half(9))
    return F.when(~v.isin(0, -1), v)


def path(c: Column | str) -> Column:
    """A relative path with forward slashes, without repeated slashes or a leading './', in lower case."""
    p = F.regexp_replace(F.translate(key(c), "\\", "/"), "/{2,}", "/")
    p = F.regexp_replace(F.regexp_replace(p, "/(\\./)+", "/"), "^(\\./)+", "")
    return F.when(~p.isin(*FILLERS), p)


def epoch_ms(c: Column | str) -> Column:
    """Milliseconds from a time in seconds, milli-, micro- or nanoseconds, told apart by size; null if null or not positive."""
    t = _col(c).cast("long")
    div = lambda n: F.call_function("div", t, F.lit(n))
    return (
        F.when(t <= 0, F.lit(None).cast("long"))
        .when(t < 100_000_000_000, t * 1000)
        .when(t < 100_000_000_000_000, t)
        .when(t < 100_000_000_000_000_000, div(1000))
        .otherwise(div(1_000_000))
    )
