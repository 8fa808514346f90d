"""The normal forms of functions.normal, in the SQL that states expected results."""

from __future__ import annotations

from ..functions.normal import FILLERS

_BLANKS = "chr(32)||chr(9)||chr(13)||chr(10)||chr(11)||chr(12)||chr(160)||chr(12288)||chr(65279)"
_FILLERS = ", ".join(f"'{w}'" for w in FILLERS)


def trimmed(c: str) -> str:
    return f"lower(trim({c}, {_BLANKS}))"


def known(e: str) -> str:
    return f"(CASE WHEN {e} IN ({_FILLERS}) THEN NULL ELSE {e} END)"


def key(c: str) -> str:
    return known(trimmed(c))


def split_name(c: str) -> str:
    return f"(CASE WHEN {key(c)} = 'val' THEN 'validation' ELSE {key(c)} END)"


def color(c: str) -> str:
    return f"(CASE WHEN {key(c)} = 'grey' THEN 'gray' ELSE {key(c)} END)"


def digest(c: str) -> str:
    return known(f"regexp_replace({trimmed(c)}, '^(sha-?256|sha2|md5)[:=]\\s*', '')")


def bits64(c: str) -> str:
    h = f"regexp_replace(regexp_replace({key(c)}, '^0x', ''), '[ :_-]', '', 'g')"
    n = f"(CASE WHEN regexp_matches({h}, '^[0-9a-f]{{1,16}}$') THEN CAST('0x' || {h} AS UBIGINT) END)"
    return f"(CASE WHEN {n} NOT IN (0, 18446744073709551615) THEN {n} END)"


def path(c: str) -> str:
    p = f"regexp_replace(replace({key(c)}, chr(92), '/'), '/+', '/', 'g')"
    return known(f"regexp_replace(regexp_replace({p}, '/(\\./)+', '/', 'g'), '^(\\./)+', '')")


def epoch_ms(c: str) -> str:
    return (
        f"(CASE WHEN {c} <= 0 THEN NULL WHEN {c} < 100000000000 THEN {c} * 1000 WHEN {c} < 100000000000000 THEN {c}"
        f" WHEN {c} < 100000000000000000 THEN {c} // 1000 ELSE {c} // 1000000 END)"
    )


def members(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)
