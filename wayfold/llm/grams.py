"""Words and sentences of many texts at once, as arrays of hashes.

Words are runs of letters and digits, joined by single signs inside (10:45, don't, a/b); a Chinese or Japanese sign is a
word of its own. Case does not count, and any digit counts as 0. Sentences end at a terminator before a blank, or at the
end of a line. Everything is computed on arrays of code points; a word is a 64-bit hash, so that two different wordings
are taken for one with a chance of about 2^-64 each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_WORD, _SIGN, _JOINT, _STOP, _WIDE_STOP, _CLOSER, _BLANK, _LINE = (1 << i for i in range(8))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Stands before the first word of a sentence.
START = np.uint64(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of every code point, and the code points with all digits made 0."""
    every = "".join(map(chr, range(0x34000)))  # no letters, digits or blanks are assigned beyond
    kind = np.zeros(0x110000, np.uint8)
    same = np.arange(0x110000, dtype=np.uint32)
    for pattern, k in ((r"[^\W_]+", _WORD), (r"\s+", _BLANK)):
        for m in re.finditer(pattern, every):
            kind[m.start() : m.end()] = k
    for m in re.finditer(r"\d+", every):
        same[m.start() : m.end()] = ord("0")
    for first, last in ((0x3400, 0x9FFF), (0x3040, 0x30FF)):
        kind[first : last + 1] = _SIGN
    for chars, k in ((".:,'/-", _JOINT), (".!?", _STOP), ("。！？", _WIDE_STOP), ("\"'”’»)]", _CLOSER), ("」』）", _CLOSER)):
        for c in chars:
            kind[ord(c)] |= k
    for c in "\n\r\x0b\x0c\x1c\x1d\x1e\x85  ":
        kind[ord(c)] |= _LINE | _BLANK
    return kind, same


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the factor and of its inverse."""
    out = []
    for base in (_FACTOR, _INVERSE):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


@dataclass
class Words:
    """hash, signs (is a Chinese or Japanese sign), sentence of each word; text and terminated of each sentence."""

    hash: np.ndarray
    signs: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    terminated: np.ndarray

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each sentence that has words: its first word, and its number of words."""
        first = np.flatnonzero(np.diff(self.sentence, prepend=-1))
        return first, np.diff(first, append=len(self.sentence))


def words(texts: list[str]) -> Words:
    kind_of, digit_free = _classes()
    raw = "\n".join([*texts, ""]).lower().encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(raw, np.uint32)
    n = len(code)
    kind = np.append(kind_of[code], np.uint8(_LINE | _BLANK))  # with a line end behind, so that neighbours exist
    lengths = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    word, sign = (kind & _WORD) != 0, (kind & _SIGN) != 0
    inside = word.copy()
    inside[1:-1] |= ((kind[1:-1] & _JOINT) != 0) & word[:-2] & word[2:]
    begin = (inside[:n] & ~np.concatenate(([False], inside[: n - 1]))) | sign[:n]
    at = np.flatnonzero(begin)
    # A word ends before the first position that is not inside; a sign is one position long.
    out_at = np.flatnonzero(~inside)
    end = np.where(sign[at], at + 1, out_at[np.searchsorted(out_at, at)])
    value = mix(digit_free[code].astype(np.uint64) + np.uint64(1))
    power, back = _powers(1 << max(10, n.bit_length()))
    power, back = power[:n], back[:n]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * power, dtype=np.uint64)))
    hashes = mix((sums[end] - sums[at]) * back[at]) if len(at) else np.zeros(0, np.uint64)
    # Sentence ends: a single stop before closers and a blank, a wide stop, or the end of a line.
    dot = np.concatenate((code == ord("."), [False]))
    stop = (kind[:n] & _STOP) != 0
    stop &= ~np.concatenate(([False], dot[: n - 1])) & ~dot[1 : n + 1]
    open_at = np.flatnonzero((kind & _CLOSER) == 0)
    where = np.flatnonzero(stop)
    after = open_at[np.searchsorted(open_at, where + 1)]
    where = where[(kind[after] & _BLANK) != 0]
    ends = np.zeros(n, bool)
    ends[where] = True
    ends |= (kind[:n] & _WIDE_STOP) != 0
    bound = ends | ((kind[:n] & _LINE) != 0)
    number = np.cumsum(bound)  # the boundary itself has the number of what follows it
    bounds = np.flatnonzero(bound)
    text = np.searchsorted(np.cumsum(lengths), bounds, side="right") if len(texts) else np.zeros(0, np.int64)
    return Words(hashes, sign[at], number[at] if len(at) else np.zeros(0, np.int64), text, ends[bounds])


def tails(w: Words, sizes: tuple[tuple[int, int], ...]) -> list[np.ndarray]:
    """Per pair (size, sign size), rising, for each word the hash of so many last words of its sentence up to it; the
    second size is for words that are signs. Tails of different pairs never have the same hash, even if they are equal."""
    n = len(w.hash)
    out, result = mix(w.hash), []
    lead = np.full(n, True)  # so far all words looked at belong to the sentence
    any_signs = bool(w.signs.any())
    back = 1
    for at, (size, sign_size) in enumerate(sizes):
        while back < (max(size, sign_size) if any_signs else size):
            before = np.zeros(n, np.uint64)
            same = np.zeros(n, bool)
            if n > back:
                same[back:] = w.sentence[back:] == w.sentence[:-back]
                before[back:] = w.hash[:-back]
            before = np.where(same, before, np.where(lead, START, np.uint64(0)))
            longer = mix(out * _FACTOR + before)
            out = np.where(np.where(w.signs, sign_size, size) > back, longer, out) if any_signs else longer
            lead &= same
            back += 1
        result.append(mix(out + np.uint64(at)))
    return result


def openings(w: Words, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sentences that have words (by their first word), and for each length up to `most` the hash of their first words."""
    first, count = w.starts()
    out, so_far = [], np.full(len(first), START, np.uint64)
    for k in range(most):
        has = count > k
        so_far = np.where(has, mix(so_far * _FACTOR + w.hash[np.where(has, first + k, 0)]) if len(first) else so_far, so_far)
        out.append(so_far)
    return first, out
