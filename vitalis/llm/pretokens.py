"""Cutting text into the pre-tokens of the byte-level BPE vocabularies, a batch
of texts at a time with numpy.

The published pattern is
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Every rule of it is local, so the start of each pre-token follows from the
classes of a character and its neighbours.
"""
from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import xxhash

OTHER, LETTER, NUMBER, SPACE, BLANK, UNASSIGNED = range(6)
#: The characters of ``\\s`` (White_Space) besides U+0020.
_WHITE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Longer pre-tokens are hashed as bytes, not by the running polynomial.
LONG = 256
_APOSTROPHE = ord("'")


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    t = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(c))
        t[c] = UNASSIGNED if category == "Cn" else kind.get(category[0], OTHER)
    t[_WHITE] = SPACE
    t[32] = BLANK
    return t


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0x9E3779B97F4A7C15  # odd, so that it can be inverted modulo 2**64


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


class Cut:
    """Pre-tokens of a batch of texts. ``points``: code points of all texts;
    ``start`` / ``end``: offsets of the pre-tokens; ``bounds``: number of the
    first pre-token of each text, and their total; ``key``: 64-bit hash of each
    pre-token; ``odd``: texts that hold a code point unknown
    to this Unicode version, whose pre-tokens may be wrong."""

    def __init__(self, texts: list[str]) -> None:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text = "".join(texts)
        cp = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.points = cp
        kind = _classes()[cp]
        n = len(cp)
        ends = np.cumsum(size)
        first = np.zeros(n + 1, bool)  # first character of a text
        first[(ends - size)[size > 0]] = True
        first = first[:n]
        self.odd = np.zeros(len(texts), bool)
        if (kind == UNASSIGNED).any():
            of = np.repeat(np.arange(len(texts)), size)
            self.odd[of[kind == UNASSIGNED]] = True
        white = kind >= SPACE
        white[kind == UNASSIGNED] = False
        final = np.ones(n, bool)  # last character of a text
        if n:
            final[:-1] = first[1:]
        same = np.zeros(n, bool)  # continues the run of its class
        if n:
            same[1:] = (kind[1:] == kind[:-1]) & ~white[1:]
            same[1:] |= (kind[:-1] == BLANK) & ~white[1:]  # a blank leads the run
            same[1:] |= white[1:] & white[:-1]
            # The last of several white-space characters before other text
            # stands alone, or leads the next run.
            behind = np.zeros(n, bool)
            behind[:-1] = ~white[1:]
            behind[final] = False
            same[white & behind] = False
        start = ~same
        start[first] = True
        self._contractions(cp, kind, start, first, final)
        self.start = np.flatnonzero(start)
        self.end = np.append(self.start[1:], n)
        self.bounds = np.searchsorted(self.start, np.append(ends - size, n))
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(cp * power[:n], out=total[1:])
        self.key = (total[self.end] - total[self.start]) * inverse[self.start]
        length = self.end - self.start
        self.key ^= length.astype(np.uint64) << np.uint64(52)
        for i in np.flatnonzero(length > LONG).tolist():
            self.key[i] = xxhash.xxh64_intdigest(cp[self.start[i]:self.end[i]].tobytes())

    @staticmethod
    def _contractions(cp, kind, start, first, final) -> None:
        """'s 't 'm 'd 're 've 'll, where an apostrophe starts a pre-token."""
        at = np.flatnonzero(cp == _APOSTROPHE)
        at = at[~final[at]]
        if not len(at):
            return
        before = kind[np.maximum(at - 1, 0)]
        at = at[first[at] | (before == LETTER) | (before == NUMBER) | (before == SPACE)]
        one = cp[at + 1]
        single = np.isin(one, [ord(c) for c in "stmd"])
        two = np.where(final[at + 1], 0, cp[np.minimum(at + 2, len(cp) - 1)])
        double = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            double |= (one == ord(a)) & (two == ord(b))
        for hit, n in ((at[single], 2), (at[double], 3)):
            start[hit] = True
            start[hit + 1] = False
            rest = hit + n
            rest = rest[rest < len(cp)]
            start[rest[kind[rest] == LETTER]] = True

    def strings(self, which: np.ndarray) -> list[str]:
        text = self.text
        return [text[i:j] for i, j in zip(self.start[which].tolist(), self.end[which].tolist())]
