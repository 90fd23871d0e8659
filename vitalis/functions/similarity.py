"""Token-sort similarity as native Spark expressions (no Python UDF).

score(a, b) = 100 * 2 * LCS(a', b') / (len(a') + len(b')), where x' is x
split on whitespace, tokens sorted (code-point order) and re-joined with one
space. That is the normalised-indel ratio of the two token-sorted strings.

LCS uses the bit-parallel recurrence (Allison-Dix / Hyyro): with a bitmask
M[c] of the positions of character c in the pattern string and state V
starting all ones,  U = V & M[c];  V = (V + U) | (V - U);  after the last
character LCS = number of zero bits of V. It runs as one ``aggregate`` fold
over the characters of the other string. Patterns up to 62 characters use
one BIGINT word; longer ones use an array of 62-bit words with the carry of
the addition propagated word to word (subtraction never borrows because
U is a subset of V), so any length is exact.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col, let

WORD = 62
WORD_MASK = (1 << WORD) - 1


def _shl(x, n) -> Column:
    return F.call_function("shiftleft", x, col(n).cast("int"))


def _shr(x, n) -> Column:
    return F.call_function("shiftright", x, F.lit(n))


def token_sort(s, lower: bool = False) -> Column:
    """Split on whitespace, sort tokens, join with single spaces."""
    x = F.trim(col(s))
    if lower:
        x = F.lower(x)
    toks = F.filter(F.split(x, r"\s+"), lambda t: t != "")
    return F.array_join(F.array_sort(toks), " ")


def chars(s) -> Column:
    """String -> array of its characters (code points; splitting on the
    empty pattern is native, no lambda)."""
    s = col(s)
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def _n_words(m: Column) -> Column:
    return F.greatest(F.lit(1), ((m + (WORD - 1)) / WORD).cast("int"))


def pattern_masks(s) -> Column:
    """Pattern string -> map<char, array<bigint>>: for each distinct
    character the positions where it occurs, as 62-bit words.

    Per distinct character one native ``translate`` turns the string into a
    0/1 string (that character -> 1, every other distinct character -> 0, all
    in one pass); each 62-character slice, reversed so position 0 is the
    lowest bit, is read as a binary number with ``conv``. The distinct
    characters and each 0/1 string are bound once (``let``), not recomputed
    per lambda call.
    """
    s = col(s)
    k = _n_words(F.length(s))

    def masks(d):
        def mask_for(c):
            bits = F.call_function("translate", s, F.concat(c, F.array_join(F.array_remove(d, c), "")),
                                   F.concat(F.lit("1"), F.call_function("repeat", F.lit("0"), F.size(d) - 1)))
            return let(bits, lambda b: F.transform(
                F.sequence(F.lit(0), k - 1),
                lambda j: F.conv(F.reverse(F.substring(b, j * WORD + 1, WORD)), 2, 10).cast("bigint")))

        return F.map_from_arrays(d, F.transform(d, mask_for))

    return let(F.array_distinct(chars(s)), masks)


def _word_full_masks(m: Column) -> Column:
    """Valid-bit mask of every word for a pattern of length m."""
    k = _n_words(m)
    return F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda j: F.when(j < k - 1, F.lit(WORD_MASK).cast("bigint"))
                   .otherwise(_shl(F.lit(1).cast("bigint"), m - j * WORD) - 1))


def lcs_length(pattern_len, masks, text) -> Column:
    """LCS length of a pattern (given by its length and ``pattern_masks``)
    and ``text``."""
    m = col(pattern_len)
    M = col(masks)
    full = _word_full_masks(m)
    k = _n_words(m)
    zero_words = F.array_repeat(F.lit(0).cast("bigint"), k)

    def valid(j):
        return F.when(j < k - 1, F.lit(WORD_MASK).cast("bigint")).otherwise(_shl(F.lit(1).cast("bigint"), m - j * WORD) - 1)

    def step(V, c):
        Mc = F.coalesce(F.try_element_at(M, c), zero_words)

        def word(st, j):
            v = F.element_at(V, j + 1)
            u = v.bitwiseAND(F.element_at(Mc, j + 1))
            total = v + u + st["carry"]
            nw = (total.bitwiseAND(valid(j))).bitwiseOR(v - u)
            return F.struct(F.concat(st["w"], F.array(nw)).alias("w"),
                            _shr(total, WORD).alias("carry"))

        init = F.struct(F.array().cast("array<bigint>").alias("w"), F.lit(0).cast("bigint").alias("carry"))
        return F.aggregate(F.sequence(F.lit(0), k - 1), init, word)["w"]

    V = F.aggregate(chars(text), full, step)
    ones = F.aggregate(V, F.lit(0).cast("bigint"), lambda acc, w: acc + F.bit_count(w))
    return F.when(m == 0, F.lit(0)).otherwise((m - ones).cast("int"))


def lcs_single_word(pattern_len, masks, text) -> Column:
    """Same as ``lcs_length`` for patterns of at most 62 characters, with a
    single BIGINT state (cheaper)."""
    m = col(pattern_len)
    M = col(masks)
    full = _shl(F.lit(1).cast("bigint"), m) - 1

    def step(V, c):
        u = V.bitwiseAND(F.coalesce(F.element_at(F.try_element_at(M, c), 1), F.lit(0).cast("bigint")))
        return ((V + u).bitwiseOR(V - u)).bitwiseAND(full)

    V = F.aggregate(chars(text), full, step)
    return (m - F.bit_count(V)).cast("int")


def lcs(pattern_len, masks, text) -> Column:
    return F.when(col(pattern_len) <= WORD, lcs_single_word(pattern_len, masks, text)) \
            .otherwise(lcs_length(pattern_len, masks, text))


def ratio_from_lcs(lcs_len, len1, len2) -> Column:
    """100 * 2 * LCS / (len1 + len2); two empty strings score 100."""
    tot = col(len1) + col(len2)
    return F.when(tot == 0, F.lit(100.0)).otherwise(200.0 * col(lcs_len) / tot)


def passes_cutoff(lcs_len, len1, len2, cutoff: float) -> Column:
    """score >= cutoff, decided in exact integer arithmetic."""
    return 200 * col(lcs_len) >= F.lit(cutoff) * (col(len1) + col(len2))


def min_partner_len(length, cutoff: float) -> Column:
    """Shortest partner length that can still reach the cutoff."""
    return F.ceil(F.lit(cutoff) * col(length) / (200 - cutoff))


def min_overlap(length, cutoff: float) -> Column:
    """Lower bound on the characters any passing partner shares with a
    string of this length (LCS <= multiset overlap)."""
    return F.ceil(F.lit(cutoff) * (col(length) + min_partner_len(length, cutoff)) / 200)
