"""Repeated passages by collinear chaining.

Seeds are k-mers of ``K`` words, winnowed: of every ``WINDOW`` k-mers in a row
the one of least hash is kept, on ties one that is kept already, so two texts that
share K + WINDOW - 1 words in a row share a seed. Every occurrence of a seed is
matched with the seed's first holder (the smallest doc_id), never with all others, so
a passage that thousands of documents hold costs a row each. An occurrence in the
first holder itself, and one whose seed stands less than ``MIN_WORDS`` words before
it in the same document, is matched with that previous place, so that text of a short
period is one chain along one diagonal. Earlier documents may hold a passage only in
parts too short to report, so an occurrence is also matched with the first holder
of the runs of ``RUNS`` repeated seeds that begin with it: a run that spans parts
leads to a document that holds them together. That is at most ``len(RUNS)`` rows
more for an occurrence.

First holders of short runs may still hold too little. So of every ``MIN_WORDS`` words in
a row that stand earlier, word for word, and lie in no passage found that way, the first
holder is looked up by the hash of all of them, and matched: an equal passage is always
found, whatever other documents hold of it. A changed passage that shares no
``MIN_WORDS`` equal words with its source is found by the first holders alone.

The matches of a document with one holder are chained: with matches in order of
their place x in the document, the best chain ending in (x, y) is K plus the best
of the chains that end before it in both texts, less ``GAP`` for each word skipped
in either. The gap cost is linear, so that best predecessor is a prefix maximum
over y, kept in a Fenwick tree; where that one is farther than ``MAX_GAP``, the best
of the matches within ``MAX_GAP`` words before x is looked up instead, a number that
the words bound. A chain may be a single match; chains that follow one another
within ``MAX_GAP`` are joined. They are then aligned word by word: equal words
beyond the ends extend them, the words between matches are compared by their
longest common subsequence, and a chain whose passage is less than
``SIMILARITY`` alike is cut at its widest gap. What is left is extended to both
sides over changed words, too, as far as that makes a better passage, before its
length and similarity are judged.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small_batches, written
from .decontaminate import _FOLD, words_of

K = 5
WINDOW = 8
GAP = 0.05
#: A chain never steps over more words than this in either text.
MAX_GAP = 100
MIN_WORDS = 40
#: Seeds in a row whose first holder an occurrence is matched with, besides that of
#: its own seed.
RUNS = (2, 4)
#: Of MIN_WORDS words in a row, those that stand from their first seed on at least.
WIDE = MIN_WORDS - WINDOW + 1
SIMILARITY = 0.8
#: Common words an extension must add for each word, on average.
WORTH = 0.6
#: Words taken along on either side of a chain, to extend it: a part of a passage
#: whose seeds lead to an earlier holder is either long enough to be a passage with
#: that holder, or within this margin of the rest, whose first seed may lie up to
#: WINDOW words behind it; and a single seed is to lead to the words around it.
MARGIN = MIN_WORDS + 2 * WINDOW
_NO_ID = -(1 << 63)  # stands for a null doc_id inside
_ODD = 0x9E3779B97F4A7C15


#: Powers a worker keeps from one batch to the next, 16 bytes each.
_KEPT_POWERS = 1 << 21
_kept: list = [np.zeros(0, np.uint64)] * 2


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= len(_kept[0]):
        return _kept[0][:n], _kept[1][:n]
    size = min(max(n, 2 * len(_kept[0])), _KEPT_POWERS) if n <= _KEPT_POWERS else n
    out = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if size <= _KEPT_POWERS:
        _kept[:] = out
    return out[0][:n], out[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _grams(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, by doubling."""
    h, size = word, 1
    for bit in bin(n)[3:]:
        h, size = h[:-size] * np.uint64(pow(_ODD, size, 1 << 64)) + h[size:], 2 * size
        if bit == "1":
            h, size = h[:-1] * np.uint64(_ODD) + word[size:], size + 1
    return _mix(h)


def _word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the text number of each."""
    every = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(t) + 1 for t in every], np.int64)
    data = np.frombuffer(b"\0".join(every).translate(_FOLD), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.zeros(len(data) + 2, bool)
    np.not_equal(data, 32, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * power[:-1], out=total[1:])
    words = np.diff(np.searchsorted(first, np.cumsum(size)), prepend=0)
    return _mix((total[last] - total[first]) * inverse[first]), np.repeat(np.arange(len(texts)), words)


def seeds_of(texts: list[str | None], k: int = K, window: int = WINDOW):
    """Winnowed seeds of several texts: (text number, hash, word number, word number
    of the same seed before it in the text or -1)."""
    of, h, at, before, _, _ = marked_seeds(texts, k, window)
    kept = before >= -1
    return of[kept], h[kept], at[kept], before[kept]


def marked_seeds(texts: list[str | None], k: int = K, window: int = WINDOW):
    """What ``seeds_of`` gives, with the hash of the ``WIDE`` words from the seed on (0 where
    fewer are left) and the number of words from it to the end of the text. Places that
    ``_thinned`` leaves out follow, with -2 for the place before, where other words are
    behind them than behind the same seed before."""
    word, of = _word_hashes(texts)
    if len(word) < k:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64),
                np.zeros(0, np.uint64), np.zeros(0, np.int64))
    text_of = of
    n = len(word) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(_ODD) + word[i:i + n]
    h = _mix(h)
    inside = of[:n] == of[k - 1:]
    at, h, of = np.flatnonzero(inside), h[inside], of[:n][inside]
    starts = np.searchsorted(of, np.arange(len(texts)))
    begin_word = np.searchsorted(text_of, np.arange(len(texts)))
    # Windows of ``window`` k-mers; a text with fewer has one window. Minimum of
    # each by doubling, with its place (the first one on ties).
    m = len(h)
    if not m:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64),
                np.zeros(0, np.uint64), np.zeros(0, np.int64))
    end = np.append(starts[1:], m)
    low, least = np.arange(m), h
    width = 1
    while width < min(window, m):
        step = min(width, min(window, m) - width)
        less = least[step:] < least[:-step]
        low = np.where(less, low[step:], low[:-step])
        least = np.minimum(least[step:], least[:-step])
        width += step
    # Windows across two texts do not count; one at the begin of a short text stands for it.
    size = end - starts
    full = np.arange(m) + window <= end[of]
    full[starts[size > 0]] = True
    low = np.append(low, np.arange(len(low), m))
    for t in np.flatnonzero((size > 0) & (size < window)).tolist():
        low[starts[t]] = starts[t] + h[starts[t]:end[t]].argmin()
    low = low[full]  # ascending
    every = low[np.append(True, low[1:] != low[:-1])]
    kept = _thinned(every, h, end[of], window)
    of, h, at = of[every], h[every], at[every]
    left = np.append(begin_word[1:], len(word))[of] - at
    wide = np.zeros(len(at), np.uint64)
    if len(word) >= WIDE:
        wide[left >= WIDE] = _grams(word, WIDE)[at[left >= WIDE]]
    at = at - begin_word[of]
    order = np.argsort(h, kind="stable")  # equal ones by text and place
    same = (of[order][1:] == of[order][:-1]) & (h[order][1:] == h[order][:-1])
    other = np.ones(len(order), bool)
    other[order[1:][same]] = wide[order[1:][same]] != wide[order[:-1][same]]
    before = np.full(len(order), -2, np.int64)
    before[kept] = -1
    order = order[kept[order]]
    same = (of[order][1:] == of[order][:-1]) & (h[order][1:] == h[order][:-1])
    before[order[1:][same]] = at[order[:-1][same]]
    use = np.concatenate([np.flatnonzero(kept), np.flatnonzero(~kept & other & (left >= WIDE))])
    return of[use], h[use], at[use], before[use], wide[use], left[use]


def _thinned(keep: np.ndarray, h: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """Which places stay: not those that equal the one kept before them and that no
    window needs, as the next one kept, or the end of the text, is near enough."""
    stay, ends = np.ones(len(keep), bool), end[keep]
    hashes = h[keep]
    tied = np.flatnonzero((hashes[1:] == hashes[:-1]) & (ends[1:] == ends[:-1])) + 1
    if not len(tied):
        return stay
    behind = np.minimum(tied + 1, len(keep) - 1)
    after = np.where((behind > tied) & (ends[behind] == ends[tied]), keep[behind], ends[tied])
    last, run = -1, -1
    for i, prior, place, stop in zip(tied.tolist(), keep[tied - 1].tolist(), keep[tied].tolist(), after.tolist()):
        if run != i - 1:
            last = prior  # the first of a run of equal places
        run = i
        if stop - last <= window:
            stay[i] = False
        else:
            last = place
    return stay


class _Fenwick:
    """Prefix maxima with the index that holds them."""

    def __init__(self, n: int) -> None:
        self.value = [-1e300] * (n + 1)
        self.who = [-1] * (n + 1)

    def put(self, i: int, value: float, who: int) -> None:
        i += 1
        v, w = self.value, self.who
        while i < len(v):
            if value > v[i]:
                v[i], w[i] = value, who
            i += i & -i

    def best(self, i: int) -> tuple[float, int]:
        """Maximum over places before i."""
        v, w = self.value, self.who
        top, who = -1e300, -1
        while i > 0:
            if v[i] > top:
                top, who = v[i], w[i]
            i -= i & -i
        return top, who


def chains_of(x: list[int], y: list[int], k: int = K, gap: float = GAP, max_gap: int = MAX_GAP) -> list[list[int]]:
    """Disjoint chains of the matches (x sorted ascending), best first, as lists
    of match numbers in order."""
    n = len(x)
    order_y = sorted(set(y))
    place = {v: i for i, v in enumerate(order_y)}
    tree = _Fenwick(len(order_y))
    score, back = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and x[j] == x[i]:  # matches of one x do not follow each other
            top, who = tree.best(place[y[j]])
            reach = float(k)
            if who >= 0 and (x[j] - x[who] > max_gap or y[j] - y[who] > max_gap):
                top, who = -1e300, -1
                t = i - 1
                while t >= 0 and x[j] - x[t] <= max_gap:
                    if 0 < y[j] - y[t] <= max_gap and score[t] + gap * (x[t] + y[t]) > top:
                        top, who = score[t] + gap * (x[t] + y[t]), t
                    t -= 1
            if who >= 0:
                joined = k + top - gap * (x[j] + y[j])
                if joined > reach:
                    reach, back[j] = joined, who
            score[j] = reach
            j += 1
        for t in range(i, j):
            tree.put(place[y[t]], score[t] + gap * (x[t] + y[t]), t)
        i = j
    used = [False] * n
    out = []
    for t in sorted(range(n), key=lambda t: (-score[t], t)):
        if used[t]:
            continue
        chain = []
        while t >= 0 and not used[t]:
            used[t] = True
            chain.append(t)
            t = back[t]
        out.append(chain[::-1])
    return out


def _met(mask: dict, b: list, full: int) -> int:
    """Bits of the words, numbered by ``mask``, at which the longest common subsequence
    of their prefixes with ``b`` grows."""
    v = full
    for w in b:
        if w in mask:
            u = v & mask[w]
            v = ((v + u) | (v - u)) & full
    return full ^ v


def _common(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit per word of ``a``; equal
    words at both ends are taken off first."""
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    i = j = 0
    while i < n and a[i] == b[i]:
        i += 1
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    if i or j:
        return i + j + _common(a[i:len(a) - j], b[i:len(b) - j])
    if not a or not b:
        return 0
    mask: dict = {}
    for i, w in enumerate(a):
        mask[w] = mask.get(w, 0) | 1 << i
    return _met(mask, b, (1 << len(a)) - 1).bit_count()


def joined(chains: list[list[int]], x: list[int], y: list[int], max_gap: int = MAX_GAP) -> list[list[int]]:
    """Chains that follow one another within ``max_gap`` in both texts as one,
    each after the one that ends last before it on the nearest diagonal."""
    out: list[list[int]] = []
    near: list[list[int]] = []  # chains that end within max_gap before x
    for c in sorted(chains, key=lambda c: (x[c[0]], y[c[0]])):
        p, q = x[c[0]], y[c[0]]
        near = [d for d in near if p - x[d[-1]] <= max_gap]
        fits = [d for d in near if 0 < p - x[d[-1]] and 0 < q - y[d[-1]] <= max_gap]
        if fits:
            min(fits, key=lambda d: (abs(p - q - x[d[-1]] + y[d[-1]]), -x[d[-1]])).extend(c)
        else:
            out.append(list(c))
            near.append(out[-1])
    return out


def _prefixes(a: list, b: list) -> list[int]:
    """Length of the longest common subsequence of a[:n] and b[:n], n from 0 to
    the shorter length."""
    n = min(len(a), len(b))
    mask: dict = {}
    for i, w in enumerate(a[:n]):
        mask[w] = mask.get(w, 0) | 1 << i
    out, v, full, found = [0], (1 << n) - 1, (1 << n) - 1, 0
    for j in range(n):
        w = b[j]
        if w in mask:
            u = v & mask[w]
            v = ((v + u) | (v - u)) & full
            found = j + 1 - (v & ((2 << j) - 1)).bit_count()
        elif not v >> j & 1:
            found += 1
        out.append(found)
    return out


def _steps(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    """Lengths at which an extension over ``a`` and ``b`` gains common words (0
    first), and the common words at each."""
    found = _prefixes(a, b)
    at = [0] + [n for n in range(1, len(found)) if found[n] > found[n - 1]]
    return np.array(at), np.array([found[n] for n in at])


def _end(a: list, b: list) -> tuple[int, int]:
    """The shortest prefixes of a and b with all their common words in order."""
    mask: dict = {}
    for i, w in enumerate(a):
        mask[w] = mask.get(w, 0) | 1 << i
    i = _met(mask, b, (1 << len(a)) - 1).bit_length()
    mask = {}
    for j, w in enumerate(b):
        mask[w] = mask.get(w, 0) | 1 << j
    return i, _met(mask, a[:i], (1 << len(b)) - 1).bit_length()


def _extend(a: list, b: list, at: tuple[int, int, int, int, int], low: tuple[int, int], high: tuple[int, int],
            min_words: int, similarity: float) -> tuple[int, int, int, int, int]:
    """A passage (begin and end in a, begin and end in b, common words) with the
    words beyond its ends, not before ``low`` nor behind ``high``, that raise
    common words - WORTH * words most and leave it ``similarity`` alike. If that
    is shorter than ``min_words``, the best of the longer ones."""
    a0, a1, b0, b1, same = at
    before = a[low[0]:a0][::-1], b[low[1]:b0][::-1]
    behind = a[a1:high[0]], b[b1:high[1]]
    (n, gain), (m, more) = _steps(*before), _steps(*behind)
    size = max(a1 - a0, b1 - b0) + n[:, None] + m[None, :]
    common = same + gain[:, None] + more[None, :]
    value = np.where(common >= similarity * size - 1e-9, common - WORTH * size, -np.inf)
    least = min(a1 - a0, b1 - b0) + n[:, None] + m[None, :]
    i, j = np.unravel_index(value.argmax(), value.shape)
    if least[i, j] < min_words:
        value = np.where(least >= min_words, value, -np.inf)
        if value.max() == -np.inf:
            return at
        i, j = np.unravel_index(value.argmax(), value.shape)
    i, j = int(n[i]), int(m[j])
    same = int(common[np.searchsorted(n, i), np.searchsorted(m, j)])
    # Words at the ends that are in no common subsequence go, if enough are left.
    (p, q), (r, t) = _end(before[0][:i], before[1][:i]), _end(behind[0][:j], behind[1][:j])
    if a1 - a0 + p + r >= min_words and b1 - b0 + q + t >= min_words:
        return a0 - p, a1 + r, b0 - q, b1 + t, same
    return a0 - i, a1 + j, b0 - i, b1 + j, same


def align(a: list, b: list, xs: list[int], ys: list[int], k: int = K, min_words: int = MIN_WORDS,
          similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """Passages (begin and end in ``a``, begin and end in ``b``, similarity) along
    a chain of matches at xs / ys. Similarity: common words in order, divided by
    the longer side."""
    # Matches to blocks of equal words along a diagonal, grown to both sides.
    blocks: list[list[int]] = []  # begin in a, begin in b, length
    for x, y in zip(xs, ys):
        if blocks and x - blocks[-1][0] == y - blocks[-1][1] and x <= blocks[-1][0] + blocks[-1][2]:
            blocks[-1][2] = max(blocks[-1][2], x - blocks[-1][0] + k)
            continue
        low_a, low_b = (blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]) if blocks else (0, 0)
        if x < low_a or y < low_b:  # overlaps on another diagonal: keep what is left of it
            cut = max(low_a - x, low_b - y)
            if cut >= k:
                continue
            x, y, size = x + cut, y + cut, k - cut
        else:
            size = k
        while x > low_a and y > low_b and a[x - 1] == b[y - 1]:
            x, y, size = x - 1, y - 1, size + 1
        while x + size < len(a) and y + size < len(b) and a[x + size] == b[y + size]:
            size += 1
        if blocks and x == low_a and y == low_b and x - y == blocks[-1][0] - blocks[-1][1]:
            blocks[-1][2] += size
        else:
            blocks.append([x, y, size])
    gaps = []  # (words between, common words) after each block but the last
    for p, q in zip(blocks, blocks[1:]):
        s, t = a[p[0] + p[2]:q[0]], b[p[1] + p[2]:q[1]]
        gaps.append((max(len(s), len(t)), _common(s, t)))

    out = []

    done = (0, 0)
    todo = [(0, len(blocks))] if blocks else []
    while todo:
        i, j = todo.pop()
        first, last = blocks[i], blocks[j - 1]
        a0, a1, b0, b1 = first[0], last[0] + last[2], first[1], last[1] + last[2]
        same = sum(x[2] for x in blocks[i:j]) + sum(g[1] for g in gaps[i:j - 1])
        goal = similarity * max(a1 - a0, b1 - b0) - 1e-9
        if same < goal and min(a1 - a0, b1 - b0) >= goal:  # blocks may hide better alignments
            same = _common(a[a0:a1], b[b0:b1])
        if same >= goal:
            high = tuple(blocks[j][:2]) if j < len(blocks) else (len(a), len(b))
            high = min(high[0], a1 + MARGIN), min(high[1], b1 + MARGIN)
            low = max(done[0], a0 - MARGIN), max(done[1], b0 - MARGIN)
            a0, a1, b0, b1, same = _extend(a, b, (a0, a1, b0, b1, same), low, high, min_words, similarity)
            if a1 - a0 >= min_words and b1 - b0 >= min_words:
                out.append((a0, a1, b0, b1, max(same, _common(a[a0:a1], b[b0:b1])) / max(a1 - a0, b1 - b0)))
                done = a1, b1
            else:
                done = last[0] + last[2], last[1] + last[2]
        elif j - i > 1:
            cut = max(range(i, j - 1), key=lambda g: gaps[g][0] - gaps[g][1]) + 1
            todo += [(cut, j), (i, cut)]
    return out


def hopeless(a: list, b: list, need: int) -> bool:
    """Whether two word lists have fewer than ``need`` words in common, counted with
    repeats: no passage with that many common words can lie in them."""
    both = set(a).intersection(b)
    if len(both) >= need:
        return False
    a, b = [w for w in a if w in both], [w for w in b if w in both]
    if min(len(a), len(b)) < need:
        return True
    left: dict = {}
    for w in a:
        left[w] = left.get(w, 0) + 1
    for w in b:
        n = left[w]
        if n:
            left[w] = n - 1
            need -= 1
    return need > 0


KEYS = ["doc", "tag", "src", "src_tag"]
CHAIN = "doc long, tag long, src long, src_tag long, xs array<int>, ys array<int>"


def _whole_groups(batches):
    """Columns of Arrow batches that are sorted by ``KEYS``, as arrays of whole groups."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        held = new if held is None else [np.concatenate(p) for p in zip(held, new)]
        last = np.ones(len(held[0]), bool)
        for k in range(len(KEYS)):
            last &= held[k] == held[k][-1]
        cut = int(last.argmax())
        if cut:
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
    if held is not None:
        yield held


def _chain(batches):
    import pyarrow as pa
    for columns in _whole_groups(batches):
        keys, (x, y) = columns[:4], columns[4:]
        begins = np.ones(len(x), bool)
        begins[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        new = begins.copy()  # repeated rows give a match twice
        new[1:] |= (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        keys, x, y, begins = [k[new] for k in keys], x[new], y[new], begins[new]
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, len(x)))
        # Matches on one diagonal without wide gaps are one chain.
        straight = begins.copy()
        straight[1:] |= (x[1:] - x[:-1] == y[1:] - y[:-1]) & (x[1:] - x[:-1] <= MAX_GAP)
        straight = np.logical_and.reduceat(straight, start)
        rows = np.repeat(straight, size)
        ends = np.concatenate([[0], np.cumsum(size[straight])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k[start[straight]]) for k in keys]
            + [pa.ListArray.from_arrays(pa.array(ends), pa.array(v[rows].astype(np.int32))) for v in (x, y)],
            names=[*KEYS, "xs", "ys"])
        out: list[tuple[int, list, list]] = []
        for g in np.flatnonzero(~straight).tolist():
            lo, hi = int(start[g]), int(start[g] + size[g])
            p, q = x[lo:hi].tolist(), y[lo:hi].tolist()
            out += [(lo, [p[t] for t in c], [q[t] for t in c]) for c in joined(chains_of(p, q), p, q)]
        if out:
            at = np.array([r[0] for r in out])
            yield pa.RecordBatch.from_arrays(
                [pa.array(k[at]) for k in keys] + [pa.array([r[i] for r in out], pa.list_(pa.int32())) for i in (1, 2)],
                names=[*KEYS, "xs", "ys"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages that stand in an earlier document or earlier in the same one, one
    row each:
    doc_id, first_word, end_word, source_id (smallest doc_id that holds a
    seed or a run of seeds), source_first_word, source_end_word, similarity. Word numbers count
    from 0, ends are exclusive.

    Passages have at least ``MIN_WORDS`` words on either side and a similarity of
    at least ``SIMILARITY``. Null, empty and shorter texts have none. A null
    doc_id sorts first. Rows that repeat a doc_id and its text are one document;
    other columns are not looked at. A passage that its first holder repeats, or that
    has a period of less than ``MIN_WORDS`` words, is reported with its previous
    place in the same document as the source, which may overlap it and lies up to
    ``WINDOW`` words and a period before it. Similarity: words of the longest common
    subsequence, divided by the longer side.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"),
                      F.xxhash64("text").alias("tag"), "text").where(F.col("text").isNotNull())
    # Each step but the seeds is a written table; what it was made of goes before the next one.
    places = _place_table(_seeds(src))
    chains = _chain_table(_hits(places))
    shared = written(places.where("wide is not null").select("doc", "tag", "x", "tail", "wide", "again"), "shared")
    discard(places)
    found = _aligned(src, chains)
    rest = _rest_table(src, shared, found)
    discard(shared)
    if rest is not None:
        more = _aligned(src, _chain_table(rest))
        discard(rest)
        found = found.union(more)
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return found.select(real("doc").alias("doc_id"), "first_word", "end_word", real("src").alias("source_id"),
                        "source_first_word", "source_end_word", "similarity").distinct()


def _seeds(src: DataFrame) -> DataFrame:
    """Every seed of a text of ``MIN_WORDS`` words or more: seed, doc, tag, x, the place of
    the same seed before it (-2: left out by ``_thinned``), a hash of the ``WIDE`` words from it
    on and how many of ``MIN_WORDS`` are there, 0 where fewer than ``WIDE`` are."""
    def emit(batches):
        import pyarrow as pa
        for b in batches:
            doc, tag = b.column(0).to_numpy(), b.column(1).to_numpy()
            texts = b.column(2).to_pylist()
            i = 0
            while i < len(texts):
                j, n = i, 0
                while j < len(texts) and (j == i or n < 1 << 20):
                    n += len(texts[j])
                    j += 1
                found = marked_seeds(texts[i:j])
                of, h, at, before, wide, left = [c[found[2] + found[5] >= MIN_WORDS] for c in found]
                tail = np.where(left >= WIDE, np.minimum(left, MIN_WORDS), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(doc[i:j][of]), pa.array(tag[i:j][of]), pa.array(at.astype(np.int32)),
                     pa.array(before.astype(np.int32)), pa.array(wide.astype(np.uint32).view(np.int32)),
                     pa.array(tail.astype(np.int8))],
                    names=["seed", "doc", "tag", "x", "before", "wide", "tail"])
                i = j

    return src.mapInArrow(emit, "seed long, doc long, tag long, x int, before int, wide int, tail byte")


def _place_table(seeds: DataFrame) -> DataFrame:
    """Repeated seeds in the order of their document, with the seed's first holder
    and the runs they begin. ``wide`` names the seed with the words behind it where these
    stand elsewhere, too; ``again`` says whether that is at a smaller (doc, tag, x)."""
    same = Window.partitionBy("seed").orderBy("wide", "doc", "tag", "x")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct("doc", "tag", "x")
    met = (seeds.repartition("seed")
           .select("*", F.min(here).over(whole).alias("f"), F.count("*").over(whole).alias("n"),
                   F.lag(F.struct("doc", "tag", "x", "wide")).over(same).alias("p"), F.lead("wide").over(same).alias("next"))
           .where("n > 1").where(F.col("p").isNull() | (here != F.struct("p.doc", "p.tag", "p.x"))))  # once a repeated row
    places = met.select("doc", "tag", F.col("f.doc").alias("src"), F.col("f.tag").alias("src_tag"), "x", F.col("f.x").alias("y"),
                        "before", "seed", "tail",
                        F.when((F.col("tail") > 0) & ((F.col("p.wide") == F.col("wide")) | (F.col("next") == F.col("wide"))),
                               F.xxhash64("seed", "wide")).alias("wide"),
                        F.coalesce((F.col("tail") > 0) & (F.col("p.wide") == F.col("wide")), F.lit(False)).alias("again"))
    order = Window.partitionBy("doc", "tag", F.col("before") == -2).orderBy("x")
    return written(places.repartition("doc", "tag").select(*KEYS, "x", "y", "before", "wide", "again", "tail", *[
        F.when(F.lead("seed", n - 1).over(order).isNotNull() & (F.col("before") > -2),
               F.xxhash64("seed", *[F.lead("seed", i).over(order) for i in range(1, n)])).alias(f"run{n}")
        for n in RUNS]), "places")


def _first(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (doc, tag, x, ...) whose ``key`` stands at a smaller (doc, tag, x), the
    smallest being ``f``."""
    here = F.struct("doc", "tag", "x")
    return rows.select("*", F.min(here).over(Window.partitionBy(key)).alias("f")).where(here > F.col("f"))


def _hits(places: DataFrame) -> DataFrame:
    """Matches of the places with first holders of their seeds and runs."""
    places = places.where("before > -2")
    near = F.expr(f"before >= 0 and x - before < {MIN_WORDS}")
    itself = F.expr("doc = src and tag = src_tag")
    hits = places.where(~near & ~itself).select(*KEYS, "x", "y").union(
        places.where((near | itself) & (F.col("before") >= 0)).select("doc", "tag", "doc", "tag", "x", "before"))
    for n in RUNS:
        run = _first(places.where(F.col(f"run{n}").isNotNull() & ~near), f"run{n}")
        other = F.struct("src", "src_tag", "y") != F.struct("f.doc", "f.tag", "f.x")
        hits = hits.union(run.where(other).select("doc", "tag", "f.doc", "f.tag", "x", "f.x"))
    return hits


def _rest_table(src: DataFrame, shared: DataFrame, found: DataFrame) -> DataFrame | None:
    """Matches for what the first holders of seeds and runs leave: of every ``MIN_WORDS``
    words in a row that stand earlier and lie in no passage of ``found``, with their first
    holder. None if there are no such words.

    Such words have a seed among their first ``WINDOW``, and the ``WIDE`` words from there
    on stand earlier, too. The documents that hold those are opened, and the runs of
    ``MIN_WORDS`` words around them compared."""
    lo, hi = F.greatest(F.col("x") - (WINDOW - 1), F.lit(0)), F.col("x") + F.col("tail")
    spans = found.select("doc", "tag", F.col("first_word").alias("lo"), F.col("end_word").alias("to"))
    asked = shared.where("again").select("doc", "tag", lo.alias("lo"), "x", hi.alias("hi"), "wide")
    till = F.max("to").over(Window.partitionBy("doc", "tag").orderBy("lo"))
    left = written(asked.unionByName(spans, allowMissingColumns=True).withColumn("till", till)
                   .where("x is not null and (till is null or till < hi)").select("doc", "tag", "x", "wide"), "left")
    if left.isEmpty():
        discard(left)
        return None
    held = (shared.join(left.select("wide").distinct(), "wide", "left_semi").select("doc", "tag", "x")
            .unionByName(left.select("doc", "tag", F.col("x").alias("ask")), allowMissingColumns=True)
            .groupBy("doc", "tag").agg(F.collect_list("x").alias("xs"), F.collect_list("ask").alias("asks")))
    spans = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "to")).alias("spans"))
    todo = (src.dropDuplicates(["doc", "tag"]).join(held, ["doc", "tag"]).join(spans, ["doc", "tag"], "left")
            .select("doc", "tag", "text", "xs", "asks", F.col("spans.lo").alias("lo"), F.col("spans.to").alias("to")))

    def around(places, n):
        p = np.unique((np.asarray(places, np.int64)[:, None] - np.arange(WINDOW)).ravel())
        return p[(p >= 0) & (p + MIN_WORDS <= n)]

    def runs(batches):
        import pyarrow as pa
        for b in batches:
            for doc, tag, text, xs, asks, lo, to in zip(*[c.to_pylist() for c in b.columns]):
                word, _ = _word_hashes([text])
                p, ask = around(xs, len(word)), around(asks, len(word))
                if lo and len(ask):
                    lo, to = np.array(lo), np.array(to)
                    order = np.argsort(lo, kind="stable")
                    till = np.concatenate([[0], np.maximum.accumulate(to[order])])
                    ask = ask[till[np.searchsorted(lo[order], ask, "right")] < ask + MIN_WORDS]
                if len(p):
                    run = _grams(word, MIN_WORDS)[p].view(np.int64)
                    use = np.isin(p, ask)  # and of each run its first place, which may be the first holder
                    use[np.unique(run, return_index=True)[1]] = True
                    p, run = p[use], run[use]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(run), pa.array(np.full(len(p), doc)),
                         pa.array(np.full(len(p), tag)), pa.array(p.astype(np.int32)), pa.array(np.isin(p, ask))],
                        names=["run", "doc", "tag", "x", "ask"])

    grams = written(todo.mapInArrow(runs, "run long, doc long, tag long, x int, ask boolean"), "grams")
    first = grams.groupBy("run").agg(F.min(F.struct("doc", "tag", "x")).alias("f"))
    hits = grams.where("ask").join(first, "run").where(F.struct("doc", "tag", "x") > F.col("f"))
    near = F.expr(f"doc = f.doc and tag = f.tag and x - f.x < {WINDOW}")
    rest = written(hits.where(~near).select("doc", "tag", F.col("f.doc").alias("src"), F.col("f.tag").alias("src_tag"), "x",
                                            F.col("f.x").alias("y")), "rest")
    discard(left, grams)
    return rest


def _aligned(src: DataFrame, chains: DataFrame) -> DataFrame:
    """Passages along the chains, which go."""
    cut = _cut_table(src, chains)
    discard(chains)
    found = _found_table(cut)
    discard(cut)
    return found


def _chain_table(hits: DataFrame) -> DataFrame:
    """Chains of matches, with the ranges of words that are cut for them."""
    chains = hits.repartition("doc", "tag").sortWithinPartitions(*KEYS, "x", "y").mapInArrow(_chain, CHAIN)
    low = lambda c: F.greatest(F.col(c)[0] - MARGIN, F.lit(0))
    high = lambda c: F.element_at(c, -1) + K + MARGIN
    return written(chains.select("*", low("xs").alias("x0"), high("xs").alias("x1"), low("ys").alias("y0"),
                                 high("ys").alias("y1")), "chains")


TEXT, RANGE, OWN = 0, 1, 2
CUT = ("doc long, tag long, part int, lo int, hi int, src long, src_tag long, y0 int, y1 int, xs array<int>, ys array<int>, "
       "words binary")


def _cut_table(src: DataFrame, chains: DataFrame) -> DataFrame:
    """Two kinds of rows: a chain (``OWN``) with the words around it in its document,
    and every range of a source that chains need (``RANGE``), once, with its words. The
    rows of a document come behind its text, so a text is moved and split once."""
    part = lambda n: F.lit(n).alias("part")
    texts = src.select("doc", "tag", part(TEXT), "text")
    ranges = chains.select(F.col("src").alias("doc"), F.col("src_tag").alias("tag"), part(RANGE), F.col("y0").alias("lo"),
                           F.col("y1").alias("hi")).distinct()
    own = chains.select("doc", "tag", part(OWN), F.col("x0").alias("lo"), F.col("x1").alias("hi"), "src", "src_tag", "y0", "y1",
                        "xs", "ys")
    rows = own.unionByName(ranges, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)

    def cut(batches):
        import pyarrow as pa
        text, words = None, None
        for b in batches:
            out = []
            for p, lo, hi, t in zip(*[b.column(c).to_pylist() for c in ("part", "lo", "hi", "text")]):
                if p == TEXT:
                    text, words = t, None
                    continue
                if words is None:
                    words = words_of(text)
                out.append(b" ".join(words[lo:hi]))
            if out:
                kept = b.filter(pa.array(b.column("part").to_numpy() != TEXT))
                yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in kept.schema.names if c != "text"],
                                                  pa.array(out, pa.binary())],
                                                 names=[*[c for c in kept.schema.names if c != "text"], "words"])

    return written(rows.repartition("doc", "tag").sortWithinPartitions("doc", "tag", "part").mapInArrow(cut, CUT), "cut")


def _found_table(cut: DataFrame) -> DataFrame:
    """Passages along the chains."""
    own = cut.where(F.col("part") == OWN).select("doc", "tag", F.col("lo").alias("x0"), "src", "src_tag", "y0", "y1", "xs", "ys",
                                                 F.col("words").alias("a"))
    ranges = cut.where(F.col("part") == RANGE).select(F.col("doc").alias("src"), F.col("tag").alias("src_tag"),
                                                      F.col("lo").alias("y0"), F.col("hi").alias("y1"), F.col("words").alias("b"))
    need = math.ceil(SIMILARITY * MIN_WORDS - 1e-9)

    def aligned(batches):
        import pyarrow as pa
        for f in batches:
            out = []
            xs, ys = f.column("xs"), f.column("ys")
            for i, (left, right) in enumerate(zip(f.column("a").to_pylist(), f.column("b").to_pylist())):
                a, b = left.split(b" "), right.split(b" ")
                if hopeless(a, b, need):
                    continue
                doc, tag, x0, src, src_tag, y0 = [f.column(c)[i].as_py() for c in ("doc", "tag", "x0", "src", "src_tag", "y0")]
                for a0, a1, b0, b1, alike in align(a, b, [v - x0 for v in xs[i].as_py()], [v - y0 for v in ys[i].as_py()]):
                    out.append((doc, tag, a0 + x0, a1 + x0, src, b0 + y0, b1 + y0, alike))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, kind) for v, kind in zip(zip(*out), kinds)],
                    names=["doc", "tag", "first_word", "end_word", "src", "source_first_word", "source_end_word", "similarity"])

    return written(own.join(ranges, ["src", "src_tag", "y0", "y1"])
                   .mapInArrow(aligned, "doc long, tag long, first_word int, end_word int, src long, source_first_word int, "
                                        "source_end_word int, similarity double").distinct(), "found")
