"""Re-Pair grammar compression of token ids, one grammar a shard.

Frequent pairs of neighbouring symbols are replaced by new symbols
(nonterminals), round after round: a round counts all pairs exactly, takes the
most frequent ones, and replaces their occurrences from the most frequent pair
down, without overlap. Rounds end when no pair occurs ``MIN_COUNT`` times or no
new symbol is left. Pairs never span two documents, so each document is a run of
symbols of its own. Stored are the rules, the expansion length of each rule and
the place of each document: ``ShardFile`` decodes one document, or some ids of it,
from the bytes of its symbols alone.

File: ``RPID`` magic, then little-endian int64 header (version, vocabulary size,
rules, levels, documents, symbols, bytes a symbol), then the arrays
rules (2 symbols each), expansion lengths (uint32), first rule of each level
(int64), doc ids (int64), null flags of the doc ids (uint8), end of each document
in ids (int64) and in symbols (int64), and the symbols.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np

MAGIC = b"RPID"
VERSION = 2
#: New symbols a round, occurrences a pair must have, ids an expansion may have.
PAIRS_A_ROUND = 3072
MIN_COUNT = 8
MAX_EXPANSION = 4096
_HASH_BITS = 18
_HEAD = len(MAGIC) + 7 * 8


def compress(ids: np.ndarray, doc_sizes: np.ndarray, vocabulary: int, pairs_a_round: int = PAIRS_A_ROUND,
             min_count: int = MIN_COUNT) -> dict[str, np.ndarray]:
    """Grammar of ``ids`` (documents one after another, ``doc_sizes`` ids each)."""
    room = (1 << 16) - vocabulary if vocabulary < 1 << 16 else 1 << 20
    kind = np.uint16 if vocabulary < 1 << 16 else np.uint32
    seq = ids.astype(np.uint32)
    sizes = doc_sizes.astype(np.int64)
    rules = np.zeros((0, 2), np.uint32)
    length = np.ones(vocabulary + max(room, 0), np.uint32)
    levels = []
    while True:
        new, seq, sizes = _round(seq, sizes, vocabulary + len(rules), room - len(rules), pairs_a_round, min_count, length,
                                 16 if kind is np.uint16 else 32)
        if not len(new):
            break
        levels.append(len(rules))
        rules = np.concatenate([rules, new])
    used = length[vocabulary:vocabulary + len(rules)]
    return {"rules": rules.astype(kind), "lengths": used.copy(), "levels": np.array(levels, np.int64),
            "doc_sizes": doc_sizes.astype(np.int64), "doc_symbols": sizes, "symbols": seq.astype(kind)}


def _frequent(code: np.ndarray, shift: int, most: int, min_count: int, length: np.ndarray) -> np.ndarray:
    """The most frequent pairs, ``most`` at most, the most frequent first."""
    s = np.sort(code)
    begin = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
    count = np.diff(np.append(begin, len(s)))
    often = count >= min_count
    pair, count = s[begin[often]], count[often]
    short = length[pair >> shift] + length[pair & ((1 << shift) - 1)] <= MAX_EXPANSION
    pair, count = pair[short], count[short]
    return pair[np.lexsort((pair, -count))][:most]


def _round(seq, sizes, base, room, most, min_count, length, shift):
    """One round: (new rules, sequence, symbols of each document)."""
    none = np.zeros((0, 2), np.uint32)
    n = len(seq)
    if n < 2 or room < 1:
        return none, seq, sizes
    ends = np.cumsum(sizes)
    wide = np.uint32 if shift == 16 else np.uint64
    code = seq[:-1].astype(wide) << wide(shift) | seq[1:].astype(wide)
    one = np.ones(n - 1, bool)
    one[ends[(ends > 0) & (ends < n)] - 1] = False  # a pair there would span two documents
    best = _frequent(code[one], shift, most, min_count, length)
    if not len(best):
        return none, seq, sizes
    # Places of the chosen pairs by a hash table; of pairs with one slot the most
    # frequent one is placed, the others wait for the next round.
    mix = lambda c: (c ^ c >> wide(shift - 3)).astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(32 - _HASH_BITS)
    slot = np.full(1 << _HASH_BITS, -1, np.int32)
    slot[mix(best)[::-1]] = np.arange(len(best), dtype=np.int32)[::-1]
    r = slot[mix(code)]
    at = np.flatnonzero((r >= 0) & one)
    r = r[at]
    live = best[r] == code[at]
    at, r = at[live], r[live]
    # In a run of one symbol every other pair counts.
    twin = np.zeros(len(at), bool)
    twin[1:] = (at[1:] == at[:-1] + 1) & (r[1:] == r[:-1])
    place = np.arange(len(at))
    run = np.maximum.accumulate(np.where(twin, 0, place))
    even = (place - run) & 1 == 0
    at, r = at[even], r[even]
    # Of overlapping pairs the more frequent one wins.
    touch = at[1:] == at[:-1] + 1
    win = np.ones(len(at), bool)
    win[1:] &= ~touch | (r[1:] < r[:-1])
    win[:-1] &= ~touch | (r[:-1] <= r[1:])
    at, r = at[win], r[win]
    # A rule used less often than that costs more than it saves. Of the others those
    # of the most frequent pairs take what room is left.
    good = np.bincount(r, minlength=len(best)) >= max(2, min_count // 2)
    number = np.cumsum(good) - 1
    good &= number < room
    pick = good[r]
    at, r = at[pick], r[pick]
    pair = best[good]
    new = np.stack([pair >> wide(shift), pair & wide((1 << shift) - 1)], axis=1).astype(np.uint32)
    if not len(new):
        return none, seq, sizes
    length[base:base + len(new)] = length[new[:, 0]] + length[new[:, 1]]
    seq = seq.copy()
    seq[at] = (base + number[r]).astype(np.uint32)
    stay = np.ones(n, bool)
    stay[at + 1] = False
    lost = np.searchsorted(at, ends)
    return new, seq[stay], sizes - np.diff(np.concatenate([[0], lost]))


class Grammar:
    """Expands symbols of one shard."""

    def __init__(self, part: dict[str, np.ndarray], vocabulary: int) -> None:
        self.vocabulary = vocabulary
        rules, length = part["rules"].astype(np.int64), part["lengths"].astype(np.int64)
        self.size = np.concatenate([np.ones(vocabulary, np.int64), length])
        self.at = np.concatenate([np.arange(vocabulary), vocabulary + np.cumsum(length) - length])
        self.flat = np.empty(vocabulary + int(length.sum()), np.uint32)
        self.flat[:vocabulary] = np.arange(vocabulary)
        edges = [*part["levels"].tolist(), len(rules)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            first = int(self.at[vocabulary + lo])
            ids = self.expand(rules[lo:hi].ravel())
            self.flat[first:first + len(ids)] = ids

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        n = self.size[symbols]
        total = np.cumsum(n)
        if not len(n):
            return np.zeros(0, np.uint32)
        return self.flat[np.arange(int(total[-1])) + np.repeat(self.at[symbols] - total + n, n)]


def _arrays(rules: int, levels: int, docs: int, symbols: int, width: int) -> list[tuple[str, str, int]]:
    kind = f"<u{width}"
    return [("rules", kind, 2 * rules), ("lengths", "<u4", rules), ("levels", "<i8", levels), ("doc_ids", "<i8", docs),
            ("nulls", "u1", docs), ("id_ends", "<i8", docs), ("symbol_ends", "<i8", docs), ("symbols", kind, symbols)]


def _header(data: bytes) -> list[int]:
    if data[:4] != MAGIC:
        raise ValueError("not a token shard")
    version, *rest = np.frombuffer(data, "<i8", 7, 4).tolist()
    if version != VERSION:
        raise ValueError(f"token shard of version {version}")
    return rest


def dump(part: dict[str, np.ndarray], vocabulary: int, doc_ids: np.ndarray, nulls: np.ndarray) -> bytes:
    head = np.array([VERSION, vocabulary, len(part["rules"]), len(part["levels"]), len(part["doc_sizes"]),
                     len(part["symbols"]), part["symbols"].dtype.itemsize], "<i8")
    arrays = [head, part["rules"], part["lengths"], part["levels"], doc_ids.astype("<i8"), nulls.astype(np.uint8),
              np.cumsum(part["doc_sizes"], dtype="<i8"), np.cumsum(part["doc_symbols"], dtype="<i8"), part["symbols"]]
    return MAGIC + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def load(data: bytes) -> dict:
    """A whole shard; ``doc_sizes`` and ``doc_symbols`` are ids and symbols of each document."""
    vocabulary, *shape = _header(data)
    at, out = _HEAD, {"vocabulary": vocabulary}
    for name, dtype, n in _arrays(*shape):
        out[name] = np.frombuffer(data, dtype, n, at)
        at += out[name].nbytes
    out["rules"] = out["rules"].reshape(-1, 2)
    out["doc_sizes"] = np.diff(out["id_ends"], prepend=0)
    out["doc_symbols"] = np.diff(out["symbol_ends"], prepend=0)
    return out


class ShardFile:
    """A shard read by byte ranges: the rules once, then of each wanted document its
    place and the bytes of its symbols. ``read(begin, size)`` gives bytes of the file."""

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        self._read = read
        self.vocabulary, *shape = _header(read(0, _HEAD))
        self.n_docs = shape[2]
        self._place, at = {}, _HEAD
        for name, dtype, n in _arrays(*shape):
            self._place[name] = at, np.dtype(dtype)
            at += n * np.dtype(dtype).itemsize
        self._rules = self._some("rules", 0, 2 * shape[0]).reshape(-1, 2).astype(np.int64)
        self._size = self._some("lengths", 0, shape[0]).astype(np.int64)

    def _some(self, name: str, begin: int, end: int) -> np.ndarray:
        at, dtype = self._place[name]
        if end <= begin:
            return np.zeros(0, dtype)
        return np.frombuffer(self._read(at + begin * dtype.itemsize, (end - begin) * dtype.itemsize), dtype)

    def document(self, k: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids of the k-th document, or those from ``begin`` to before ``end``."""
        if not 0 <= k < self.n_docs:
            raise IndexError(f"document {k} of {self.n_docs}")
        lo, hi = [0, *self._some("symbol_ends", max(k - 1, 0), k + 1).tolist()][-2:]
        symbols = self._some("symbols", lo, hi).astype(np.int64)
        rule = symbols >= self.vocabulary
        size = np.ones(len(symbols), np.int64)
        size[rule] = self._size[symbols[rule] - self.vocabulary]
        total = np.cumsum(size)
        n = int(total[-1]) if len(total) else 0
        begin, end = min(max(begin, 0), n), n if end is None else min(end, n)
        if end <= begin:
            return np.zeros(0, np.uint32)
        # Only the symbols whose expansions meet the wanted ids are opened.
        i, j = np.searchsorted(total, begin, "right"), np.searchsorted(total, end, "left") + 1
        before = int(total[i] - size[i])
        return self._unfold(symbols[i:j])[begin - before:end - before].astype(np.uint32)

    def _unfold(self, symbols: np.ndarray) -> np.ndarray:
        while (rule := symbols >= self.vocabulary).any():
            width = 1 + rule
            first = (np.cumsum(width) - width)[rule]
            pair = self._rules[symbols[rule] - self.vocabulary]
            symbols = np.repeat(symbols, width)
            symbols[first], symbols[first + 1] = pair[:, 0], pair[:, 1]
        return symbols
