"""Token ids of whole texts by a byte-level BPE file of the tokenizers library.

A text's ids are the ids of its pre-tokens in a row, so each distinct pre-token
is encoded by the library once per worker and looked up from then on. A text that
holds the string of an added token (such as ``<|endoftext|>``), which the library
cuts out before it looks for pre-tokens, goes to the library as it is.
"""
from __future__ import annotations

import itertools
import os

import numpy as np

from .pretokens import Cut

#: Distinct pre-tokens kept by a worker, and characters cut at once.
CACHE = 2_000_000
BATCH_CHARS = 1 << 19


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # The same model for single pre-tokens, which need no cutting.
        self.single = Tokenizer.from_file(path)
        self.single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() < 1 << 16 else np.uint32)
        self.used = 0

    def _learn(self, at: np.ndarray, keys: np.ndarray, strings: list[str]) -> None:
        """Add pre-tokens before the places ``at`` of the sorted keys."""
        ids = [e.ids for e in self.single.encode_batch_fast(strings, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(n.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), self.flat.dtype, total)
        self.keys = np.insert(self.keys, at, keys)
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(n) - n)
        self.size = np.insert(self.size, at, n)
        self.used += total

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        out, sizes = [np.zeros(0, self.flat.dtype)], [np.zeros(0, np.int64)]
        i = 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n < BATCH_CHARS):
                n += len(texts[j] or "")
                j += 1
            ids, size = self._encode([t or "" for t in texts[i:j]])
            out.append(ids)
            sizes.append(size)
            i = j
        return np.concatenate(out), np.concatenate(sizes)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = Cut(texts)
        odd = cut.odd | np.array([any(a in t for a in self.added) for t in texts], bool)
        if odd.any():
            return self._split(texts, odd)
        if len(self.keys) > CACHE:
            self._clear()
        key, where, back = np.unique(cut.key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == key
        if not known.all():
            self._learn(at[~known], key[~known], cut.strings(where[~known]))
            at = np.searchsorted(self.keys, key)
        slot = at[back]
        n = self.size[slot]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.arange(int(total[-1])) + np.repeat(self.begin[slot] - total[:-1], n)]
        return ids, np.diff(total[cut.bounds])

    def _split(self, texts: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with unknown code points or added tokens go to the library as they are."""
        out, sizes = [], []
        for t, o in zip(texts, odd):
            if o:
                ids = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.flat.dtype)
                out.append(ids)
                sizes.append(len(ids))
            else:
                ids, n = self._encode([t])
                out.append(ids)
                sizes.append(int(n[0]))
        return np.concatenate(out), np.array(sizes, np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
