"""Token counts by a unigram model, with dynamic programming over a trie.

The pieces are those of a public byte-level vocabulary; a piece's log probability
follows from its published rank by Zipf's law (nothing is trained). A pre-token's
tokens are its most probable cutting into pieces; of equally probable ones that
with fewer pieces.

The distinct pre-tokens of a batch, sorted, are the depth-first walk of their
trie: going from one to the next, the forward scores of the shared prefix are
there already, and only the new suffix is computed. The count at the end of a
pre-token is stored and looked up from then on by every text of the worker.
Texts with code points that Python's Unicode tables do not know are cut by the
published pattern itself.
"""
from __future__ import annotations

import base64
import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .pretokens import Cut

CACHE = 2_000_000
BATCH_CHARS = 1 << 19


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(1)
def _pattern():
    import public_tokenizers
    import regex
    return regex.compile(public_tokenizers.PATTERN)


def load_pieces(path: str) -> dict[bytes, float]:
    """Log probability of each piece: Zipf's law over the ranks of the file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {p: -math.log(r + 1) - total for p, r in ranks.items()}


def trie_counts(words: list[bytes], pieces: dict[bytes, float], longest: int) -> list[int]:
    """Tokens of each of the sorted, distinct words."""
    score, count, out, last = [0.0], [0], [], b""
    none = -math.inf
    for word in words:
        shared = 0
        for a, b in zip(last, word):
            if a != b:
                break
            shared += 1
        del score[shared + 1:]
        del count[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            best, least = none, 0
            for begin in range(max(0, end - longest), end):
                p = pieces.get(word[begin:end])
                if p is not None:
                    s = score[begin] + p
                    c = count[begin] + 1
                    if s > best or (s == best and c < least):
                        best, least = s, c
            score.append(best)
            count.append(least)
        out.append(count[len(word)])
        last = word
    return out


class Counter:
    def __init__(self, path: str) -> None:
        self.pieces = load_pieces(path)
        self.longest = max(map(len, self.pieces))
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.tokens = np.zeros(0, np.int64)

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pre-tokens, tokens) of each text."""
        cut = Cut(texts)
        if cut.odd.any():
            return self._split(texts, cut.odd)
        if len(self.keys) > CACHE:
            self._clear()
        key, where, back = np.unique(cut.key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == key
        if not known.all():
            words = [w.encode("utf-8", "surrogatepass") for w in cut.strings(where[~known])]
            order = sorted(range(len(words)), key=words.__getitem__)
            tokens = np.zeros(len(words), np.int64)
            tokens[order] = trie_counts([words[i] for i in order], self.pieces, self.longest)
            self.keys = np.insert(self.keys, at[~known], key[~known])
            self.tokens = np.insert(self.tokens, at[~known], tokens)
            at = np.searchsorted(self.keys, key)
        total = np.concatenate([[0], np.cumsum(self.tokens[at[back]])])
        return np.diff(cut.bounds), np.diff(total[cut.bounds])

    def _split(self, texts: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with unknown code points are cut by the pattern."""
        pre, tok = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        pre[~odd], tok[~odd] = self.count([t for t, o in zip(texts, odd) if not o])
        for i in np.flatnonzero(odd).tolist():
            words = [w.encode("utf-8", "surrogatepass") for w in _pattern().findall(texts[i])]
            distinct = sorted(set(words))
            of = dict(zip(distinct, trie_counts(distinct, self.pieces, self.longest)))
            pre[i], tok[i] = len(words), sum(of[w] for w in words)
        return pre, tok


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: doc_id) plus n_chars, n_pretokens and n_tokens
    of every document. Null and empty texts have none; repeated rows are counted
    each; other columns are not looked at. The vocabulary holds all 256 bytes,
    so every text can be cut."""
    keep = keep or ["doc_id"]
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    src = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text"))
    names = ["n_chars", "n_pretokens", "n_tokens"]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, T.LongType()) for n in names])

    def run(batches):
        import pyarrow as pa
        own = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            pre, tok = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            i = 0
            while i < len(texts):
                j, n = i, 0
                while j < len(texts) and (j == i or n < BATCH_CHARS):
                    n += len(texts[j])
                    j += 1
                p, t = own.count(texts[i:j])
                pre.append(p)
                tok.append(t)
                i = j
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(b.num_columns - 1)]
                + [pa.array([len(t) for t in texts], pa.int64()), pa.array(np.concatenate(pre)), pa.array(np.concatenate(tok))],
                names=[*keep, *names])

    return src.mapInArrow(run, schema)
