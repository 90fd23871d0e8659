"""Language identification by cross-parsing entropy.

One suffix automaton per language is built from labelled text. A text is cut
into phrases against each automaton: the longest match of the rest of the text
that occurs in the language's sample, again and again. The language that needs
the fewest phrases per letter position wins.

Text is normalised to lower-case letters with single spaces between words; the
alphabet is all letters of the samples, every other letter is one foreign symbol
that no sample holds.

Following the transitions of a suffix automaton greedily is a finite-state
machine: a missing transition ends the phrase and starts the next one at the
root. The machine is one table per language over the letters of its own sample
(for many letters, only the transitions that exist), so all texts of a batch
advance together, one symbol a step. Texts are laid in rows of ``SEGMENT`` symbols; a
row starts at the root, which adds at most one phrase per row and language.
"""
from __future__ import annotations

import sys
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

SEGMENT = 256
#: A machine of more cells than this keeps its transitions as a sorted list.
DENSE_CELLS = 1 << 25
#: Bounds of the labelled sample the models are fitted on (documented
#: parameters): documents per language, and characters per document.
SAMPLE_DOCS = 60
SAMPLE_CHARS = 1000
UNKNOWN = "und"
#: Best-language phrases per symbol above this are no language of the sample.
MAX_PHRASE_RATE = 0.6


class SuffixAutomaton:
    """Minimal automaton of all substrings of a symbol sequence."""

    def __init__(self, symbols) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        last = 0
        for c in symbols:
            cur = self._state(self.length[last] + 1, {}, -1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][c]
                if self.length[q] == self.length[p] + 1:
                    self.link[cur] = q
                else:
                    twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            last = cur

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def machine(self) -> Machine:
        return Machine(self)


class Machine:
    """Steps of an automaton: from (state, column) to next state * 4 + number of
    phrases that ended. ``letters`` are its symbols in order; column 0 is padding:
    it leads to the root and ends nothing; columns 1.. are the letters; the last
    one is any symbol unknown to the sample, a phrase of its own."""

    def __init__(self, automaton: SuffixAutomaton) -> None:
        self.letters = sorted(automaton.next[0])
        column = {c: i + 1 for i, c in enumerate(self.letters)}
        self.width = len(column) + 2
        links = [(s * self.width + column[c], q * 4) for s, nxt in enumerate(automaton.next) for c, q in nxt.items()]
        keys, steps = np.array(links, np.int64).reshape(-1, 2).T
        # Without a transition the phrase ends and the letter starts the next one.
        self.default = np.zeros(self.width, np.int32)
        for c, q in automaton.next[0].items():
            self.default[column[c]] = q * 4 + 1
        self.default[-1] = 2
        self.cells = None
        if len(automaton.next) * self.width <= DENSE_CELLS:
            self.cells = np.tile(self.default, len(automaton.next))
            self.cells[self.width - 1] = 1
            self.cells[keys] = steps
        else:
            order = np.argsort(keys)
            self.keys, self.steps = keys[order], steps[order].astype(np.int32)

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        if self.cells is not None:
            return self.cells[state * self.width + column]
        key = state.astype(np.int64) * self.width + column
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out = np.where(self.keys[at] == key, self.steps[at], self.default[column])
        return out - ((state == 0) & (column == self.width - 1)).astype(np.int32)


_LETTER: np.ndarray | None = None
_MARK: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Lower-case code point of each letter, a combining mark as it is, 32 for
    everything else."""
    global _LETTER
    if _LETTER is None:
        t = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if unicodedata.category(ch)[0] in "LM":
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _LETTER = t
    return _LETTER


def _mark_table() -> np.ndarray:
    """Combining marks: symbols of a text, but no letters."""
    global _MARK
    if _MARK is None:
        _MARK = np.array([unicodedata.category(chr(c))[0] == "M" for c in range(sys.maxunicode + 1)])
    return _MARK


def normalise(text: str | None) -> np.ndarray:
    """Code points of the text's letters, lower-cased, words apart by single
    spaces, without outer spaces. Empty when there is no letter."""
    if not text:
        return np.zeros(0, np.uint32)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _fold_table()[cp]
    space = low == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    out = low[keep]
    return out[:-1] if len(out) and out[-1] == 32 else out


def normalise_batch(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts normalised, one after another, and the length of each."""
    raw = ["" if t is None else t for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    cp = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _fold_table()[cp]
    letter = low != 32
    ends = np.cumsum(lengths)
    first = (ends - lengths)[lengths > 0]
    # A space is kept when a letter stands before it in the same text ...
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[first] = letter[first]
    kept = np.concatenate([[0], np.cumsum(keep)])
    size = kept[ends] - kept[ends - lengths]
    out = low[keep]
    # ... and a final one goes.
    tail = np.cumsum(size)[size > 0] - 1
    drop = tail[out[tail] == 32]
    of = np.repeat(np.arange(len(size)), size)
    size = size - np.bincount(of[drop], minlength=len(size)) if len(drop) else size
    return np.delete(out, drop), size


class Model:
    """Machines of all languages over one alphabet. Only the samples travel;
    each worker builds the machines from them once."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.languages = sorted(samples)
        self.samples = samples
        self._tables: list[Machine] | None = None
        self._map: np.ndarray | None = None

    def __getstate__(self):
        return {"languages": self.languages, "samples": self.samples, "_tables": None, "_map": None}

    @property
    def tables(self) -> list[Machine]:
        if self._tables is None:
            self._build(self.samples)
        return self._tables

    def _build(self, samples: dict[str, list[str]]) -> None:
        texts = {k: [normalise(t) for t in v] for k, v in samples.items()}
        points = np.concatenate([np.zeros(0, np.uint32), *[x for v in texts.values() for x in v]])
        #: 0 padding, 1.. the alphabet (with the space that ends each text), last:
        #: letters outside of it
        alphabet = np.union1d(points, np.array([32], np.uint32))
        self.n_symbols = len(alphabet) + 2
        self._map = np.full(sys.maxunicode + 1, self.n_symbols - 1, np.min_scalar_type(self.n_symbols - 1))
        self._map[alphabet] = np.arange(1, len(alphabet) + 1)
        self._tables = []
        for lang in self.languages:
            line: list[int] = []
            for x in texts[lang]:
                line += self.encode(x).tolist() + [int(self._map[32])]
            self._tables.append(SuffixAutomaton(line).machine())

    def encode(self, points: np.ndarray) -> np.ndarray:
        return self._map[points]

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases of each text in each language, symbols of each text)."""
        points, size = normalise_batch(texts)
        return self._count(points, size), size

    def _count(self, points: np.ndarray, size: np.ndarray) -> np.ndarray:
        tables = self.tables
        rows = -(-size // SEGMENT)
        total = int(rows.sum())
        flat = np.zeros(total * SEGMENT, self._map.dtype)
        begin = (np.cumsum(rows) - rows) * SEGMENT
        shift = begin - (np.cumsum(size) - size)
        flat[np.arange(len(points)) + np.repeat(shift, size)] = self.encode(points)
        steps = np.ascontiguousarray(flat.reshape(total, SEGMENT).T)
        out = np.zeros((len(size), len(tables)), np.int64)
        of = np.repeat(np.arange(len(size)), rows)
        for k, table in enumerate(tables):
            column = np.full(self.n_symbols, table.width - 1, np.min_scalar_type(table.width - 1))
            column[0] = 0
            column[table.letters] = np.arange(1, table.width - 1)
            state = np.zeros(total, np.int32)
            count = np.zeros(total, np.int32)
            for c in steps:
                step = table.step(state, column[c])
                count += step & 3
                state = step >> 2
            out[:, k] = np.bincount(of, count, minlength=len(size)).astype(np.int64)
        # The phrase still open at the end of a row counts as one.
        return out + rows[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, closed phrases per symbol). The score is the margin
        between the best and the second language, relative to the second; 1
        with one language; 0 for ``und``. Ties go to the first by code point."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        points, size = normalise_batch(texts)
        counts = self._count(points, size)
        best = counts.argmin(axis=1)
        low = counts[np.arange(len(texts)), best]
        if counts.shape[1] > 1:
            second = np.partition(counts, 1, axis=1)[:, 1]
            score = 1 - low / np.maximum(second, 1)
        else:
            score = np.ones(len(texts))
        letter = ~(_mark_table()[points] | (points == 32))
        blank = np.bincount(np.repeat(np.arange(len(size)), size)[letter], minlength=len(size)) == 0
        score = np.where(blank, 0.0, score)
        rate = np.where(blank, 0.0, (low - -(-size // SEGMENT)) / np.maximum(size, 1))
        return [UNKNOWN if b else self.languages[i] for b, i in zip(blank, best)], score, rate


def held_out(doc_id):
    """Column: crc32 of the id as text, mod 3, is 1 (null: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most ``sample_docs`` documents a language (those of smallest
    hashed id among the rows with a lang that are not held out), each cut to
    ``sample_chars`` characters. The languages are the distinct lang values, a
    small set of classes; only this bounded sample reaches the driver."""
    rank = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id")), "doc_id", "text")
    rows = (docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
            .select("lang", "doc_id", F.substring("text", 1, sample_chars).alias("text"))
            .where(F.col("text").rlike(r"\p{L}"))
            .withColumn("__rank", F.row_number().over(rank)).where(F.col("__rank") <= sample_docs).collect())
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["__rank"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return Model(samples)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: doc_id) plus lang_pred, score (0 to 1) and
    phrase_rate (phrases closed per symbol in the predicted language).

    A text that is null or has no letter (combining marks alone are none) is
    ``und`` with score 0. Repeated rows are judged each, ties go to the first
    language by code point, an empty table gives none. With nothing
    to learn from, every text is ``und``. Only the text is looked at.
    """
    keep = keep or ["doc_id"]
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text"))
    schema = T.StructType([docs.schema[c] for c in keep] + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("phrase_rate", T.DoubleType())])
    names = [f.name for f in schema]

    def run(batches):
        import pyarrow as pa
        m = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            # Bounded work memory: texts of about half a million characters at once.
            lang: list[str] = []
            score, rate = [np.zeros(0)], [np.zeros(0)]
            i = 0
            while i < len(texts):
                j, n = i, 0
                while j < len(texts) and (j == i or n < 1 << 19):
                    n += len(texts[j] or "")
                    j += 1
                a, s, r = m.predict(texts[i:j])
                lang += a
                score.append(s)
                rate.append(r)
                i = j
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(b.num_columns - 1)]
                + [pa.array(lang, pa.string()), pa.array(np.concatenate(score)), pa.array(np.concatenate(rate))],
                names=names)

    return src.mapInArrow(run, schema)


def known_language_only(docs: DataFrame, max_phrase_rate: float = MAX_PHRASE_RATE) -> DataFrame:
    """``docs`` without the rows that are rejected: no letter, or text so unlike
    every language of the sample that its phrases are shorter than
    1 / ``max_phrase_rate`` symbols on average. Null and empty texts go; repeated
    rows stay or go together; columns of any name and type are kept as they are.
    Without labelled rows nothing is recognised and all rows go."""
    names = {c: f"__doc{i}" for i, c in enumerate(docs.columns)}  # free of clashes with the answers
    src = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("text"))
    out = identify(src, fit(docs), keep=list(names.values()))
    return (out.where((F.col("lang_pred") != UNKNOWN) & (F.col("phrase_rate") <= max_phrase_rate))
            .select(*[F.col(n).alias(c) for c, n in names.items()]))
