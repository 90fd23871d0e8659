"""Benchmark decontamination with one Aho-Corasick automaton.

Item texts are normalised to words and cut into windows of ``WINDOW`` words;
all windows are the patterns of one automaton. Each document is normalised the
same way and scanned once; hits are mapped to word numbers and to character
offsets of the original text.

Normalising works on UTF-8 bytes: A-Z lower-cased, words are the runs of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (digits, a-z and everything outside ASCII),
one space between words. The automaton sees bytes as Latin-1 characters.

The automaton is broadcast behind a bound: windows are dealt into blocks of at
most ``BLOCK_WINDOWS``, by hash, and each block is one automaton and one pass
over the documents, whose marks are carried along in a written table. A
benchmark of usual size is one block.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written

WINDOW = 10
#: Windows in one automaton: about 60 bytes each, some 100 MB as a trie.
BLOCK_WINDOWS = 50_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def windows_of(text: str | None, window: int = WINDOW) -> list[str]:
    """Distinct windows of an item: every run of ``window`` words; an item of
    fewer words, but not none, is one window."""
    words = [w.decode("latin-1") for w in words_of(text)]
    if not words:
        return []
    n = max(1, len(words) - window + 1)
    return list(dict.fromkeys(" ".join(words[i:i + window]) for i in range(n)))


def window_table(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, n_words, items): each distinct window with the sorted distinct
    ids, as text, of the items that hold it. Rows of ``items`` with a null
    item_id still mark words but are named nowhere."""

    def run(batches):
        import pyarrow as pa
        for b in batches:
            ids, out = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = windows_of(t, window)
                ids += [i] * len(w)
                out += w
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string())],
                                             names=["item", "window"])

    return (items.select(F.col("item_id").cast("string").alias("item"), "text")
            .mapInArrow(run, "item string, window string")
            .groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
            .withColumn("n_words", F.size(F.split("window", " "))))


class Scanner:
    """Automaton over a block of windows."""

    def __init__(self, rows: list[tuple[str, int, list[str]]]) -> None:
        self.rows = rows
        self.automaton = None

    def __getstate__(self):
        return {"rows": self.rows, "automaton": None}

    def build(self) -> None:
        import ahocorasick
        a = ahocorasick.Automaton()
        for k, (window, _, _) in enumerate(self.rows):
            a.add_word(f" {window} ", k)
        if self.rows:
            a.make_automaton()
        self.automaton = a

    def scan(self, text: str | None) -> tuple[int, np.ndarray, list[str]]:
        """(words of the text, numbers of the hit words, items found)."""
        if self.automaton is None:
            self.build()
        words = words_of(text)
        none = np.zeros(0, np.int64)
        if not words or not self.rows:
            return len(words), none, []
        line = b" " + b" ".join(words) + b" "
        hits = list(self.automaton.iter(line.decode("latin-1")))
        if not hits:
            return len(words), none, []
        end, pattern = (np.array(x, np.int64) for x in zip(*hits))
        # The blank that ends a hit is the one after its last word.
        last = np.searchsorted(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), end) - 1
        size = np.array([self.rows[k][1] for k in pattern.tolist()], np.int64)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, last - size + 1, 1)
        np.add.at(edge, last + 1, -1)
        items = {i for k in set(pattern.tolist()) for i in self.rows[k][2]}
        return len(words), np.flatnonzero(np.cumsum(edge[:-1]) > 0), sorted(items)


def spans_of(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Code-point spans (end exclusive) of runs of hit words in the original."""
    raw = text.encode("utf-8", "surrogatepass")
    word = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = np.flatnonzero(np.diff(hit) > 1)
    lo, hi = hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])]
    # Code points before each byte offset.
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(a), "end": int(b)} for a, b in zip(chars[first[lo]], chars[last[hi]])]


MARKS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.IntegerType())),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                                     T.StructField("end", T.LongType())])))])


def _pass(docs: DataFrame, rows: list, keep: list[str], first: bool, last: bool) -> DataFrame:
    """Mark the documents with one block. ``docs`` has keep, __text and, after
    the first pass, __marks."""
    import pyarrow as pa
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rows))
    out = T.StructType([docs.schema[c] for c in keep] + ([] if last else [T.StructField("__text", T.StringType())])
                       + [T.StructField("__marks", MARKS)])

    def run(batches):
        scanner = shared.value
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            before = [None] * len(texts) if first else b.column(len(keep) + 1).to_pylist()
            marks = []
            for text, old in zip(texts, before):
                n, hit, items = scanner.scan(text)
                if old and old["hit_words"]:
                    hit = np.union1d(hit, np.array(old["hit_words"], np.int64))
                    items = sorted({*items, *old["item_ids"]})
                spans = spans_of(text, hit) if last and len(hit) else []
                marks.append({"n_words": n, "hit_words": hit.astype(np.int32), "item_ids": items, "spans": spans})
            kind = pa.struct([("n_words", pa.int64()), ("hit_words", pa.list_(pa.int32())),
                              ("item_ids", pa.list_(pa.string())),
                              ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
            keepers = [b.column(i) for i in range(len(keep) + (not last))]
            yield pa.RecordBatch.from_arrays(keepers + [pa.array(marks, kind)], names=[f.name for f in out])

    return docs.mapInArrow(run, out)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
                  keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: doc_id) of every document plus n_words, n_hit,
    item_ids (sorted as strings), spans (start and end in code points of the
    original text, end exclusive) and contaminated (n_hit > 0).

    Null or empty texts have no words; with an empty benchmark nothing is hit;
    repeated documents or items change nothing for other rows.
    """
    keep = keep or ["doc_id"]
    small_batches(docs.sparkSession)
    table = written(window_table(items, window), "windows")
    blocks = max(1, -(-table.count() // block_windows))
    state = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text"))
    for k in range(blocks):
        block = (table.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
                 .select("window", "n_words", "items").collect())
        state = _pass(state, [(r[0], r[1], list(r[2])) for r in sorted(block)], keep, k == 0, k == blocks - 1)
        if k < blocks - 1:
            state = written(state, "marks")
    m = F.col("__marks")
    return state.select(*keep, m["n_words"].alias("n_words"), F.size(m["hit_words"]).cast("long").alias("n_hit"),
                        m["item_ids"].alias("item_ids"), m["spans"].alias("spans"),
                        (F.size(m["hit_words"]) > 0).alias("contaminated"))


def clean_only(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated ones. Null and empty texts stay, and with an
    empty benchmark everything; repeated rows stay or go together; columns of any
    name and type are kept as they are."""
    names = {c: f"__doc{i}" for i, c in enumerate(docs.columns)}  # free of clashes with the marks
    src = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("text"))
    out = contamination(src, items, window, keep=list(names.values())).where(~F.col("contaminated"))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
