"""SimHash near-duplicates by anchor-point covering.

Fingerprint: words are the runs of ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z
lower-cased; each run of ``shingle`` words, joined by one space, is hashed by
XXH64 (seed 42); a bit is set when more than half of the hashes set it.

Linking: the 64 bits are cut in two halves of two parts (16 bits each), each part
read as a 23-bit word. The binary Golay code of length 23 is perfect with covering
radius 3, so every part has exactly one anchor (code word) within 3 bits, its home.
When two fingerprints differ in at most t bits, in one of the halves they differ
in e1 + e2 <= floor(t / 2) bits; then the second fingerprint lies within 3 + e1 and
3 + e2 of the homes of the first. So each fingerprint is at home at one pair of
anchors for each half, and replicated to every pair of anchors within covering
radius plus threshold (for 4 bits: 122 rows on average, whatever the data), and
all pairs within t bits meet at an anchor. 2^24 pairs of anchors a half keep the
groups small.

Only distinct fingerprints are compared, and a task hands on spanning edges,
not pairs, so copies cost one row each.
"""
from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Links, components, nested, row_key, small_batches, written

PARTS = ((0, 16), (16, 16), (32, 16), (48, 16))
HALVES = ((0, 1), (2, 3))
#: Pairs compared at once in a task; each takes some 40 bytes.
CHUNK_PAIRS = 1 << 18


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of one text (null or no words: 0)."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    first = np.concatenate([[0], gaps + 1])
    last = np.concatenate([gaps, [len(line)]])
    k = min(shingle, len(words))
    h64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((h64(line[i:j], 42) for i, j in zip(first[:len(words) - k + 1].tolist(), last[k - 1:].tolist())),
                         np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[i:i + 65536]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, __id and __hash (see ``row_key``) and ``fp`` (the fingerprint as a
    signed long) of every row of ``docs``, which needs doc_id and text."""
    small_batches(docs.sparkSession)
    src = docs.select("doc_id", *row_key(docs, ["text"]), F.col("text").alias("__text"))
    out = T.StructType([*src.schema.fields[:3], T.StructField("fp", T.LongType())])
    names = [f.name for f in out]

    def run(batches):
        import pyarrow as pa
        for b in batches:
            fp = np.fromiter((fingerprint(v.as_py(), shingle) for v in b.column(3)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(3)] + [pa.array(fp)], names=names)

    return src.mapInArrow(run, out)


# -- the Golay code ---------------------------------------------------------

@functools.lru_cache(1)
def _golay() -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(home anchor number of each 23-bit word's syndrome as an error pattern,
    code-word offsets ...) -- see ``anchors``."""
    poly = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
    syn = np.zeros(23, np.int64)  # syndrome of each single bit
    r = 1
    for i in range(23):
        syn[i] = r
        r <<= 1
        if r >> 11 & 1:
            r ^= poly
    by_syndrome: list[list[list[int]]] = [[[] for _ in range(6)] for _ in range(2048)]
    import itertools
    for w in range(6):
        for c in itertools.combinations(range(23), w):
            s = 0
            e = 0
            for i in c:
                s ^= int(syn[i])
                e |= 1 << i
            by_syndrome[s][w].append(e)
    # The unique pattern of weight <= 3 leads to the home; all patterns of
    # weight 4 (5) lead to the code words at that distance. Padded rows.
    lead = np.array([next(e for w in range(4) for e in p[w]) for p in by_syndrome], np.int64)
    four = max(len(p[4]) for p in by_syndrome)
    five = max(len(p[5]) for p in by_syndrome)
    pad = lambda w, n: np.array([p[w] + [-1] * (n - len(p[w])) for p in by_syndrome], np.int64)
    return syn, (lead[:, None], pad(4, four), pad(5, five))


def _syndromes(word: np.ndarray) -> np.ndarray:
    syn, _ = _golay()
    s = np.zeros_like(word)
    for i in range(23):
        s ^= np.where(word >> i & 1, syn[i], 0)
    return s


def anchors(fp: np.ndarray, part: int, excess: int) -> np.ndarray:
    """Code words of ``part`` for each fingerprint: the home (excess 0), or
    those at distance exactly 3 + excess (1 or 2). -1 pads the rows. The code
    word is named by its 12 high bits, which determine it."""
    at, n = PARTS[part]
    word = ((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)
    err = _golay()[1][excess][_syndromes(word)]
    return np.where(err < 0, -1, (word[:, None] ^ err) >> 11)


def _keys(c: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    key = (np.int64(c) << 24) | (left[:, :, None] << 12) | right[:, None, :]
    bad = (left[:, :, None] < 0) | (right[:, None, :] < 0)
    return np.where(bad, -1, key).reshape(len(left), -1)


def home_keys(fp: np.ndarray) -> np.ndarray:
    homes = [anchors(fp, p, 0) for p in range(len(PARTS))]
    return np.hstack([_keys(c, homes[i], homes[j]) for c, (i, j) in enumerate(HALVES)])


def replica_keys(fp: np.ndarray, max_bits: int):
    """Per half and split of the excess: the anchor pairs within covering
    radius plus threshold, without the home."""
    most = max_bits // 2
    if most > 2:
        raise ValueError("max_bits above 5 needs code words beyond distance 5")
    rings = [[anchors(fp, p, e) for e in range(most + 1)] for p in range(len(PARTS))]
    for c, (i, j) in enumerate(HALVES):
        for e1 in range(most + 1):
            for e2 in range(most + 1 - e1):
                if e1 or e2:
                    yield _keys(c, rings[i][e1], rings[j][e2])


def _replicate(max_bits: int):
    """Each fingerprint to its homes and to all pairs of anchors around."""

    def run(batches):
        for f in batches:
            for lo in range(0, len(f), 4096):
                fp = f["fp"].to_numpy()[lo:lo + 4096]
                word = fp.view(np.uint64)
                keys = home_keys(word)
                yield pd.DataFrame({"key": keys.ravel(), "home": True, "fp": np.repeat(fp, keys.shape[1])})
                for keys in replica_keys(word, max_bits):
                    row, col = np.nonzero(keys >= 0)
                    yield pd.DataFrame({"key": keys[row, col], "home": False, "fp": fp[row]})

    return run


def _compare(max_bits: int):
    """Rows sorted by (key, home first): compare each fingerprint at home with
    everyone at the anchor, in chunks of bounded size."""

    def group(key, home, fp, links: Links):
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        end = np.r_[start[1:], len(key)]
        size = end - start
        of = np.repeat(np.arange(len(start)), size)
        at = np.flatnonzero(home & (size[of] > 1))
        # Homes in order; each makes (group end - own place - 1) pairs: with the
        # homes behind it and every replica of the group.
        pairs = end[of[at]] - at - 1
        word = fp.view(np.uint64)
        i = 0
        while i < len(at):
            total = np.cumsum(pairs[i:])
            j = i + max(1, int(np.searchsorted(total, CHUNK_PAIRS, "right")))
            n = pairs[i:j]
            left = np.repeat(at[i:j], n)
            right = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + left + 1
            near = np.bitwise_count(word[left] ^ word[right]) <= max_bits
            links.add(fp[left[near]], fp[right[near]])
            i = j

    def run(batches):
        links, held = Links(), []
        for f in batches:
            if not len(f):
                continue
            key = f["key"].to_numpy()
            if held and held[0][0][0] == key[-1]:
                held.append((key, f["home"].to_numpy(), f["fp"].to_numpy()))
                continue
            held.append((key, f["home"].to_numpy(), f["fp"].to_numpy()))
            k, h, p = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(k, k[-1]))  # the last group may go on
            if cut:
                group(k[:cut], h[:cut], p[:cut], links)
                yield from links.overflow()
            held = [(k[cut:], h[cut:], p[cut:])]
        if held:
            group(*(np.concatenate(x) for x in zip(*held)), links)
        yield from links.frames()

    return run


def link_fingerprints(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Components of the distinct fingerprints ``fps`` (fp: long) linked at
    ``max_bits`` or fewer differing bits: (node, root), linked ones only."""
    placed = fps.mapInPandas(_replicate(max_bits), "key long, home boolean, fp long")
    edges = (placed.repartition("key").sortWithinPartitions(F.col("key"), F.col("home").desc())
             .mapInPandas(_compare(max_bits), "a long, b long"))
    return components(edges)


def _answers(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """Columns of ``with_fingerprints`` plus component_id and kept."""
    marked = written(with_fingerprints(docs, shingle), "fingerprints")
    fps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    comp = link_fingerprints(fps.select("fp"), max_bits)
    by_fp = (fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
             .withColumn("root", F.coalesce("root", "fp")))
    # The row that stands: smallest id (nulls last), then smallest fingerprint.
    best = by_fp.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "fp")).alias("best"))
    answer = (by_fp.join(best, "root")
              .select("fp", F.col("best.low").alias("component_id"), (F.col("best.fp") == F.col("fp")).alias("__best")))
    return (marked.join(answer, "fp")
            .withColumn("kept", F.col("__best") & F.col("doc_id").eqNullSafe(F.col("component_id"))).drop("__best"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id of every document, ``fp`` (signed long), ``component_id`` (smallest
    doc_id reachable over fingerprints within ``max_bits`` bits) and ``kept`` (true
    for the row that stands for its component; repeats of it all carry it).

    A null or wordless text has fingerprint 0 and links like any other. Rows
    with a null doc_id take part and never name a component unless all ids of
    it are null (then component_id is null). Other columns of ``docs`` are not
    looked at; an empty table gives an empty result.
    """
    return _answers(docs, shingle, max_bits).drop("__id", "__hash")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest
    doc_id; of rows with that id and fingerprint the one of least text hash. Null
    and wordless texts are one component; a component whose ids are all null keeps
    one row; an empty table stays empty. Columns of any name and type are kept as
    they are."""
    kept = (_answers(docs, shingle, max_bits).where("kept")
            .groupBy("__id", "fp").agg(F.min("__hash").alias("__hash")).select("__id", "__hash"))
    return (nested(docs, ["text"]).join(kept, ["__id", "__hash"], "left_semi")
            .dropDuplicates(["__id", "__hash"]).select("__row.*"))
