"""Token-ID output: whole texts as ids of a public tokenizer, in shards
compressed by Re-Pair (``repair``), written in ascending doc_id order.

The documents are range-partitioned by doc_id; a task writes its range as one
or more shards of about ``SHARD_IDS`` ids. Shards are named by a fresh id for
each attempt, and only those of the attempts that committed their row in the
index are ever read, so a lost executor or a second attempt leaves no trace.
"""
from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repair
from .common import scratch, small_batches, written
from .files import make_folder, read_bytes, read_range, write_bytes
from .tokens import default_vocabulary, encoder

END_ID = 0
SHARD_IDS = 1_500_000
#: Characters encoded before the ids are laid aside.
STEP_CHARS = 1_000_000
#: Ids that one task reads back where there are enough of them for all cores.
READ_IDS = 64_000_000


def write_shards(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID,
                 shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write ``docs`` (doc_id: long, text) to shards in ``folder``; returns the
    index: part, block, path, n_docs, n_ids, first (ids of all shards before).

    Every document ends with ``end_id``. Null and empty texts are that id alone.
    Null ids come first; rows with the same doc_id follow one another in the
    order of the input. An empty table writes no shard.
    """
    path = vocabulary or default_vocabulary()
    make_folder(folder)
    small_batches(docs.sparkSession)

    def flush(part, block, ids, nulls, sizes, flat):
        flat, sizes = np.concatenate(flat), np.concatenate(sizes)
        size = encoder(path).tokenizer.get_vocab_size()
        name = f"{folder}/{part:06d}-{block:06d}-{uuid.uuid4().hex}.rpid"
        write_bytes(name, repair.dump(repair.compress(flat, sizes, size), size,
                                      np.concatenate(ids), np.concatenate(nulls)))
        return pd.DataFrame({"part": [part], "block": [block], "path": [name], "n_docs": [len(sizes)],
                             "n_ids": [len(flat)]})

    def run(batches):
        from pyspark import TaskContext
        part, block = TaskContext.get().partitionId(), 0
        enc = encoder(path)
        ids, nulls, sizes, flat, n = [], [], [], [], 0
        for f in batches:
            texts = f["text"].tolist()
            doc, null = f["doc_id"].fillna(0).to_numpy(np.int64), f["doc_id"].isna().to_numpy()
            i = 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and (j == i or chars < min(STEP_CHARS, shard_ids)):
                    chars += len(texts[j] or "")
                    j += 1
                got, size = enc.encode(texts[i:j])
                flat.append(np.insert(got, np.cumsum(size), end_id))
                sizes.append(size + 1)
                ids.append(doc[i:j])
                nulls.append(null[i:j])
                n += len(flat[-1])
                if n >= shard_ids:
                    yield flush(part, block, ids, nulls, sizes, flat)
                    ids, nulls, sizes, flat, n, block = [], [], [], [], 0, block + 1
                i = j
        if n:
            yield flush(part, block, ids, nulls, sizes, flat)

    # The row number parts rows of one doc_id, so that no id is one task's.
    ordered = (docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
               .repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
               .select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    index = written(ordered.mapInPandas(run, "part long, block long, path string, n_docs long, n_ids long"), "shards")
    return with_starts(index)


def with_starts(index: DataFrame) -> DataFrame:
    """Add ``first``: ids of all shards before. Totals of the parts first, then
    the shards of a part."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = (index.groupBy("part").agg(F.sum("n_ids").alias("total"))
             .withColumn("base", F.coalesce(F.sum("total").over(before(Window.orderBy("part"))), F.lit(0)))
             .select("part", "base"))
    own = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("block"))), F.lit(0))
    return index.withColumn("own", own).join(parts, "part").withColumn("first", F.col("base") + F.col("own")) \
        .drop("base", "own")


def read_shards(index: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 (of
    the ids as little-endian uint32) of every document, decoded from the files."""

    def run(batches):
        for f in batches:
            for path, first in zip(f["path"], f["first"]):
                shard = repair.load(read_bytes(path))
                flat = repair.Grammar(shard, shard["vocabulary"]).expand(shard["symbols"]).astype("<u4")
                ends = np.cumsum(shard["doc_sizes"])
                starts = ends - shard["doc_sizes"]
                view = memoryview(flat.tobytes())
                crc = [zlib.crc32(view[4 * i:4 * j]) for i, j in zip(starts.tolist(), ends.tolist())]
                ids = pd.array(shard["doc_ids"].copy(), dtype="Int64")
                ids[shard["nulls"].astype(bool)] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "start": starts + first, "n_tokens": shard["doc_sizes"],
                                    "ids_crc32": crc})

    # Neighbouring shards share a task by their number of ids, but no core is left idle.
    shards, ids = index.agg(F.count("*"), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
    n = max(1, min(shards, max(-(-ids // READ_IDS), 4 * index.sparkSession.sparkContext.defaultParallelism)))
    return (index.select("path", "first").repartitionByRange(n, "first")
            .mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def read_documents(index: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (part, block, k: the k-th document of that shard) with ``ids``, each
    document decoded from the byte range of its symbols. Places that name no document
    of ``index``, and null ones, give no row."""

    def run(batches):
        for f in batches:
            for path, rows in f.groupby("path"):
                shard = repair.ShardFile(lambda begin, size, path=path: read_range(path, begin, size))
                rows = rows[(rows["k"] >= 0) & (rows["k"] < shard.n_docs)]
                if len(rows):
                    yield rows[["part", "block", "k"]].assign(ids=[shard.document(k).astype(np.int64) for k in rows["k"].tolist()])

    return (places.select("part", "block", "k").where("k is not null").join(index.select("part", "block", "path"), ["part", "block"])
            .mapInPandas(run, "part long, block long, k long, ids array<long>"))


def token_output(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Write ``docs`` to shards and return what reading them gives."""
    folder = folder or scratch(docs.sparkSession, "token-ids")
    return read_shards(write_shards(docs, folder, vocabulary))
