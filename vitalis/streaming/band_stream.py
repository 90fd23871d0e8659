"""Structured Streaming delivery of band imports.

Export files land under ``<input>/user_id=<id>/<name>.csv``, or under
``<input>/.../import_id=<n>/.../user_id=<id>/<name>.csv`` when one import comes in
several batches. A file stream (whole files per micro-batch) feeds
``foreachBatch``: each batch parses its files (``sources.band_csv``) and writes
their per-file daily rows as ``v<batch_id>``, nothing else, so a retried batch
rewrites the same rows. The daily table is derived on reading: files of one import
merge by maximum, however they were split over batches, and a later import's
values replace those of an earlier one, nulls never (imports in the order of
their numbers; files without one belong to the import of their batch).
Every ``FANOUT`` neighbouring parts of one level are merged into one of the next,
reduced to a row per (user, day, import): a read opens at most FANOUT - 1 parts a
level, so their number grows with the logarithm of the batches, and each row is
rewritten once a level. A part counts when its write is complete, and it hides the parts it
covers; those are removed one merge later, when no read that listed them is left.
The rows and the stream checkpoint live in the shared checkpoint folder
(``spark.checkpoint.dir``).
"""
from __future__ import annotations

import re
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import band
from ..session import checkpoint_path
from ..sources import band_csv

DAILY_SCHEMA = ("user_id long, day date, sleep_hours double, sleep_score double, resting_hr double, "
                "steps long, stress double")
FILE_SCHEMA = f"import_id long, batch long, file string, {DAILY_SCHEMA}"
FANOUT = 8
_OPEN_COST = "spark.sql.files.openCostInBytes"
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


_PART = re.compile(r"^(?:v([0-9]+)|m([0-9]+)-([0-9]+)-([0-9]+))$")


class Part(NamedTuple):
    first: int
    last: int
    level: int
    name: str


def _finished(spark: SparkSession, table_root: str) -> list[Part]:
    """All complete parts: batches (level 0) and merges."""
    fs, p = _fs(spark, table_root)
    out = []
    for st in fs.listStatus(p) if fs.exists(p) else []:
        name = st.getPath().getName()
        m = _PART.match(name)
        if m and fs.exists(st.getPath().suffix("/_SUCCESS")):
            batch, level, first, last = m.groups()
            out.append(Part(int(batch), int(batch), 0, name) if batch else Part(int(first), int(last), int(level), name))
    return sorted(out)


def parts(spark: SparkSession, table_root: str) -> list[Part]:
    """The parts a read opens, in order: no part is covered by another."""
    out: list[Part] = []
    for p in sorted(_finished(spark, table_root), key=lambda p: (p.first, -p.last, -p.level)):
        if not out or p.last > out[-1].last:
            out.append(p)
    return out


def versions(spark: SparkSession, table_root: str) -> list[int]:
    """Numbers of the batches whose rows are in the table."""
    return [n for p in parts(spark, table_root) for n in range(p.first, p.last + 1)]


def file_rows(spark: SparkSession, table_root: str) -> DataFrame:
    """Rows of all parts: a row a (file, user, day) of recent batches, a row a
    (import, user, day) without a file name of merged ones."""
    names = [p.name for p in parts(spark, table_root)]
    if not names:
        return spark.createDataFrame([], FILE_SCHEMA)
    return spark.read.schema(FILE_SCHEMA).parquet(*[f"{table_root}/{n}" for n in names])


def compact(spark: SparkSession, table_root: str, fanout: int = FANOUT) -> int:
    """Merge while the last ``fanout`` parts are of one level; the number of merges.
    Only the writer of the table calls it, between batches. A merge cut short leaves an
    incomplete folder, which the next attempt overwrites."""
    fs, root = _fs(spark, table_root)
    hidden = [p for p in _finished(spark, table_root) if p not in parts(spark, table_root)]
    merges = 0
    while True:
        now = parts(spark, table_root)
        tail = now[-fanout:]
        if len(tail) < fanout or len({p.level for p in tail}) > 1:
            return merges
        while hidden:
            fs.delete(root.suffix(f"/{hidden.pop().name}"), True)
        target = f"m{tail[0].level + 1}-{tail[0].first:09d}-{tail[-1].last:09d}"
        rows = spark.read.schema(FILE_SCHEMA).parquet(*[f"{table_root}/{p.name}" for p in tail])
        merged = (rows.groupBy("import_id", "user_id", "day")
                      .agg(F.max("batch").alias("batch"), *[F.max(c).alias(c) for c in band.DAILY_COLS])
                      .withColumn("file", F.lit(None).cast("string")))
        (merged.select("import_id", "batch", "file", "user_id", "day", *band.DAILY_COLS)
               .write.mode("overwrite").parquet(f"{table_root}/{target}"))
        merges += 1


def latest_snapshot(spark: SparkSession, table_root: str) -> DataFrame:
    """The daily table: (user_id, day) with the maximum over the files of an
    import and, for each column, the value of the last import that has one. Two
    partial aggregates by key."""
    rows = file_rows(spark, table_root)
    merged = rows.groupBy("user_id", "day", "import_id").agg(*[F.max(c).alias(c) for c in band.DAILY_COLS])
    return merged.groupBy("user_id", "day").agg(
        *[F.max(F.when(F.col(c).isNotNull(), F.struct("import_id", c)))[c].alias(c) for c in band.DAILY_COLS])


def lines_of_batch(batch: DataFrame) -> DataFrame:
    """Micro-batch rows (value, user_id, file, _blk) -> numbered lines, as
    ``band_csv.read_lines`` does for a batch read. ``_id``, in the order of a file's
    rows, is added where the rows have none."""
    df = batch if "_id" in batch.columns else batch.withColumn("_id", F.monotonically_increasing_id())
    # Only two rows a file and task leave the tasks for this window.
    place = F.row_number().over(Window.partitionBy("file").orderBy("_id"))
    two = df.where(F.col("_blk") == 0).select("file", "_id", place.alias("_n")).where("_n <= 2")
    head = two.groupBy("file").agg(F.min("_id").alias("_id0"), F.max(F.when(F.col("_n") == 2, F.col("_id"))).alias("_id1"))
    out = df.join(head, "file", "left")
    line_no = F.when(F.col("_id") == F.col("_id0"), 0).when(F.col("_id") == F.col("_id1"), 1).otherwise(2)
    return out.select("file", "user_id", line_no.alias("line_no"), F.col("value").alias("text"))


def apply_import(spark: SparkSession, lines: DataFrame, table_root: str, version: int) -> None:
    """One batch: lines -> per-file daily rows, written as version ``version``."""
    number = F.regexp_extract("file", r"/import_id=([0-9]{1,18})/", 1)
    rows = (band_csv.per_file_daily(lines)
            .withColumn("import_id", F.when(number != "", number.cast("long")).otherwise(F.lit(version).cast("long")))
            .withColumn("batch", F.lit(version).cast("long")))
    (rows.select("import_id", "batch", "file", "user_id", "day", *band.DAILY_COLS)
         .write.mode("overwrite").parquet(f"{table_root}/v{version:09d}"))


def _reader(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` for a stream of small files. Each counted as
    4 MB, as Spark does unless told otherwise, every few of them would be a task; and
    every file of a batch would be a task of its listing."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if own.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set(_OPEN_COST, "64k")
    own.conf.set(_LISTING, str(4 * spark.sparkContext.defaultParallelism))
    return own


def start(spark: SparkSession, input_dir: str, table_root: str | None = None, name: str = "band_daily",
          available_now: bool = True, files_per_batch: int = 1000) -> StreamingQuery:
    """Start the import stream. ``available_now`` processes what is there
    and stops (scheduled runs); otherwise it keeps watching. Parts are merged
    after each batch."""
    table_root = table_root or checkpoint_path(spark, f"tables/{name}")
    ckpt = checkpoint_path(spark, f"streams/{name}")
    src = (_reader(spark).readStream.schema("value string, user_id long").option("maxFilesPerTrigger", files_per_batch)
           .text(input_dir)
           .select("value", "user_id", F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("_blk")))

    def each(batch: DataFrame, batch_id: int) -> None:
        # The files are opened once: numbering, headers and metrics read the kept rows.
        kept = batch.withColumn("_id", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
        try:
            apply_import(batch.sparkSession, lines_of_batch(kept), table_root, batch_id)
        finally:
            kept.unpersist()
        compact(batch.sparkSession, table_root)

    w = src.writeStream.foreachBatch(each).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
