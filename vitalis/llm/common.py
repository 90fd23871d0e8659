"""Helpers shared by the operators: lineage cuts, connected components."""
from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/vitalis-{name}-{uuid.uuid4().hex}"


#: Stands for a null doc_id where rows are joined or sorted by it.
NO_ID = -(1 << 63)


def row_key(df: DataFrame, columns: list[str]) -> list:
    """Two columns, __id and __hash, that name a row by doc_id and by the hash of
    ``columns``: rows with the same pair are repeats of one row. Values that have no
    hash of their own (maps, variants) count by their JSON."""
    def value(c: str):
        kind = df.schema[c].dataType.simpleString()
        plain = "map<" not in kind and "variant" not in kind
        return F.col(f"`{c}`") if plain else F.to_json(F.struct(F.col(f"`{c}`")))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__id"),
            F.xxhash64(*[value(c) for c in columns]).alias("__hash")]


def nested(df: DataFrame, columns: list[str]) -> DataFrame:
    """The row as one column, __row, with its key beside it: free of clashes with
    whatever is joined to it. ``select("__row.*")`` gives the row back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *row_key(df, columns))


#: Rows of whole texts or payloads that a Python worker holds at once.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in small Arrow batches from now on, whose size
    the longest texts of a batch bound rather than the number of rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: Shuffle files go when the job that made them ends (a Spark setting). A table is
#: written once, so nothing reads them again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so later
    jobs neither recompute it nor depend on an executor's disk."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing will read any more: what was made of them
    has been written itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, root) spanning the components of the links a-b; the
    root is the smallest member. At most one edge per node."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = inv[:len(a)], inv[len(a):]
    parent = np.arange(len(nodes))
    while True:
        ra, rb = parent[ia], parent[ib]
        if (ra == rb).all():
            break
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[child], nodes[parent[child]]


class Links:
    """Collects links inside one task and hands on spanning edges only, so a
    group of n linked rows costs n edges, never n * n."""

    def __init__(self, limit: int = 1_000_000):
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.n, self.limit = 0, limit

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.n += len(a)
            if self.n > self.limit:
                self._shrink()

    def _shrink(self) -> None:
        a, b = forest(np.concatenate(self.a), np.concatenate(self.b))
        self.a, self.b, self.n = [a], [b], len(a)

    def frames(self):
        """The edges; at most ``limit`` or one per node are held."""
        if self.n:
            self._shrink()
            yield pd.DataFrame({"a": self.a[0], "b": self.b[0]})
        self.a, self.b, self.n = [], [], 0

    def overflow(self):
        """Flush when even the spanning edges exceed the limit."""
        if self.n > self.limit // 2:
            yield from self.frames()


def _local_forest(frames):
    links = Links()
    for f in frames:
        links.add(f["a"].to_numpy(), f["b"].to_numpy())
        yield from links.overflow()
    yield from links.frames()


#: Ranges of hashes that the links of one node are dealt over.
SALTS = 1024


def _lowest(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (a, b) with m, the smallest b of its a in ``links``. The links of a
    node meet by a range of hashes at a time, and a row for each range takes the
    node's smallest one there: the centre of a large star is never one task's."""
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt")
    parts = links.groupBy("a", salt).agg(F.min("b").alias("m"))
    low = parts.groupBy("a").agg(F.min("m").alias("m"))
    return wanted.select("a", "b", salt).join(parts.select("a", "salt").join(low, "a"), ["a", "salt"]).select("a", "b", "m")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long), as (node, root): one row
    per node that has a link, root the smallest node of its component.

    Alternating large-star / small-star rounds over written tables: every node
    re-links its larger (then its smaller) neighbours to its smallest one until
    only stars are left. Nothing of the graph reaches the driver except two
    numbers a round. Nulls and self links are ignored.
    """
    spark = edges.sparkSession
    e = (edges.where(F.col("a") != F.col("b"))
         .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
         .mapInPandas(_local_forest, "a long, b long"))
    e = written(e, "edges")
    seen = None
    while True:
        # Large star: u's larger neighbours are linked to the smallest of u and
        # its neighbours.
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        big = (_lowest(both, both.where("b > a")).select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
               .where("a <> b").distinct())
        # Small star: u's smaller neighbours and u itself are linked to the
        # smallest of them. The larger end is always "a" here.
        small = (_lowest(big, big)
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct("a", F.col("m").alias("b")))).alias("s"))
                 .select("s.a", "s.b").where("a <> b").distinct())
        before, e = e, written(small, "edges")
        discard(before)
        sums = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = (sums[0], sums[1])
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now
