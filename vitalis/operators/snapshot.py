"""Immutable snapshots instead of in-place writes.

Every write of the original app (insert, insert-or-replace, upsert with
coalesce, delete, update) becomes a DataFrame that *is* the next snapshot,
written as a new table version. All are keyed operations: a union plus a
partial aggregate by key, or an equi-join on the key -- no sort of a whole
key group and no driver round trip.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_path
from .listing import numbered_within


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Inserted rows added to the snapshot (no key; duplicates allowed)."""
    return old.unionByName(new)


def upsert_replace(old: DataFrame, new: DataFrame, key: list[str], seq: str | None = None) -> DataFrame:
    """Insert-or-replace by key: a new row replaces the whole old row. Of several
    new rows with one key the one with the highest ``seq`` (a column of ``new``,
    the order of the writes) stands; without ``seq`` keys of ``new`` are unique.

    Written as union + ``max_by(row, version)`` per key: a partial (map-side)
    aggregate, so a key repeated many times is combined before the shuffle.
    """
    cols = [c for c in old.columns if c not in key]
    u = (old.select(*key, F.struct(*cols).alias("_row"), F.struct(F.lit(0).alias("v"), F.lit(None).cast("long").alias("s")).alias("_ver"))
         .unionByName(new.select(*key, F.struct(*cols).alias("_row"), F.struct(F.lit(1).alias("v"), (F.col(seq) if seq else F.lit(None)).cast("long").alias("s")).alias("_ver"))))
    return (u.groupBy(*key).agg(F.max_by("_row", "_ver").alias("_row"))
             .select(*key, *[F.col(f"_row.{c}").alias(c) for c in cols]))


def delete_keys(old: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is listed in ``keys`` removed (left anti join)."""
    return old.join(keys.select(*key).distinct(), key, "left_anti")


def update_by_key(old: DataFrame, patch: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Set ``cols`` from ``patch`` for matching keys (all listed columns are
    replaced, NULLs included); other rows unchanged."""
    p = patch.select(*key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_p_{c}") for c in cols])
    j = old.join(p, key, "left")
    return j.select(*[F.when(F.col("_hit"), F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) if c in cols
                      else F.col(c) for c in old.columns])


def write_snapshot(spark: SparkSession, df: DataFrame, name: str, partition_by: list[str] | None = None,
                   path: str | None = None) -> DataFrame:
    """Write ``df`` as the new version of table ``name`` under the shared
    checkpoint folder (or ``path``) and return it read back: the write cuts
    the lineage, so a lost executor never recomputes the history."""
    target = path or checkpoint_path(spark, f"tables/{name}")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(target)
    return spark.read.parquet(target)


def upsert_by_name(old: DataFrame, new: DataFrame, scope: list[str], name: str, key: str) -> DataFrame:
    """Rows of ``new`` saved into ``old`` by ``name`` within ``scope``: a known name
    keeps its ``key`` and takes the other columns of the new row, a new one gets the
    next free number of its scope, in the order of the names. Names are unique in each
    table; ``new`` has the columns of ``old`` but ``key``. Column ``added`` marks the
    new names. The numbers come from positions over range partitions, so a scope with
    any number of new names is spread over tasks.
    """
    rest = [c for c in old.columns if c not in (*scope, name, key)]
    by = [*scope, name]
    both = (old.select(*by, F.col(key).alias("_key"), F.struct(*rest).alias("_old"), F.lit(None).cast(old.select(F.struct(*rest)).schema[0].dataType).alias("_new"))
            .unionByName(new.select(*by, F.struct(*rest).alias("_new")), allowMissingColumns=True)
            .groupBy(*by).agg(F.max("_key").alias("_key"), F.max("_old").alias("_old"), F.max("_new").alias("_new")))
    row = F.coalesce("_new", "_old")
    values = [row[c].alias(c) for c in rest]
    known = both.where(F.col("_key").isNotNull()).select(*scope, F.col("_key").alias(key), name, *values, F.lit(False).alias("added"))
    top = old.groupBy(*scope).agg(F.max(key).alias("_top"))
    fresh = numbered_within(both.where(F.col("_key").isNull()).select(*by, *values), scope, [name], "_n").join(top, scope, "left")
    number = (F.coalesce("_top", F.lit(-1)) + F.col("_n")).cast(old.schema[key].dataType)
    return known.unionByName(fresh.select(*scope, number.alias(key), name, *rest, F.lit(True).alias("added")))
