"""Appends that count once: a table as committed batches.

A batch is written to a folder of its own attempt, then named by a manifest that is
created only if the batch has none. Readers follow manifests, so a half-written or
repeated attempt is never seen, and running a batch twice adds its rows once.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def committed(spark: SparkSession, table: str) -> dict[str, dict]:
    """Manifests by batch id, in the order of the ids: the folder of each batch and
    its number of rows."""
    system, folder = _hadoop(spark, f"{table}/_manifests")
    if not system.exists(folder):
        return {}
    out = {}
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".json"):
            line = spark.read.text(status.getPath().toString()).first()
            out[name[:-len(".json")]] = json.loads(line[0])
    return dict(sorted(out.items()))


def append_batch(rows: DataFrame, table: str, batch: str, partition_by: list[str] | None = None) -> bool:
    """Append ``rows`` to ``table`` (a folder all executors share) as ``batch`` (a
    name of letters, digits and ``-``). False, and nothing is written, if the batch is
    there; of two writers of one batch the first to name it stands."""
    spark = rows.sparkSession
    if not batch or not batch.replace("-", "").isalnum():
        raise ValueError("a batch is named by letters, digits and -")
    system, manifest = _hadoop(spark, f"{table}/_manifests/{batch}.json")
    if system.exists(manifest):
        return False
    folder = f"{table}/{batch}/{uuid.uuid4().hex}"
    writer = rows.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(folder)
    n = spark.read.schema(rows.schema).parquet(folder).count()
    text = json.dumps({"folder": folder, "rows": n, "schema": rows.schema.jsonValue()})
    jvm = spark._jvm
    own = jvm.org.apache.hadoop.fs.Path(f"{table}/_manifests/.{uuid.uuid4().hex}")
    system.mkdirs(manifest.getParent())
    out = system.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    # A rename that does not replace: the manifest is whole, and there is one.
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(own, manifest, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Exception:  # noqa: BLE001  a Java exception, told apart by looking again
        if system.exists(manifest):
            system.delete(own, False)
            return False
        raise
    return True


def read_committed(spark: SparkSession, table: str) -> DataFrame:
    """All rows of the committed batches, each with its batch id in ``batch``."""
    out = None
    for batch, m in committed(spark, table).items():
        schema = T.StructType.fromJson(m["schema"])
        rows = spark.read.schema(schema).parquet(m["folder"]).withColumn("batch", F.lit(batch))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"{table} has no committed batch")
    return out
