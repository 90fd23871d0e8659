"""Spark session defaults and the shared checkpoint folder."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_ESTIMATED = "spark.sql.autoBroadcastJoinThreshold"
_MEASURED = "spark.sql.adaptive.autoBroadcastJoinThreshold"

# Settings every job relies on. They are applied only when the cluster has not
# set them already, so a cluster-wide configuration always wins.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key's join partition even when the split costs one more
    # shuffle (joins feeding an aggregation on a finer key, e.g. lines joined
    # on file then grouped by file and day).
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Packed bytes: sorted keys and repeated texts are many times that in a task's memory.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # A broadcast is chosen for sides whose size Spark has measured below the second bound.
    # What it estimates from the packed bytes of files is many times that in the driver's
    # memory: by an estimate only sides of next to no bytes are taken.
    _ESTIMATED: "256k",
    _MEASURED: "16m",
    "spark.sql.files.maxPartitionBytes": "32m",
}


def build_session(master: str | None = None, app: str = "vitalis",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine defaults.

    ``master`` is only set for local runs (tests, bench); on a cluster the
    launcher decides it.
    """
    b = SparkSession.builder.appName(app)
    if master:
        # Local runs: the driver JVM is the only executor.
        b = b.master(master).config("spark.driver.memory", "8g")
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Set engine defaults on an existing session where they are unset or
    where the value is required for correct results (UTC day boundaries)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # A cluster's bound for broadcasts holds for measured sizes, too.
    bounded = spark.conf.get(_ESTIMATED, None) is not None
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None and not (k == _MEASURED and bounded):
            spark.conf.set(k, v)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and streaming state.

    Read from ``spark.checkpoint.dir`` (the cluster names a shared folder
    there). Unset, it is an error on a cluster; in local mode a scratch folder
    is made and recorded in the session so every later call agrees.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="vitalis-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def checkpoint_path(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_root(spark), name)
