"""Files on shared storage, opened by URI from any task."""
from __future__ import annotations

import fnmatch
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_root


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read from there, so that what Python reads
    is read once, and its size is known to Spark."""
    where = fresh(spark, name)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a Hadoop-style URI or a plain path."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    scheme, rest = uri.split("://", 1)
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + "://" + rest)


def listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length) of the files under ``path``; their contents are not read. Folders
    are listed in tasks, a level at a time, into a table: neither the driver nor a later
    pass holds or repeats the listing. Names that begin with ``_`` or ``.`` are left out,
    as Spark's readers do."""
    root = fresh(spark, "listing")
    tasks = 2 * spark.sparkContext.defaultParallelism

    def listed(frames):
        import pandas as pd
        from pyarrow import fs

        def frame(rows):
            return pd.DataFrame(rows, columns=["path", "length"]).astype({"length": "Int64"})
        for f in frames:
            rows = []
            for uri in f["path"]:
                system, where = filesystem(uri)
                info = system.get_file_info(where)
                if info.type == fs.FileType.NotFound:
                    raise FileNotFoundError(uri)
                found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(where))
                head = uri[:len(uri) - len(where)] if uri.endswith(where) else ""
                rows += [(head + i.path, None if i.type == fs.FileType.Directory else i.size) for i in found
                         if i.base_name[:1] not in ("_", ".")
                         and (i.type == fs.FileType.Directory or fnmatch.fnmatchcase(i.base_name, pattern))]
                if len(rows) >= 10_000:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    folders, level = spark.createDataFrame([(path.rstrip("/"),)], "path string"), 0
    while True:
        folders.mapInPandas(listed, "path string, length long").write.parquet(f"{root}/{level:03d}")
        folders = spark.read.schema("path string, length long").parquet(f"{root}/{level:03d}").where("length is null")
        level += 1
        if folders.isEmpty():
            break
        folders = folders.select("path").repartition(tasks, "path")
    return (spark.read.schema("path string, length long").parquet(*[f"{root}/{n:03d}" for n in range(level)])
            .where("length is not null"))


class Published:
    """An output file that gets its name only when it is whole: an attempt writes
    under a name of its own, and the last one to finish stands."""

    def __init__(self, uri: str) -> None:
        self.system, self.path = filesystem(uri)
        folder = self.path.rsplit("/", 1)[0]
        self.system.create_dir(folder, recursive=True)
        self.own = f"{folder}/.{uuid.uuid4().hex}.part"
        self.out = self.system.open_output_stream(self.own, compression=None)

    def __enter__(self):
        return self.out

    def __exit__(self, kind, value, trace) -> None:
        self.out.close()
        if kind is None:
            self.system.move(self.own, self.path)
        else:
            self.system.delete_file(self.own)
