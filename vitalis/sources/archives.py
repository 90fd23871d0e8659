"""Zipped export uploads -> line table for ``band_csv``, one member a task.

The directory of a zip archive stands at its end. It is read by byte range, without
the rest of the archive, into a row for each member; members are then dealt over
tasks, and each is read from its own offset and decompressed as a stream, so neither
an archive nor a member is ever whole in memory. An archive without a directory, and
a member that cannot be read to its end, is a row that says so. (Files of no bytes
are not listed by Spark and give no row.)
"""
from __future__ import annotations

import struct
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import CHUNK, START, breaks, line_batches, record_text, user_of
from .storage import Published, filesystem, kept, listing

MEMBER = ("path string, user_id long, member string, method int, flags int, offset long, packed long, size long, crc long, "
          "error string")
LINES = "file string, user_id long, line_no long, text string, error string"
#: Archives whose directories one task reads: a task each would cost the driver more
#: memory than all the rows.
ARCHIVES = 256


def members(spark: SparkSession, path: str, pattern: str = "*.[zZ][iI][pP]") -> DataFrame:
    """A row for each CSV member of the archives under ``path``, and one with
    ``error`` and without a member for each archive that has no directory. A task reads the
    directories of about ``ARCHIVES`` archives, once: the rows are a written table."""
    files = listing(spark, path, pattern)
    tasks = max(1, min(-(-files.count() // ARCHIVES), 10_000))

    def read(frames):
        import pandas as pd
        for f in frames:
            rows = []
            for name in f["path"]:
                user = user_of(name)
                system, where = filesystem(name)
                with system.open_input_file(where) as source:
                    try:
                        with zipfile.ZipFile(source) as z:
                            for i in z.infolist():
                                if i.filename.lower().endswith(".csv"):
                                    rows.append((name, user, i.filename, i.compress_type, i.flag_bits, i.header_offset,
                                                 i.compress_size, i.file_size, i.CRC, None))
                    except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as e:
                        rows.append((name, user, None, None, None, None, None, None, None, f"archive: {e}"))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBER.split(", ")], dtype=object)
            yield out

    return kept(spark, files.select("path").repartition(tasks, "path").mapInPandas(read, MEMBER), "members")


def pieces(f, offset: int, packed: int, method: int):
    """The bytes of a member in pieces. Raises ValueError where they cannot be had."""
    f.seek(offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no member at its offset")
    name, extra = struct.unpack("<HH", head[26:30])
    f.seek(offset + 30 + name + extra)
    if method not in (0, 8):
        raise ValueError(f"compression method {method}")
    unpack = zlib.decompressobj(-15) if method == 8 else None
    while packed:
        data = f.read(min(CHUNK, packed))
        if not data:
            raise ValueError("the archive ends inside the member")
        packed -= len(data)
        if unpack is None:
            yield data
            continue
        while data:  # a piece of at most CHUNK bytes at a time, however well it is packed
            try:
                out = unpack.decompress(data, CHUNK)
            except zlib.error as e:
                raise ValueError(str(e)) from e
            if out:
                yield out
            data = unpack.unconsumed_tail
    if unpack is not None:
        rest = unpack.flush()
        if rest:
            yield rest
        if not unpack.eof:
            raise ValueError("the compressed data end early")


def member_records(chunks):
    """(number, bytes) of the records in pieces of a file."""
    state, number, held = START, 0, []
    for data in chunks:
        found, state = breaks(data, state)
        base = 0
        for p in found:
            held.append(data[base:p])
            yield number, b"".join(held)
            held, base, number = [], p + 1, number + 1
        held.append(data[base:])
    if any(held):
        yield number, b"".join(held)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Zip uploads under ``path`` (``.../user_id=<id>/*.zip``) -> (file, user_id,
    line_no, text, error); ``file`` is ``archive!/member``, line_no is exact. A row
    with ``error`` has no line; lines before the place where a member breaks stand. The
    archives are read once: the lines are a written table."""
    table = members(spark, path)
    size = table.agg(F.count("*"), F.sum("size")).first()
    tasks = max(1, min(size[0] or 1, max(8, (size[1] or 0) // (32 << 20)), 100_000))

    def read(batches):
        import pyarrow as pa

        def rows(errors):
            for b in batches:
                for r in b.to_pylist():
                    if r["error"] is not None:
                        errors.append((r["path"], r["user_id"], r["error"]))
                        continue
                    file = f"{r['path']}!/{r['member']}"
                    system, name = filesystem(r["path"])
                    seen = [0, 0]

                    def checked(source, r=r, seen=seen):
                        if r["flags"] & 1:
                            raise ValueError("encrypted")
                        for data in pieces(source, r["offset"], r["packed"], r["method"]):
                            seen[0], seen[1] = zlib.crc32(data, seen[0]), seen[1] + len(data)
                            yield data
                        if (seen[0], seen[1]) != (r["crc"], r["size"]):
                            raise ValueError("checksum or size differs from the directory")

                    with system.open_input_file(name) as source:
                        try:
                            for n, raw in member_records(checked(source)):
                                yield file, r["user_id"], n, record_text(raw)
                        except ValueError as e:
                            errors.append((file, r["user_id"], f"member: {e}"))

        errors: list = []
        for b in line_batches(rows(errors)):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.string())],
                                             names=["file", "user_id", "line_no", "text", "error"])
        if errors:
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[0] for e in errors]), pa.array([e[1] for e in errors], pa.int64()),
                 pa.nulls(len(errors), pa.int64()), pa.nulls(len(errors), pa.string()), pa.array([e[2] for e in errors])],
                names=["file", "user_id", "line_no", "text", "error"])

    return kept(spark, table.repartition(tasks, "path", "member").mapInArrow(read, LINES), "lines")


def rejected(lines: DataFrame) -> DataFrame:
    """What could not be read: user_id, file and error."""
    return lines.where(F.col("error").isNotNull()).select("user_id", "file", "error")


def write_archives(lines: DataFrame, root: str, name: str = "export.zip") -> int:
    """Write (file, user_id, line_no, text) rows as one archive a user,
    ``root/user_id=<id>/name``, a member a file; the number of archives."""
    def write(batches):
        import pyarrow as pa
        now, file, out, z, member, n = None, None, None, None, None, 0

        def close():
            if member is not None:
                member.close()
            if z is not None:
                z.close()
                out.__exit__(None, None, None)

        for b in batches:
            for user, path, text in zip(*[c.to_pylist() for c in b.columns]):
                if user != now:
                    close()
                    out = Published(f"{root}/user_id={user}/{name}")
                    z = zipfile.ZipFile(out.out, "w", zipfile.ZIP_DEFLATED)
                    now, file, member, n = user, None, None, n + 1
                if path != file:
                    if member is not None:
                        member.close()
                    file, member = path, z.open(f"export/{path.rsplit('/', 1)[-1]}", "w")
                member.write((text + "\n").encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["archives"])

    done = (lines.repartition("user_id").sortWithinPartitions("user_id", "file", "line_no").select("user_id", "file", "text")
            .mapInArrow(write, "archives long"))
    return done.agg(F.sum("archives")).first()[0] or 0


def write_broken(users: DataFrame, root: str, name: str = "broken.zip") -> None:
    """For each row of ``users`` (user_id) an upload that was cut short."""
    def write(frames):
        for f in frames:
            for user in f["user_id"]:
                with Published(f"{root}/user_id={user}/{name}") as out:
                    out.write(b"PK\x03\x04\x14\x00 cut short")
            yield f

    users.select(F.col("user_id").cast("long").alias("user_id")).mapInPandas(write, "user_id long").agg(F.count("*")).first()
