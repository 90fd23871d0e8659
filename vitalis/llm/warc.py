"""WARC archives: written with an index, read by coalesced byte ranges.

Each task writes its rows to an archive of its own (one gzip member a record)
and emits the index: path, offset, length, URL and payload digest per record.
Archives are named by a fresh id for each attempt; only what the committed index
names is read. Reading sorts the selected records by place, joins neighbouring
ranges to single reads, and cuts the records out of them.

Identical payloads (equal SHA-1, at least ``MIN_REVISIT`` bytes) are stored once:
the record with the largest page_id is the response, the others are revisit
records without a payload that refer to it.
"""
from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_batches, written
from .files import filesystem, make_folder

MIN_REVISIT = 1000
#: An archive is closed at this size; reads are joined over gaps up to
#: ``MAX_GAP`` and up to ``MAX_READ`` bytes together.
ARCHIVE_BYTES = 256 << 20
MAX_GAP = 64 << 10
MAX_READ = 8 << 20
#: Archive bytes that one task reads.
TASK_BYTES = 16 << 20
_GZIP = 16 + zlib.MAX_WBITS
_ID = "<urn:page:{}>"
_NO_ID = "none"


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    body = b"" if kind == "revisit" else payload
    name = lambda i: _ID.format(_NO_ID if i is None else i)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}"]
    if url is not None:
        clean = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
        head.append(f"WARC-Target-URI: {clean}")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
             f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"
    c = zlib.compressobj(3, zlib.DEFLATED, _GZIP)
    return c.compress(raw) + c.flush()


def parse(member: bytes) -> dict:
    """Fields of one record; payload None for a revisit."""
    raw = zlib.decompress(member, _GZIP)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    f = dict(x.split(": ", 1) for x in lines[1:])
    number = lambda s: None if s == _NO_ID else int(s)
    plain = lambda x: number(x.removeprefix("<urn:page:").removesuffix(">"))
    url = f.get("WARC-Target-URI")
    body = rest[:int(f["Content-Length"])]
    kind = f["WARC-Type"]
    if kind != "revisit" and hashlib.sha1(body).hexdigest() != f["WARC-Payload-Digest"].removeprefix("sha1:"):
        raise ValueError(f"payload of {f['WARC-Record-ID']} does not match its digest")
    return {"page_id": plain(f["WARC-Record-ID"]), "record_type": kind,
            "url": None if url is None else url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"),
            "payload_digest": f["WARC-Payload-Digest"].removeprefix("sha1:"),
            "payload_bytes": int(f["X-Payload-Length"]) if kind == "revisit" else len(body),
            "refers_to": plain(f["WARC-Refers-To"]) if kind == "revisit" else None,
            "payload": None if kind == "revisit" else body}


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest and the response each row revisits (``into``,
    null for a response). Rows with a null id revisit, and are never revisited;
    rows that repeat the response's id are responses too."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    repeated = (rows.where(F.col("size") >= min_revisit).groupBy("digest")
                .agg(F.max("page_id").alias("into"), F.count("*").alias("n"))
                .where("n > 1 and into is not null").select("digest", "into"))
    into = F.when(F.col("size") >= min_revisit, F.col("into"))
    into = F.when(~F.col("page_id").eqNullSafe(into), into)
    return rows.join(repeated, "digest", "left").select("page_id", "url", "html", "digest", into.alias("into"))


INDEX = ("page_id long, url string, payload_digest string, record_type string, refers_to long, path string, "
         "offset long, length long")


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) to archives in
    ``folder`` and return the index. A null html is an empty payload; an empty
    table writes no archive; other columns are not stored."""
    make_folder(folder)
    small_batches(pages.sparkSession)

    names = [x.split()[0] for x in INDEX.split(", ")]

    def frame(rows):
        return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype="Int64" if n in ("page_id", "refers_to") else None)
                             for i, n in enumerate(names)})

    def run(batches):
        from pyspark import TaskContext
        part, out, path, rows, at = TaskContext.get().partitionId(), None, "", [], 0
        for f in batches:
            for page, url, html, digest, into in zip(f["page_id"], f["url"], f["html"], f["digest"], f["into"]):
                if out is None:
                    path, at = f"{folder}/{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
                    system, local = filesystem(path)
                    out = system.open_output_stream(local, compression=None)
                page = None if pd.isna(page) else int(page)
                into = None if pd.isna(into) else int(into)
                kind = "response" if into is None else "revisit"
                member = record(page, url, bytes(html), digest, kind, into)
                out.write(member)
                rows.append((page, url, digest, kind, into, path, at, len(member)))
                at += len(member)
                if at >= ARCHIVE_BYTES:  # the index names only what is closed
                    out.close()
                    yield frame(rows)
                    out, rows = None, []
        if out is not None:
            out.close()
            yield frame(rows)

    return written(plan_records(pages, min_revisit).mapInPandas(run, INDEX), "warc-index")


def ranges(paths, offsets, lengths, max_gap: int = MAX_GAP, max_read: int = MAX_READ):
    """Runs (first row, row behind, path, begin, end) of sorted records that one
    read serves."""
    i = 0
    while i < len(paths):
        begin, end, j = offsets[i], offsets[i] + lengths[i], i + 1
        while (j < len(paths) and paths[j] == paths[i] and offsets[j] - end <= max_gap
               and offsets[j] + lengths[j] - begin <= max_read):
            end = max(end, offsets[j] + lengths[j])
            j += 1
        yield i, j, paths[i], begin, end
        i = j


RECORD = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, "
          "payload binary")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records an index (or any selection of its rows) names, read from the
    archives: page_id, url, record_type, payload_digest, payload_bytes,
    refers_to and, unless left out, payload (null for revisits). Each response's
    payload is checked against its digest."""
    schema = RECORD if payloads else RECORD.rsplit(",", 1)[0]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for f in batches:
            paths, offsets = f["path"].tolist(), f["offset"].to_numpy(np.int64)
            lengths = f["length"].to_numpy(np.int64)
            for i, j, path, begin, end in ranges(paths, offsets, lengths):
                system, local = filesystem(path)
                with system.open_input_file(local) as src:
                    src.seek(int(begin))
                    data = src.read(int(end - begin))
                got = [parse(data[int(offsets[k] - begin):int(offsets[k] - begin + lengths[k])]) for k in range(i, j)]
                yield pd.DataFrame({n: pd.Series([r[n] for r in got], dtype="Int64" if n in ("page_id", "refers_to") else None)
                                    for n in names})

    # Tasks by the bytes they will read, not by the size of the index.
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = 1 + total // TASK_BYTES
    return (index.select("path", "offset", "length").repartitionByRange(tasks, "path", "offset")
            .sortWithinPartitions("path", "offset").mapInPandas(run, schema))


def archive_and_read(pages: DataFrame, folder: str | None = None, payloads: bool = False) -> DataFrame:
    folder = folder or scratch(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder), payloads)
