"""Records of delimited files over byte ranges, with exact record numbers.

A file of any size is cut into byte ranges that are tasks of their own. A record
belongs to the range it begins in, and is read to its end. Whether a line break ends
a record depends on the quotes before it: a field that begins with a quote runs to
the closing quote, over commas and line breaks (a doubled quote is one of its
characters); a quote anywhere else is an ordinary character. So each range is first
surveyed for all four states that it may begin in: the state at its end and the
record breaks inside. Folding these few numbers along a file gives each range its
state and the number of its first record; then the ranges are read. The ranges are
rows of a table, so both passes see the same ones whatever the cluster does between.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Published, filesystem, kept, listing

RANGE_BYTES = 64 << 20
#: Bytes of ranges that a task takes at least, where there are enough of them.
TASK_BYTES = 16 << 20
CHUNK = 1 << 20
BATCH_ROWS = 10_000
# Where a byte stands: at the start of a field, inside a plain one, inside a quoted
# one, behind a quote in a quoted one.
START, FIELD, QUOTED, QUOTE = range(4)
_SPECIAL = re.compile(rb'[",\n]')
_BREAK = re.compile(rb"\n")


def breaks(data: bytes, state: int) -> tuple[list[int], int]:
    """Places of the line breaks in ``data`` that end a record, and the state behind
    it, if ``state`` is the one before it."""
    if b'"' not in data:  # only line breaks count, and all or none of them
        if state == QUOTED or not data:
            return [], state
        return [m.start() for m in _BREAK.finditer(data)], START if data[-1:] in (b",", b"\n") else FIELD
    found: list[int] = []
    last = 0
    for m in _SPECIAL.finditer(data):
        p = m.start()
        if p > last and state in (START, QUOTE):
            state = FIELD
        last = p + 1
        c = data[p]
        if c == 34:
            state = (QUOTED, FIELD, QUOTE, QUOTED)[state]
        elif state != QUOTED:
            state = START
            if c == 10:
                found.append(p)
    if last < len(data) and state in (START, QUOTE):
        state = FIELD
    return found, state


def survey(f, start: int, end: int) -> tuple[list[int], list[int], bool]:
    """(state at the end, record breaks) for each state at the beginning of a byte
    range, and whether its last byte is a line break. States that have met stay
    together."""
    now, count = list(range(4)), [0] * 4
    f.seek(start)
    left, last = end - start, b""
    while left:
        data = f.read(min(CHUNK, left))
        if not data:
            break
        left -= len(data)
        last = data[-1:]
        done = {s: breaks(data, s) for s in set(now)}
        count = [n + len(done[s][0]) for n, s in zip(count, now)]
        now = [done[s][1] for s in now]
    return now, count, last == b"\n"


def records(f, start: int, end: int, state: int = START, number: int = 0, begins: bool = True):
    """(number, bytes) of the records that begin in a byte range. ``number`` is that
    of the record at ``start``; ``begins``: it begins there."""
    f.seek(start)
    pos, held = start, []
    taking = begins
    while True:
        data = f.read(CHUNK)
        if not data:
            break
        found, state = breaks(data, state)
        base = 0
        for p in found:
            if taking:
                held.append(data[base:p])
                yield number, b"".join(held)
            held, taking, base = [], True, p + 1
            number += 1
            if pos + base >= end:
                return
        if taking:
            held.append(data[base:])
        pos += len(data)
    if taking and any(held):
        yield number, b"".join(held)


def record_text(raw: bytes) -> str:
    """UTF-8, bytes that are none left out, without the CR of a CR LF."""
    return (raw[:-1] if raw.endswith(b"\r") else raw).decode("utf-8", errors="ignore")


LINES = "file string, user_id long, line_no long, text string"
USER = r"user_id=(\d+)"


def line_batches(rows):
    """(file, user_id, line_no, text) rows as record batches."""
    import pyarrow as pa
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    held: list = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)],
                                          names=["file", "user_id", "line_no", "text"])
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[3] or "")
        if len(held) >= BATCH_ROWS or size >= 8 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def user_of(path: str) -> int | None:
    m = re.search(USER, path)
    return int(m.group(1)) if m else None


def read_records(spark: SparkSession, path: str, pattern: str = "*.[cC][sS][vV]", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the files under ``path`` (``.../user_id=<id>/<name>.csv``): file,
    user_id (null without one in the path), line_no (from 0, exact) and text. Empty
    files have none; a line break at the end of a file begins no record. The files are
    surveyed and read once: the records are a written table."""
    files = listing(spark, path, pattern).where("length > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"),
                          "length").select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"))
    # Ranges are dealt by bytes; their rows are too small for Spark to see the work.
    size, n = files.agg(F.sum("length"), F.sum(F.ceil(F.col("length") / range_bytes))).first()
    cores = max(8, 2 * spark.sparkContext.defaultParallelism)
    tasks = max(1, min(-(-(size or 0) // max(range_bytes, TASK_BYTES)), 100_000), min(cores, n or 0))

    def surveyed(frames):
        import pandas as pd
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                system, name = filesystem(r.path)
                with system.open_input_file(name) as source:
                    rows.append((r.path, r.start, r.end, *survey(source, r.start, r.end)))
            yield pd.DataFrame(rows, columns=["path", "start", "end", "exits", "breaks", "newline"])

    def folded(frames):
        import pandas as pd
        now, state, number, begins = None, START, 0, True
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                if r.path != now:
                    now, state, number, begins = r.path, START, 0, True
                out.append((r.path, r.start, r.end, state, number, begins))
                number += int(r.breaks[state])
                state = int(r.exits[state])
                begins = bool(r.newline) and state == START
            yield pd.DataFrame(out, columns=["path", "start", "end", "state", "number", "begins"])

    def read(frames):
        def rows():
            for b in frames:
                for r in b.to_pylist():
                    user = user_of(r["path"])
                    system, name = filesystem(r["path"])
                    with system.open_input_file(name) as source:
                        for n, raw in records(source, r["start"], r["end"], r["state"], r["number"], r["begins"]):
                            yield r["path"], user, n, record_text(raw)
        yield from line_batches(rows())

    plan = (ranges.repartition(tasks, "path", "start")
            .mapInPandas(surveyed, "path string, start long, end long, exits array<int>, breaks array<long>, newline boolean")
            .repartition("path").sortWithinPartitions("path", "start").mapInPandas(folded, "path string, start long, end long, state int, number long, begins boolean"))
    return kept(spark, plan.repartition(tasks, "path", "start").mapInArrow(read, LINES), "lines")


def write_lines(lines: DataFrame, root: str) -> int:
    """Write (file, line_no, text) rows as files under ``root``, one task a file,
    lines in order; the number of files. A repeated attempt replaces its file."""
    def write(batches):
        import pyarrow as pa
        now, out, n = None, None, 0
        for b in batches:
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if file != now:
                    if out is not None:
                        out.__exit__(None, None, None)
                    now, out, n = file, Published(f"{root}/{file}"), n + 1
                out.out.write((text + "\n").encode())
        if out is not None:
            out.__exit__(None, None, None)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["files"])

    done = (lines.repartition("file").sortWithinPartitions("file", "line_no").select("file", "text")
            .mapInArrow(write, "files long"))
    return done.agg(F.sum("files")).first()[0] or 0
