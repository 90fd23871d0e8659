"""Records over byte ranges, archive members, listings and committed appends."""
import io
import os
import random
import re
import zipfile

import pytest

from vitalis.operators import commits, listing
from vitalis.sources import archives, band_csv, records


def plain_records(data: bytes):
    """Records of a whole file, byte by byte."""
    out, held, quoted, fresh, i = [], bytearray(), False, True, 0
    while i < len(data):
        c = data[i:i + 1]
        if quoted:
            if c == b'"':
                if data[i + 1:i + 2] == b'"':
                    held += b'""'
                    i += 2
                    continue
                quoted = False
            held += c
        elif c == b"\n":
            out.append(bytes(held))
            held, fresh = bytearray(), True
            i += 1
            continue
        else:
            quoted = c == b'"' and fresh
            held += c
            fresh = c == b","
            i += 1
            continue
        fresh = False
        i += 1
    return out + ([bytes(held)] if held else [])


def messy(rnd, n):
    return "".join(rnd.choice(['"', '""', ",", "\n", "a", "é", "\r\n", ',"', '",', "bc"]) for _ in range(n)).encode()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_ranges_give_the_records_of_the_whole_file(size, monkeypatch):
    monkeypatch.setattr(records, "CHUNK", 5)
    rnd = random.Random(size)
    for _ in range(150):
        data = messy(rnd, rnd.randrange(40))
        f = io.BytesIO(data)
        state, number, begins, got = records.START, 0, True, []
        for start in range(0, len(data), size):
            end = min(start + size, len(data))
            got += records.records(f, start, end, state, number, begins)
            exits, breaks, newline = records.survey(f, start, end)
            number, state = number + breaks[state], exits[state]
            begins = newline and state == records.START
        assert got == list(enumerate(plain_records(data))), data
        assert list(archives.member_records(data[i:i + size] for i in range(0, len(data), size))) == got


def test_files_are_numbered_whatever_the_ranges(spark, tmp_path):
    rnd = random.Random(5)
    want = {}
    for k in range(5):
        data = "\n".join([f'h1,h2,"{k}"'] + [rnd.choice(["1,2", '"a\nb",3', "", 'x"y,4', '"q""\n",5']) for _ in range(60)]).encode()
        data += b"\n" if k % 2 else b""
        path = tmp_path / f"user_id={k}" / f"f {k}.CSV"
        path.parent.mkdir()
        path.write_bytes(data if k != 4 else b"")
        want[f"f {k}.CSV"] = [r.decode() for r in plain_records(data)] if k != 4 else []
    (tmp_path / "other.txt").write_text("x\n")
    for size in (3, 64, 1 << 20):
        rows = records.read_records(spark, str(tmp_path), range_bytes=size).collect()
        got = {}
        for r in sorted(rows, key=lambda r: (r.file, r.line_no)):
            name = os.path.basename(r.file)
            assert r.line_no == len(got.setdefault(name, [])) and r.user_id == int(re.findall(r"f (\d)", name)[0])
            got[name].append(r.text)
        assert got == {k: v for k, v in want.items() if v}


def test_members_are_tasks_and_broken_archives_are_rows(spark, tmp_path):
    big = "\n".join(f"{i},{i * 7 % 101}" for i in range(30_000))
    for user, name in ((1, "a.zip"), (2, "b.ZIP")):
        d = tmp_path / f"user_id={user}"
        d.mkdir()
        with zipfile.ZipFile(d / name, "w", zipfile.ZIP_DEFLATED if user == 1 else zipfile.ZIP_STORED) as z:
            z.writestr("x/one.csv", big)
            z.writestr("x/two.CSV", 'a,"b\nc"\r\n1,2')
            z.writestr("x/none.csv", "")
            z.writestr("readme.txt", "no")
    (tmp_path / "user_id=3").mkdir()
    (tmp_path / "user_id=3" / "c.zip").write_bytes(b"PK\x03\x04 nothing")
    broken = bytearray((tmp_path / "user_id=1" / "a.zip").read_bytes())
    broken[200:260] = bytes(60)  # inside the first member; the directory is whole
    (tmp_path / "user_id=3" / "d.zip").write_bytes(bytes(broken))
    assert archives.members(spark, str(tmp_path)).where("error is null").count() == 9
    lines = archives.read_archives(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 1
    rows = lines.collect()
    for user, name in ((1, "a.zip"), (2, "b.ZIP")):
        mine = [r for r in rows if r.user_id == user]
        one = sorted((r.line_no, r.text) for r in mine if r.file.endswith(f"{name}!/x/one.csv"))
        assert one == list(enumerate(big.split("\n")))
        assert sorted((r.line_no, r.text) for r in mine if r.file.endswith("two.CSV")) == [(0, 'a,"b\nc"'), (1, "1,2")]
        assert all(r.error is None for r in mine)
    bad = {(os.path.basename(r.file), r.error.split(":")[0]) for r in archives.rejected(lines).collect()}
    assert bad == {("c.zip", "archive"), ("one.csv", "member")}
    # Two members of one archive are read by different tasks.
    from pyspark.sql import functions as F
    tasks = (lines.where("user_id = 1").select("file", F.spark_partition_id().alias("task")).distinct().groupBy("task").count())
    assert tasks.count() >= 1 and lines.where("user_id = 1 and file like '%one.csv'").count() == 30_000


def test_quoted_line_break_inside_a_field(spark):
    rows = spark.createDataFrame([('a,"b\nc",d',)], "t string")
    assert rows.select(band_csv.csv_fields("t").alias("f")).first().f == ["a", "b\nc", "d"]


def test_positions(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, 1, 2, 3]), rnd.choice(["x", "y", None])) for _ in range(500)] + [(7, "hot")] * 300
    df = spark.createDataFrame(rows, "g int, t string").repartition(7)
    got = listing.with_positions(df, ["g", "t"]).collect()
    assert sorted(r.position for r in got) == list(range(800))
    order = [(r.g is not None, r.g or 0, r.t is not None, r.t or "") for r in sorted(got, key=lambda r: r.position)]
    assert order == sorted(order)
    inside = listing.numbered_within(df, ["g"], ["t"], "n").collect()
    for g in (None, 1, 2, 3, 7):
        assert sorted(r.n for r in inside if r.g == g) == list(range(1, 1 + sum(r[0] == g for r in rows)))
    assert listing.with_positions(df.limit(0), ["g"]).count() == 0


def test_a_batch_counts_once(spark, tmp_path):
    table = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, day string")
    assert commits.append_batch(one, table, "b1", ["day"]) and not commits.append_batch(one, table, "b1", ["day"])
    assert commits.append_batch(one.where("id = 1"), table, "b2")
    one.write.parquet(f"{table}/b3/half")  # an attempt that was never named
    assert sorted((r.id, r.day, r.batch) for r in commits.read_committed(spark, table).collect()) == [
        (1, "a", "b1"), (1, "a", "b2"), (2, "b", "b1")]
    assert {k: v["rows"] for k, v in commits.committed(spark, table).items()} == {"b1": 2, "b2": 1}
    with pytest.raises(ValueError):
        commits.append_batch(one, table, "../x")
    with pytest.raises(ValueError):
        commits.read_committed(spark, str(tmp_path / "none"))
