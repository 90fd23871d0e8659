"""Band exports read from real files: plain CSVs and zip uploads."""
import os
import tempfile
import zipfile
from types import SimpleNamespace

from vitalis.sources import archives, band_csv

P = "com.samsung.health.sleep."
SLEEP = ["com.samsung.shealth.sleep,1", f"{P}start_time,{P}end_time,{P}sleep_score",
         "2024-01-01 23:00:00,2024-01-02 06:30:00,70", "2024-01-02 14:00:00,2024-01-02 15:00:00,"]
HEART = ["meta", "com.samsung.health.heart_rate.start_time,com.samsung.health.heart_rate.heart_rate"] + \
        [f"2024-01-02 0{h}:00:00,{v}" for h, v in enumerate([50, 51, 52, 60, 61, 70])]


def test_read_csv_files(spark):
    root = tempfile.mkdtemp(prefix="vitalis-files-")
    d = os.path.join(root, "user_id=4")
    os.makedirs(d)
    for name, lines in [("com.samsung.shealth.sleep.csv", SLEEP),
                        ("com.samsung.shealth.tracker.heart_rate.csv", HEART),
                        ("com.samsung.shealth.sleep_stage.csv", SLEEP)]:
        with open(os.path.join(d, name), "w") as f:
            f.write("\n".join(lines) + "\n")
    rows = band_csv.daily_from_lines(band_csv.read_lines(spark, root)).collect()
    assert [(r.user_id, str(r.day), r.sleep_hours, r.sleep_score, r.resting_hr) for r in rows] == \
        [(4, "2024-01-02", 8.5, 70.0, 50.25)]


def test_read_zip_uploads(spark):
    root = tempfile.mkdtemp(prefix="vitalis-zips-")
    d = os.path.join(root, "user_id=9")
    os.makedirs(d)
    with zipfile.ZipFile(os.path.join(d, "export.ZIP"), "w") as z:
        z.writestr("export/com.samsung.shealth.sleep.CSV", "\n".join(SLEEP))
        z.writestr("export/readme.txt", "ignored")
        z.writestr("export/com.samsung.shealth.tracker.heart_rate.csv", "\n".join(HEART))
    lines = archives.read_archives(spark, root)
    rows = band_csv.daily_from_lines(lines).collect()
    assert [(r.user_id, str(r.day), r.sleep_hours, r.resting_hr) for r in rows] == [(9, "2024-01-02", 8.5, 50.25)]


def test_many_archives_share_tasks(spark, tmp_path):
    """Directories of archives are read many to a task, from a listing made in tasks."""
    for user in range(40):
        d = tmp_path / "a" / f"user_id={user}"
        d.mkdir(parents=True)
        with zipfile.ZipFile(d / "export.zip", "w") as z:
            z.writestr("export/com.samsung.shealth.sleep.csv", "\n".join(SLEEP))
    (tmp_path / "a" / "_hidden").mkdir()
    (tmp_path / "a" / "_hidden" / "export.zip").write_bytes(b"no archive")
    (tmp_path / "a" / ".part.zip").write_bytes(b"no archive")
    found = archives.members(spark, str(tmp_path))
    assert sorted(r.user_id for r in found.collect()) == list(range(40))
    assert found.rdd.getNumPartitions() < 40
    again = archives.members(spark, "file:" + str(tmp_path) + "/").select("path").collect()
    assert all(r.path.startswith("file:/") and r.path.endswith("/export.zip") for r in again) and len(again) == 40


def test_a_task_takes_few_packed_bytes(spark):
    """Sorted, repeated keys unpack to some 60 times their shuffled size in a task."""
    from vitalis.session import _DEFAULTS
    assert int(_DEFAULTS["spark.sql.adaptive.advisoryPartitionSizeInBytes"].rstrip("m")) <= 16
    assert int(_DEFAULTS["spark.sql.files.maxPartitionBytes"].rstrip("m")) <= 32


def test_export_lines_number_their_files_once(spark):
    """One window over the readings: the first lines of a file come with its first reading."""
    from vitalis.sources import fixtures as fx
    plan = fx.band_export_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1


def _archive(root, user, lines):
    d = root / f"user_id={user}"
    d.mkdir(parents=True)
    with zipfile.ZipFile(d / "export.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("export/com.samsung.shealth.sleep.csv", "\n".join(lines))


def test_lines_of_small_lists_are_not_broadcast(spark, tmp_path):
    """The lines that tasks read are many times the list of archives they are read from,
    which is the size Spark takes for theirs: they meet their headers in a merge join, and
    their file names are routed once a file."""
    _archive(tmp_path, 1, SLEEP[:2] + SLEEP[2:3] * 5_000)
    daily = band_csv.daily_from_lines(archives.read_archives(spark, str(tmp_path)))
    assert [(str(r.day), r.sleep_score) for r in daily.collect()] == [("2024-01-02", 70.0)]
    run = daily._jdf.queryExecution()
    assert "Broadcast" not in run.executedPlan().toString()
    assert not [x for x in run.optimizedPlan().toString().splitlines() if "Filter" in x and "regexp_extract" in x]


def test_archives_are_read_once(spark, tmp_path):
    _archive(tmp_path, 1, SLEEP)
    lines = archives.read_archives(spark, str(tmp_path)).where("error is null")
    (tmp_path / "user_id=1" / "export.zip").write_bytes(b"another upload")
    assert lines.count() == 4 and band_csv.import_summary(lines).first().days_saved == 1


def test_files_are_read_once_and_not_broadcast(spark, tmp_path):
    d = tmp_path / "user_id=4"
    d.mkdir()
    path = d / "com.samsung.shealth.sleep.csv"
    path.write_text("\n".join(SLEEP[:2] + SLEEP[2:3] * 5_000) + "\n")
    lines = band_csv.read_lines(spark, str(tmp_path), range_bytes=1 << 14)
    path.write_text("another\nupload\n")
    daily = band_csv.daily_from_lines(lines)
    assert [(str(r.day), r.sleep_score) for r in daily.collect()] == [("2024-01-02", 70.0)]
    assert lines.count() == 5_002 and lines.agg({"line_no": "max"}).first()[0] == 5_001
    assert "Broadcast" not in daily._jdf.queryExecution().executedPlan().toString()


def test_broadcasts_follow_measured_sizes(spark, tmp_path):
    """Rows that their file packs to a few bytes are many times that in the driver: they are
    not broadcast by the size of the file. A bound that a cluster sets holds for both sizes."""
    from vitalis.session import _ESTIMATED, _MEASURED, apply_defaults
    path = str(tmp_path / "packed")
    spark.range(400_000).selectExpr("id as k", "repeat('x', 60) as text").coalesce(1).write.parquet(path)
    assert 256 << 10 < sum(f.stat().st_size for f in (tmp_path / "packed").glob("*.parquet")) < 8 << 20
    a, b = spark.read.parquet(path), spark.read.parquet(path).withColumnRenamed("text", "other")
    both = a.join(b, "k").where("text = other")
    assert both.count() == 400_000 and len(both.take(1)) == 1
    plan = both._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    class Conf(dict):  # a session that a cluster has given its own bound
        set = dict.__setitem__
    own = SimpleNamespace(conf=Conf({_ESTIMATED: "1m"}))
    apply_defaults(own)
    assert own.conf[_ESTIMATED] == "1m" and _MEASURED not in own.conf
    own.conf = Conf()
    apply_defaults(own)
    apply_defaults(own)
    assert (own.conf[_ESTIMATED], own.conf[_MEASURED]) == ("256k", "16m")
