"""Band import stream: two imports, coalescing upsert, replay safety."""
import datetime as dt
import os
import tempfile

from vitalis.streaming import band_stream


def _write(root, uid, name, lines):
    d = os.path.join(root, f"user_id={uid}")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_two_imports_coalesce(spark):
    root = tempfile.mkdtemp(prefix="vitalis-stream-in-")
    table = tempfile.mkdtemp(prefix="vitalis-stream-tbl-")
    p = "com.samsung.health.sleep."
    _write(root, 7, "com.samsung.shealth.sleep.csv",
           ["meta,1", f"{p}start_time,{p}end_time,{p}sleep_score", "2024-01-01 23:00:00,2024-01-02 06:00:00,80"])
    q = band_stream.start(spark, root, table_root=table, name="t1")
    q.awaitTermination(120)
    snap = band_stream.latest_snapshot(spark, table).collect()
    assert [(r.user_id, str(r.day), r.sleep_hours, r.sleep_score, r.steps) for r in snap] == \
        [(7, "2024-01-02", 7.0, 80.0, None)]

    # Second import: a steps file for the same day; sleep must survive.
    _write(root, 7, "com.samsung.shealth.step_daily_trend.csv",
           ["meta", "day_time,count", "2024-01-02 00:00:00,1200", "2024-01-02 00:00:00,900"])
    q = band_stream.start(spark, root, table_root=table, name="t1")
    q.awaitTermination(120)
    snap = band_stream.latest_snapshot(spark, table).collect()
    assert [(r.sleep_hours, r.steps) for r in snap] == [(7.0, 1200)]
    assert len(band_stream.versions(spark, table)) == 2


def test_files_of_one_import_in_two_batches_give_the_maximum(spark):
    root = tempfile.mkdtemp(prefix="vitalis-stream-in-")
    table = tempfile.mkdtemp(prefix="vitalis-stream-tbl-")

    def steps(import_id, name, n):
        _write(os.path.join(root, f"import_id={import_id}"), 7, f"{name}.step_daily_trend.csv",
               ["meta", "day_time,count", f"2024-01-02 00:00:00,{n}"])
        band_stream.start(spark, root, table_root=table, name="t2").awaitTermination(120)
        return [r.steps for r in band_stream.latest_snapshot(spark, table).collect()]

    assert steps(1, "a", 1200) == [1200]
    assert steps(1, "b", 900) == [1200]  # same import, later batch: the maximum stands
    assert steps(2, "c", 500) == [500]  # a new import replaces
    assert len(band_stream.versions(spark, table)) == 3


def _batch(spark, table, n, rows):
    """A batch of one file: its per-day rows as the stream writes them."""
    data = [(imp, n, f"f{n}", u, dt.date(2024, 1, d), None, None, None, steps, None) for imp, u, d, steps in rows]
    spark.createDataFrame(data, band_stream.FILE_SCHEMA).write.mode("overwrite").parquet(f"{table}/v{n:09d}")


def test_parts_grow_with_the_logarithm_of_the_batches(spark):
    table = tempfile.mkdtemp(prefix="vitalis-stream-tbl-")
    want, most = {}, 0
    for n in range(30):
        rows = [(n // 4, 1, 1, 100 - n), (n // 4, 1, n % 28 + 1, n), (n, 2, n % 5 + 1, None if n % 2 else n)]
        _batch(spark, table, n, rows)
        band_stream.compact(spark, table, fanout=3)
        for imp, u, d, steps in rows:
            if steps is not None:
                old = want.get((u, d), (-1, 0))
                want[(u, d)] = max(old, (imp, steps))
            else:
                want.setdefault((u, d), (-1, None))
        now = band_stream.parts(spark, table)
        most = max(most, len(now))
        assert band_stream.versions(spark, table) == list(range(n + 1))
    assert most <= 8 and [(p.first, p.last) for p in now] == [(0, 26), (27, 29)]
    got = {(r.user_id, r.day.day): r.steps for r in band_stream.latest_snapshot(spark, table).collect()}
    assert got == {k: v for k, (_, v) in want.items()}
    # What the merges cover goes one merge later; a batch run again changes nothing.
    assert len([d for d in os.listdir(table) if d.startswith("v")]) <= 6
    _batch(spark, table, 2, [(99, 1, 1, 5)])
    assert {(r.user_id, r.day.day): r.steps for r in band_stream.latest_snapshot(spark, table).collect()} == got


def test_a_merge_cut_short_is_not_read(spark):
    table = tempfile.mkdtemp(prefix="vitalis-stream-tbl-")
    for n in range(3):
        _batch(spark, table, n, [(n, 1, 1, n)])
    os.makedirs(f"{table}/m1-000000000-000000002")
    assert [p.level for p in band_stream.parts(spark, table)] == [0, 0, 0]
    assert band_stream.compact(spark, table, fanout=3) == 1
    assert [p.level for p in band_stream.parts(spark, table)] == [1]
    assert [r.steps for r in band_stream.latest_snapshot(spark, table).collect()] == [2]


def test_a_numbered_batch_is_not_numbered_again(spark):
    rows = [("meta", 7, "f", 0, 10), ("a,b", 7, "f", 0, 11), ("1,2", 7, "f", 0, 12)]
    batch = spark.createDataFrame(rows, "value string, user_id long, file string, _blk long, _id long")
    out = band_stream.lines_of_batch(batch)
    assert sorted((r.line_no, r.text) for r in out.collect()) == [(0, "meta"), (1, "a,b"), (2, "1,2")]
    assert "monotonically_increasing_id" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_small_files_share_tasks(spark, monkeypatch):
    """A batch of many small files is a few tasks, not one for every few files; the settings
    for it are the stream's own."""
    root = tempfile.mkdtemp(prefix="vitalis-stream-in-")
    table = tempfile.mkdtemp(prefix="vitalis-stream-tbl-")
    for user in range(200):
        _write(root, user, "com.samsung.shealth.step_daily_trend.csv",
               ["meta", "day_time,count", f"2024-01-02 00:00:00,{user}", "2024-01-02 00:00:00,0"])
    tasks, numbered, cost = [], band_stream.lines_of_batch, spark.conf.get("spark.sql.files.openCostInBytes")

    def counted(batch):
        tasks.append(batch.rdd.getNumPartitions())
        return numbered(batch)
    monkeypatch.setattr(band_stream, "lines_of_batch", counted)
    band_stream.start(spark, root, table_root=table, name="t-small").awaitTermination(120)
    assert len(tasks) == 1 and tasks[0] <= 8
    assert sorted((r.user_id, r.steps) for r in band_stream.latest_snapshot(spark, table).collect()) == [(u, u) for u in range(200)]
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost
