"""Declared tables: what does not fit becomes a quarantined row."""
import datetime as dt

import pytest

from vitalis.sources import schemas


def test_reasons(spark):
    lines = ['{"user_id": 1, "date": "2024-01-02", "kg": 70.5}', '{"user_id": 1, "date": "2024-01-03", "kg": "heavy"}',
             '{"user_id": 1, "date": "2024-01-04", "kg": null, "other": [1]}', '{"user_id": 1, "date": "2024-01-0', "", None, "[]x",
             '{"user_id": 1, "kg": 70}', '{"user_id": "one", "date": "2024-01-05", "kg": 70}',
             '{"user_id": 1, "date": "2024-13-45", "kg": 70}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, value string")
    got = {r.n: r for r in schemas.parse_lines(df, "weights").collect()}
    assert {n: r.reason for n, r in got.items()} == {
        0: None, 1: "unreadable", 2: None, 3: "unreadable", 4: "unreadable", 5: "unreadable", 6: "unreadable",
        7: "key missing", 8: "unreadable", 9: "unreadable"}
    assert (got[0].user_id, got[0].date, got[0].kg) == (1, dt.date(2024, 1, 2), 70.5) and got[2].kg is None
    assert [got[n]._raw for n in range(10)] == lines


@pytest.mark.parametrize("name", sorted(schemas.TABLES))
def test_every_table_takes_its_own_rows(spark, tmp_path, name):
    """A row of every table, written as JSON and read back, is the same; an empty
    object lacks its key."""
    t = schemas.TABLES[name]
    assert set(t.key) <= set(t.schema.names)
    samples = {"bigint": 7, "int": 3, "double": 2.5, "string": "a \"b\"", "date": dt.date(2024, 2, 29),
               "timestamp_ntz": dt.datetime(2024, 2, 29, 12, 30, 1), "map<string,double>": {"cup": 240.0}}
    row = tuple(samples[f.dataType.simpleString()] for f in t.schema)
    spark.createDataFrame([row], t.schema).write.json(str(tmp_path / "rows"))
    spark.createDataFrame([("{}",)], "value string").write.text(str(tmp_path / "rows2"))
    good, bad = schemas.read_declared(spark, str(tmp_path / "rows"), name)
    assert good.schema.simpleString() == t.schema.simpleString()
    assert [tuple(r) for r in good.collect()] == [row] and bad.count() == 0
    good, bad = schemas.read_declared(spark, str(tmp_path / "rows2"), name)
    assert good.count() == 0 and [r.reason for r in bad.collect()] == ["key missing"]


def test_columns_of_the_lines_are_carried(spark):
    df = spark.createDataFrame([("f", "x", '{"user_id": 2, "name": "b", "sex": "x"}')], "file string, sex string, value string")
    r = schemas.parse_lines(df, "profile").collect()[0]
    assert (r.file, r.user_id, r.name, r.sex, r.reason) == ("f", 2, "b", "x", None)
