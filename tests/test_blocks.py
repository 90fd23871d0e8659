"""Windows over blocks of days give what windows over whole histories give."""
import datetime as dt
import random

from pyspark.sql import functions as F

from vitalis.operators import band, blocks, weights

EPOCH = dt.date(1970, 1, 1)
SCHEMA = "user_id long, day date, kg double"


def _weights(spark, seed=3):
    rnd = random.Random(seed)
    rows = []
    for user in (1, 2, None):
        for n in sorted(rnd.sample(range(-40, 160), 90)):
            rows.append((user, EPOCH + dt.timedelta(days=n), None if n % 9 == 0 else float(60 + n % 7)))
    rows += [(3, EPOCH, 70.0), (4, EPOCH, 70.0), (4, EPOCH + dt.timedelta(days=150), 71.0)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_rolling_over_blocks(spark):
    rows, df = _weights(spark)
    want = {}
    for user, day, kg in rows:
        mine = [(d, k) for u, d, k in rows if u == user]
        near = [k for d, k in mine if k is not None and 0 <= (day - d).days <= 6]
        if len(mine) >= 2:
            want[(user, day)] = (kg, sum(near) / len(near) if near else None)
    for days in (5, 16, 1024):
        got = {(r.user_id, r.day): (r.kg, r.avg_7d) for r in weights.rolling_7d(df, days).collect()}
        assert got.keys() == want.keys()
        for key, (kg, mean) in want.items():
            assert got[key][0] == kg and (got[key][1] == mean or abs(got[key][1] - mean) < 1e-12), key


def test_asof_over_blocks(spark):
    rows, df = _weights(spark)
    points = [(u, EPOCH + dt.timedelta(days=n)) for u in (1, 2, 3, 4, 5) for n in range(-60, 400, 13)]
    pts = spark.createDataFrame(points, "user_id long, point_day date")
    want = {}
    for user, day in points:
        seen = [(d, k) for u, d, k in rows if u == user and d <= day and k is not None]
        want[(user, day)] = max(seen)[1] if seen else None
    for size in (3, 20, 1024):
        got = {(r.user_id, r.point_day): r.asof_kg for r in weights.asof(df, pts, block_days=size).collect()}
        assert got == want


def test_readiness_is_the_same_for_all_block_lengths(spark):
    rnd = random.Random(5)
    rows = [(1, EPOCH + dt.timedelta(days=n), 7.0, 80.0, float(50 + rnd.randrange(20)), 1000, 30.0) for n in range(-30, 90) if n % 4]
    daily = spark.createDataFrame(rows, f"user_id long, day date, sleep_hours double, sleep_score double, resting_hr double, "
                                        "steps long, stress double")
    whole = sorted(map(tuple, band.readiness(daily, block_days=100_000).collect()))
    assert len(whole) == len(rows)
    for days in (4, 15, 64):
        assert sorted(map(tuple, band.readiness(daily, block_days=days).collect())) == whole


def test_a_long_history_is_spread_over_blocks(spark):
    """One user with a million days: no block holds more than its days and its margin."""
    days = spark.range(1_000_000).select(F.lit(1).cast("long").alias("user_id"), F.expr("date_add(date'1000-01-01', cast(id as int))").alias("day"),
                                         (F.col("id") % 7).cast("double").alias("kg"))
    sizes = blocks.with_margin(days, "day", 6).groupBy("_block").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= blocks.BLOCK_DAYS + 6 and sizes[1] >= 976
    total = weights.rolling_7d(days).where("avg_7d = 3.0").count()
    # The first six rows have shorter windows; of them only the mean of 0..6 is 3 exactly.
    assert total == 1_000_000 - 6
