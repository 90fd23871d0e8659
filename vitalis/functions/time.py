"""Time expressions: band export timestamps, offsets, week boundaries."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col, strip

OFFSET_PATTERN = r"UTC([+-])(\d{2})(\d{2})"


def offset_minutes(time_offset) -> Column:
    """``UTC+0530`` -> 330, ``UTC-0800`` -> -480; no match (``UTC+05:30``,
    NULL) -> 0."""
    t = F.coalesce(col(time_offset).cast("string"), F.lit(""))
    sign = F.regexp_extract(t, OFFSET_PATTERN, 1)
    hh = F.regexp_extract(t, OFFSET_PATTERN, 2)
    mm = F.regexp_extract(t, OFFSET_PATTERN, 3)
    mins = hh.try_cast("int") * 60 + mm.try_cast("int")
    return (F.when(sign == "+", mins).when(sign == "-", -mins).otherwise(F.lit(0))).cast("int")


def parse_band_time(raw) -> Column:
    """Text or number -> TIMESTAMP_NTZ. Digits only = epoch milliseconds;
    anything else is parsed as a date-time text; unparsable -> NULL."""
    s = strip(col(raw).cast("string"))
    # Up to 15 digits: beyond (over 31,000 years) the time is missing.
    digits = s.rlike(r"^-?[0-9]+(\.0+)?$")
    ms = F.when(s.rlike(r"^-?[0-9]{1,15}(\.0+)?$"), s.try_cast("double").try_cast("long"))
    as_ms = F.timestamp_millis(ms).cast("timestamp_ntz")
    as_text = F.try_to_timestamp(s).cast("timestamp_ntz")
    return F.when(ms.isNotNull(), as_ms).when(~digits, as_text)


def shift_minutes(ts, minutes) -> Column:
    return col(ts) + F.make_dt_interval(mins=col(minutes))


def micros_between(start, end) -> Column:
    """end - start in microseconds (exact, BIGINT)."""
    return F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))


def week_start(day) -> Column:
    """Monday of the week containing ``day`` (DATE)."""
    return F.date_trunc("week", col(day)).cast("date")


def epoch_day(day) -> Column:
    """Days since 1970-01-01, the integer order key for day-range windows."""
    return F.unix_date(col(day).cast("date"))
