"""Wearable export CSVs -> per-kind daily frames.

Input is a line table ``(file, user_id, line_no, text)`` where ``line_no``
tells the first two lines of a file (0, 1) from the rest; it comes from
``read_lines`` (files on storage, numbers exact) or from any DataFrame of lines.

Per file, the first two lines decide the header: when line 0 has fewer commas
than line 1 it is a metadata line and line 1 is the header. Column names are
the text after the last ``.``, stripped; a repeated name keeps its first
position. Data lines are split into fields (commas outside quotes); fields past
the header are ignored, missing ones are NULL. The header step aggregates two
lines per file -- a table of one row per file -- and joins back on ``file``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import finite_number, strip
from ..functions.time import offset_minutes, parse_band_time, shift_minutes
from ..operators import band
from . import dims, records

BOM = "﻿"
# A comma outside double quotes.
_FIELD_SEP = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def csv_fields(line) -> Column:
    """CSV line -> array of fields: split on commas outside quotes, surrounding
    quotes removed and doubled quotes undone; empty fields are NULL."""
    t = F.col(line) if isinstance(line, str) else line
    quoted = F.transform(F.split(t, _FIELD_SEP), lambda x: F.regexp_replace(
        F.regexp_replace(x, r'(?s)^"(.*)"$', "$1"), '""', '"'))
    parts = F.when(F.instr(t, '"') > 0, quoted).otherwise(F.split(t, ","))
    return F.transform(parts, lambda x: F.when(x != "", x))


def route(file_col) -> Column:
    """Kind of an export file from its lower-cased base name (ordered tests):
    sleep / heart / steps / stress, else NULL (ignored)."""
    n = F.lower(F.regexp_extract(F.col(file_col) if isinstance(file_col, str) else file_col, r"[^/\\]+$", 0))
    sleep_ok = n.contains("sleep")
    for ex in dims.SLEEP_EXCLUDE:
        sleep_ok = sleep_ok & ~n.contains(ex)
    return (F.when(sleep_ok, "sleep")
             .when(n.contains("heart_rate") & ~n.contains("recovery"), "heart")
             .when(n.contains("step_daily_trend") | n.contains("pedometer_day_summary"), "steps")
             .when(n.contains("stress") & ~n.contains("histogram"), "stress"))


def read_lines(spark: SparkSession, path: str, range_bytes: int = records.RANGE_BYTES) -> DataFrame:
    """Export files under ``path`` (``.../user_id=<id>/<name>.csv``) as lines with
    their exact number in the file, however many ranges it is read in. A quoted line
    break does not end a line."""
    return records.read_records(spark, path, range_bytes=range_bytes)


def headers(lines: DataFrame) -> DataFrame:
    """One row per file: kind, data_from (first data line number) and the
    position (0-based) of each needed column, NULL when absent."""
    first2 = lines.where(F.col("line_no") < 2)
    h = first2.groupBy("file").agg(
        F.max(F.when(F.col("line_no") == 0, F.regexp_replace("text", "^" + BOM, ""))).alias("_l0"),
        F.max(F.when(F.col("line_no") == 1, F.col("text"))).alias("_l1"),
        F.count("*").alias("_n"))
    commas = lambda c: F.length(c) - F.length(F.regexp_replace(c, ",", ""))
    meta = F.col("_l1").isNotNull() & (commas("_l0") < commas("_l1"))
    header = F.when(meta, F.col("_l1")).otherwise(F.col("_l0"))
    names = F.transform(F.split(header, ","), lambda x: F.trim(F.element_at(F.split(x, r"\."), -1)))
    # Behind a generator: from a plain projection Spark takes the filter on the kind over
    # to the lines that are joined on the file, and routes every line by its file's name.
    h = h.where("_n >= 2").select("file", F.inline(F.array(F.struct(
        F.when(meta, 2).otherwise(1).alias("data_from"), names.alias("names"), route("file").alias("kind")))))

    def pos(name):
        return F.array_position("names", name).cast("int") - 1  # first occurrence; -1 when absent

    wanted = ["start_time", "end_time", "sleep_score", "time_offset", "heart_rate", "day_time", "count",
              "step_count", "score"]
    return (h.where(F.col("kind").isNotNull())
             .select("file", "kind", "data_from",
                     *[F.when(pos(w) >= 0, pos(w)).alias(f"p_{w}") for w in wanted]))


def _field(arr, p):
    return F.when(F.col(p).isNotNull(), F.try_element_at(arr, (F.col(p) + 1).cast("int")))


def parse_long(lines: DataFrame) -> DataFrame:
    """Lines -> long rows (file, user_id, day, kind, us, score, value) in one
    projection: sleep rows carry the session length in microseconds (offset
    shifted, 0 < hours < 16, day = local wake-up date); heart, steps and
    stress rows carry the reading and the local day. A file lacking a kind's
    required columns yields nothing."""
    # Merged: lines come out of readers whose size Spark takes for that of the short list
    # they read, and would be sent to the driver as the smaller side.
    h = headers(lines).hint("merge")  # one row a file
    body = lines.join(h, "file").where(F.col("line_no") >= F.col("data_from"))
    key_cols = ["file", "user_id"] if "user_id" in lines.columns else ["file"]
    kind = F.col("kind")
    step_pos = F.coalesce(F.col("p_count"), F.col("p_step_count"))
    required = (F.when(kind == "sleep", F.col("p_start_time").isNotNull() & F.col("p_end_time").isNotNull())
                 .when(kind == "heart", F.col("p_heart_rate").isNotNull() & F.col("p_start_time").isNotNull())
                 .when(kind == "steps", step_pos.isNotNull() & F.col("p_day_time").isNotNull())
                 .when(kind == "stress", F.col("p_score").isNotNull() & F.col("p_start_time").isNotNull())
                 .otherwise(F.lit(False)))
    time_pos = F.when(kind == "steps", F.col("p_day_time")).otherwise(F.col("p_start_time"))
    value_pos = (F.when(kind == "heart", F.col("p_heart_rate")).when(kind == "steps", step_pos)
                  .when(kind == "stress", F.col("p_score")).when(kind == "sleep", F.col("p_sleep_score")))
    # Each step hands on one row through a generator: a plain projection would be
    # copied into every use of its columns, and a line cut anew for each of them.
    rec = (body.where(required).withColumn("_time", time_pos).withColumn("_value", value_pos)
           .select(*key_cols, "kind", "p_end_time", "p_time_offset", "_time", "_value",
                   F.explode(F.array(csv_fields("text"))).alias("_a")))
    a = F.col("_a")
    rec = rec.select(*key_cols, "kind", F.inline(F.array(F.struct(
        _field(a, "_time").alias("_from"), F.when(kind == "sleep", _field(a, "p_end_time")).alias("_to"),
        offset_minutes(_field(a, "p_time_offset")).alias("_off"), strip(_field(a, "_value")).alias("_v")))))
    rec = rec.select(*key_cols, "kind", F.inline(F.array(F.struct(
        shift_minutes(parse_band_time("_from"), F.col("_off")).alias("_t0"),
        shift_minutes(parse_band_time("_to"), F.col("_off")).alias("_t1"), finite_number("_v").alias("_x")))))
    us = F.when(kind == "sleep", F.unix_micros(F.col("_t1").cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp")))
    day = F.when(kind == "sleep", F.to_date("_t1")).otherwise(F.to_date("_t0"))
    x = rec.select(*key_cols, day.alias("day"), "kind", us.alias("us"), F.when(kind == "sleep", F.col("_x")).alias("score"),
                   F.when(kind != "sleep", F.col("_x")).alias("value"))
    return x.where((F.col("kind") != "sleep")
                   | ((F.col("us") > 0) & (F.col("us") < 16 * band.MICROS_PER_HOUR)))


def per_file_daily(lines: DataFrame) -> DataFrame:
    """One row per (file, user, day) with the file's metrics."""
    keys = ("file", "user_id") if "user_id" in lines.columns else ("file",)
    return band.daily_metrics(parse_long(lines), keys=keys)


def daily_from_lines(lines: DataFrame) -> DataFrame:
    """Lines of one import -> merged daily table (max across files)."""
    return band.merge_daily(per_file_daily(lines))


def import_summary(lines: DataFrame) -> DataFrame:
    """Days saved and files used per user for one import."""
    return per_file_daily(lines).groupBy("user_id").agg(F.countDistinct("day").alias("days_saved"),
                                                        F.countDistinct("file").alias("files_used"))
