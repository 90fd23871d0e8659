"""Declared tables: columns, types and keys, and a reader of JSON lines that keeps to
them. A line that is no JSON object, holds a value of another type or lacks a key column
does not fail the load and is not coerced: it becomes a quarantined row with its text
and the reason. Every table has ``user_id`` beside the columns of the single-user
original; names and types of those are fixed values.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = "_raw"


@dataclass(frozen=True)
class Table:
    columns: str
    key: tuple[str, ...]

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)


TABLES = {
    "profile": Table("user_id long, name string, age int, sex string, height_cm double, activity string, "
                     "deficit_pct double, protein_g_per_kg double", ("user_id",)),
    "weights": Table("user_id long, date date, kg double", ("user_id", "date")),
    "food_log": Table("user_id long, id long, date date, meal string, item string, quantity double, unit string, "
                      "grams double, kcal double, protein double, carbs double, fat double, source string", ("user_id", "id")),
    "custom_foods": Table("user_id long, name string, kcal double, protein double, carbs double, fat double, "
                          "units map<string, double>", ("user_id", "name")),
    "supplements": Table("user_id long, id long, name string, dose string, timing string, active int", ("user_id", "id")),
    "supplement_log": Table("user_id long, date date, supplement_id long, taken int", ("user_id", "date", "supplement_id")),
    "workout_plan": Table("user_id long, plan_json string, created timestamp_ntz", ("user_id",)),
    "workout_log": Table("user_id long, id long, date date, exercise string, sets int, reps int, weight_kg double, "
                         "rpe double, notes string", ("user_id", "id")),
    "band_daily": Table("user_id long, date date, sleep_hours double, sleep_score double, resting_hr double, steps long, "
                        "stress double", ("user_id", "date")),
    "lab_results": Table("user_id long, id long, test_date date, marker string, value double, unit string, ref_low double, "
                         "ref_high double, source_file string", ("user_id", "id")),
    "coach_notes": Table("user_id long, week_start date, note string, created timestamp_ntz", ("user_id", "week_start")),
}


def parse_lines(lines: DataFrame, name: str, text: str = "value") -> DataFrame:
    """``lines`` with their JSON text read as a row of table ``name``: other columns of
    ``lines``, the columns of the table, ``_raw`` (the text) and ``reason`` (null for a
    good row; else ``unreadable``, for bad JSON and wrong types, or ``key missing``).
    A null or blank text is unreadable; columns absent from a text are null, unknown
    ones are ignored."""
    t = TABLES[name]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema)
    row = F.from_json(text, f"{fields}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    rest = [c for c in lines.columns if c != text and c not in t.schema.names]
    # Behind a generator: a text is parsed once, whatever is then asked of its row.
    parsed = lines.select(*rest, F.col(text).alias(RAW), F.inline(F.array(F.struct(row.alias("_row")))))
    blank = F.coalesce(F.trim(F.col(RAW)) == "", F.lit(True))
    lacks = F.lit(False)
    for k in t.key:
        lacks = lacks | F.col(f"_row.{k}").isNull()
    reason = (F.when(blank | F.col("_row").isNull() | F.col("_row._corrupt").isNotNull(), F.lit("unreadable"))
               .when(lacks, F.lit("key missing")))
    return parsed.select(*rest, *[F.col(f"_row.{c}").alias(c) for c in t.schema.names], RAW, reason.alias("reason"))


def read_declared(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(good rows with the declared columns, quarantined rows: ``_raw``, ``reason``) of
    the JSON-lines files under ``path``."""
    rows = parse_lines(spark.read.text(path), name)
    return (rows.where(F.col("reason").isNull()).select(*TABLES[name].schema.names),
            rows.where(F.col("reason").isNotNull()).select(RAW, "reason"))
