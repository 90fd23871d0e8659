"""Blood-test operators: flags, latest report, trends, report text checks,
chunking and first-row dedupe of extracted results."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import col, nan_to_null, strip

CHUNK_CHARS = 6000
MIN_TEXT_CHARS = 50


def flag(value, ref_low, ref_high):
    """Low if a low bound exists and value < it; else High if a high bound
    exists and value > it; else In range (bounds inclusive)."""
    v, lo, hi = nan_to_null(value), col(ref_low), col(ref_high)
    return (F.when(lo.isNotNull() & (v < lo), "Low")
             .when(hi.isNotNull() & (v > hi), "High")
             .otherwise("In range"))


def with_flag(results: DataFrame) -> DataFrame:
    return results.withColumn("flag", flag("value", "ref_low", "ref_high"))


def latest_report(results: DataFrame) -> DataFrame:
    """All rows of each user's latest test date. The per-user max date is a
    small aggregate joined back on (user_id, test_date), so a heavy user's
    rows stay spread over their dates."""
    last = results.groupBy("user_id").agg(F.max("test_date").alias("test_date"))
    return results.join(last, ["user_id", "test_date"])


def trend(results: DataFrame) -> DataFrame:
    """Per (user, marker, test date) the values of the trend chart: count, bounds
    and the values themselves, comma-joined in report and line order."""
    r = results.withColumn("_v", F.col("value").cast("string"))
    return r.groupBy("user_id", "marker", "test_date").agg(
        F.count("*").alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.expr("listagg(_v, ',') within group (order by report_id, line, value)").alias("series"))


def flagged_lines(latest: DataFrame) -> DataFrame:
    """Per user, the flagged rows of the latest report as one text:
    ``marker: value unit (range low-high) -> flag`` lines joined by newlines
    (missing values print as None)."""
    def txt(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))
    unit = F.coalesce(F.col("unit"), F.lit("")) if "unit" in latest.columns else F.lit("")
    line = F.concat(F.col("marker"), F.lit(": "), txt("value"), F.lit(" "), unit,
                    F.lit(" (range "), txt("ref_low"), F.lit("-"), txt("ref_high"), F.lit(") -> "), F.col("flag"))
    f = with_flag(latest).where(F.col("flag") != "In range").withColumn("_line", line)
    return (f.groupBy("user_id", "test_date")
             .agg(F.count("*").alias("n_flagged"),
                  F.expr("listagg(_line, '\\n') within group (order by report_id, line, _line)").alias("flagged")))


def text_chunks(docs: DataFrame, text_col: str = "text", size: int = CHUNK_CHARS) -> DataFrame:
    """Non-overlapping ``size``-character slices of each text, with index."""
    t = F.col(text_col)
    n = F.ceil(F.length(t) / size).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return (docs.select("doc_id", F.posexplode(F.transform(starts, lambda i: F.substring(t, i * size + 1, size)))
                        .alias("chunk", "text")))


def short_text_guard(docs: DataFrame, text_col: str = "text", min_chars: int = MIN_TEXT_CHARS) -> DataFrame:
    """Stripped length and accept / reject (fewer than ``min_chars``)."""
    stripped = F.regexp_replace(F.col(text_col), r"^\s+|\s+$", "")
    return docs.select("doc_id", F.length(stripped).alias("stripped_chars"),
                       (F.length(stripped) >= min_chars).alias("accepted"))


def dedupe_first(rows: DataFrame, key=("report_id", "marker"), order=("chunk", "pos")) -> DataFrame:
    """Keep the first row per (report, marker) in (chunk, position) order.
    Rows tied on the order are resolved by their values, so the result does
    not depend on input order. A partial aggregate: no sort of the group."""
    keep = [c for c in rows.columns if c not in key]
    best = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in keep if c not in order]))
    return rows.groupBy(*key).agg(best.alias("_f")).select(*key, *[F.col(f"_f.{c}").alias(c) for c in keep])


def report_date(chunk_dates: DataFrame) -> DataFrame:
    """First non-empty test date over a report's chunks, in chunk order."""
    ok = chunk_dates.where(F.col("test_date").isNotNull() & (strip("test_date") != ""))
    return ok.groupBy("report_id").agg(F.min_by("test_date", "chunk").alias("test_date"))


def drop_incomplete(rows: DataFrame) -> DataFrame:
    """Reviewed results without a marker or a value are not saved."""
    return rows.dropna(subset=["marker", "value"])
