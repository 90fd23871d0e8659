"""Model output (JSON text) -> validated rows.

A language model turns free text into JSON; these functions are the
distributed clean / validate step around its output column, row by row with
built-in VARIANT functions (no Python). Text that cannot be parsed even after
repair goes to a rejected set instead of failing the job.

Python truthiness and ``float()`` leniency of the original parser are kept:
a falsy quantity (missing, null, 0, "", false, empty list or object) means 1;
numeric text parses; other text drops the item.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import col, finite_number, strip


def repair_json(text) -> Column:
    """Parse; on failure parse the span from the first ``{`` to the last
    ``}``. NULL when both fail."""
    t = col(text)
    first = F.instr(t, "{")
    last = F.length(t) - F.instr(F.reverse(t), "}") + 1
    span = F.when((first > 0) & (F.instr(t, "}") > 0) & (last >= first), F.substring(t, first, last - first + 1))
    return F.coalesce(F.try_parse_json(t), F.try_parse_json(span))


def parse_status(text) -> Column:
    t = col(text)
    return (F.when(F.try_parse_json(t).isNotNull(), "parsed")
             .when(repair_json(t).isNotNull(), "repaired").otherwise("rejected"))


def _kind(v) -> Column:
    """Type name of a variant value; NULL when the key is missing."""
    return F.when(v.isNotNull(), F.schema_of_variant(v))


def _is_number(kind) -> Column:
    return kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _facts(v, name: str) -> list[Column]:
    """Type (k) and text (s) of a JSON value as columns ``_<name>_<part>``. Numbers,
    booleans and emptiness are read from these: each further view of a value costs a
    cast that Spark builds anew for every row."""
    return [_kind(v).alias(f"_{name}_k"), F.try_variant_get(v, "$", "string").alias(f"_{name}_s")]


def _numbers(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the number (d) of each value, parsed once: booleans as 0 and 1,
    text stripped, null for others."""
    def number(n):
        k, s = F.col(f"_{n}_k"), F.col(f"_{n}_s")
        return (F.when(_is_number(k), s.try_cast("double")).when(k == "BOOLEAN", (s == "true").cast("double"))
                 .when(k == "STRING", strip(s).try_cast("double")))
    return df.withColumns({f"_{n}_d": number(n) for n in names})


def _truthy(name: str) -> Column:
    k, s = F.col(f"_{name}_k"), F.col(f"_{name}_s")
    return (F.when(k.isNull() | (k == "VOID"), F.lit(False))
             .when(_is_number(k), F.col(f"_{name}_d") != 0)
             .when(k == "BOOLEAN", s == "true")
             .when(k == "STRING", s != "")
             .when(k.startswith("ARRAY"), s != "[]")
             .when(k.startswith("OBJECT"), s != "{}")
             .otherwise(F.lit(True)))


def _float(name: str) -> Column:
    d = F.col(f"_{name}_d")
    return F.when(F.col(f"_{name}_k") == "STRING", finite_number(d)).otherwise(d)


def _str(name: str) -> Column:
    k, s = F.col(f"_{name}_k"), F.col(f"_{name}_s")
    return F.when(k == "VOID", F.lit("None")).otherwise(s)


def _once(df: DataFrame, id_cols: list[str], *cols: Column) -> DataFrame:
    """``df`` with ``cols`` behind a one-row generator: filters on them stay above
    it, where a plain projection would be repeated inside every such filter."""
    return df.select(*id_cols, F.inline(F.array(F.struct(*cols))))


def meal_items(outputs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Meal-parser outputs -> (id_cols, item_pos, name, quantity, unit).

    Items without a ``name`` key or with a quantity that does not parse are
    skipped; quantity falsy -> 1; unit falsy -> ``serving``.
    """
    d = outputs.select(*id_cols, repair_json(text_col).alias("_v"))
    items = F.try_variant_get("_v", "$.items", "array<variant>")
    x = d.select(*id_cols, F.posexplode(F.coalesce(items, F.array().cast("array<variant>"))).alias("item_pos", "_it"))
    x = x.select(*id_cols, "item_pos",
                 *_facts(F.try_variant_get("_it", "$.name", "variant"), "n"),
                 *_facts(F.try_variant_get("_it", "$.quantity", "variant"), "q"),
                 *_facts(F.try_variant_get("_it", "$.unit", "variant"), "u"))
    x = _numbers(x, "q", "u")
    qty = F.when(_truthy("q"), _float("q")).otherwise(F.lit(1.0))
    unit = F.when(_truthy("u"), _str("u")).otherwise(F.lit("serving"))
    return (_once(x, [*id_cols, "item_pos"], strip(_str("n")).alias("name"), qty.alias("quantity"), unit.alias("unit"))
            .where(F.col("name").isNotNull() & F.col("quantity").isNotNull()))


NUTRIENT_KEYS = ("kcal", "protein", "carbs", "fat")


def food_estimates(outputs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Food-estimate outputs -> per-100 g values and household units.

    Each nutrient: ``max(float(x or 0), 0)``; kcal replaced by 4p+4c+9f when
    they disagree by more than 25 %; units keep numeric entries with
    0 < grams < 2000 (a text value drops only that entry).
    """
    from ..functions.nutrition import atwater_kcal
    d = _once(outputs, id_cols, repair_json(text_col).alias("_v"))
    d = d.select(*id_cols, F.try_variant_get("_v", "$.units", "map<string,variant>").alias("_units"),
                 *[c for k in NUTRIENT_KEYS for c in _facts(F.try_variant_get("_v", f"$.{k}", "variant"), k)])
    d = _numbers(d, *NUTRIENT_KEYS)
    vals = [F.greatest(F.when(_truthy(k), _float(k)).otherwise(F.lit(0.0)), F.lit(0.0)).alias(k) for k in NUTRIENT_KEYS]
    grams = F.transform_values(F.coalesce("_units", F.create_map().cast("map<string,variant>")),
                               lambda k, g: F.when(_is_number(F.schema_of_variant(g)), F.try_variant_get(g, "$", "double")))
    units = F.map_filter(grams, lambda k, g: (g > 0) & (g < 2000))
    out = _once(d, id_cols, *vals, units.alias("units"))
    return out.withColumn("kcal", atwater_kcal("kcal", "protein", "carbs", "fat"))


def _int(name: str) -> Column:
    """``int(x)`` for numbers (truncated), booleans and integer text; else
    NULL."""
    k, d, txt = F.col(f"_{name}_k"), F.col(f"_{name}_d"), strip(F.col(f"_{name}_s"))
    return (F.when(_is_number(k) | (k == "BOOLEAN"), d.try_cast("long"))
             .when((k == "STRING") & txt.rlike(r"^[+-]?[0-9]+$"), txt.try_cast("long")))


def plan_days(outputs: DataFrame, id_cols: list[str], requested_days: list[str],
              text_col: str = "text") -> DataFrame:
    """Plan-generator outputs -> one row per (plan, day entry, exercise) with
    the raw exercise name, before library matching.

    Only days whose label is one of ``requested_days`` are kept. sets:
    ``int`` of the value, 3 when missing or unusable, clamped to 1..6; reps:
    text, default ``8-10``; rest_sec: ``int``, 90 when falsy or unusable (the
    original would fail the whole plan on text such as "90 sec"); notes and
    focus: text, default empty.
    """
    # _doc identifies one output document (callers' ids need not be unique);
    # it is assigned in the scan stage, before any shuffle.
    d = _once(outputs.select("*", F.monotonically_increasing_id().alias("_doc")), [*id_cols, "_doc"],
              repair_json(text_col).alias("_v"))
    days = F.try_variant_get("_v", "$.days", "array<variant>")
    x = d.select(*id_cols, "_doc",
                 F.posexplode(F.coalesce(days, F.array().cast("array<variant>"))).alias("day_pos", "_d"))
    x = x.select(*id_cols, "_doc", "day_pos", F.try_variant_get("_d", "$.exercises", "array<variant>").alias("_exs"),
                 *_facts(F.try_variant_get("_d", "$.day", "variant"), "day"),
                 *_facts(F.try_variant_get("_d", "$.focus", "variant"), "focus"))
    x = _once(x, [*id_cols, "_doc", "day_pos"], F.when(F.col("_day_k") == "STRING", F.col("_day_s")).alias("day"),
              F.coalesce(_str("focus"), F.lit("")).alias("focus"), F.col("_exs"))
    x = x.where(F.col("day").isin(*requested_days))
    x = x.select(*id_cols, "_doc", "day_pos", "day", "focus",
                 F.posexplode(F.coalesce("_exs", F.array().cast("array<variant>"))).alias("ex_pos", "_e"))
    parts = ("name", "sets", "reps", "rest_sec", "notes")
    x = x.select(*id_cols, "_doc", "day_pos", "day", "focus", "ex_pos",
                 *[c for k in parts for c in _facts(F.try_variant_get("_e", f"$.{k}", "variant"), k)])
    x = _numbers(x, "sets", "rest_sec")
    text = lambda k, default: F.coalesce(_str(k), F.lit(default))
    sets = F.coalesce(_int("sets"), F.lit(3))
    rest = F.when(_truthy("rest_sec"), F.coalesce(_int("rest_sec"), F.lit(90))).otherwise(F.lit(90))
    return _once(x, [*id_cols, "_doc", "day_pos", "day", "focus", "ex_pos"],
                 text("name", "").alias("raw_name"),
                 F.greatest(F.lit(1), F.least(sets, F.lit(6))).cast("int").alias("sets"),
                 text("reps", "8-10").alias("reps"), rest.alias("rest_sec"), text("notes", "").alias("notes"))


def lab_reports(outputs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Report-extractor outputs, one per text chunk -> (id_cols, test_date): the
    date as the model gave it; null when falsy or when the text is no JSON."""
    d = _once(outputs, id_cols, repair_json(text_col).alias("_v"))
    d = d.select(*id_cols, *_facts(F.try_variant_get("_v", "$.test_date", "variant"), "t"))
    d = _numbers(d, "t")
    return _once(d, id_cols, F.when(_truthy("t"), _str("t")).alias("test_date"))


def lab_items(outputs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Report-extractor outputs -> (id_cols, item_pos, marker, value, unit,
    ref_low, ref_high).

    Rows whose value does not parse as a finite number or whose marker is falsy
    are skipped; the marker is stripped text; a falsy unit is empty text; bounds
    that do not parse are null.
    """
    d = _once(outputs, id_cols, repair_json(text_col).alias("_v"))
    items = F.try_variant_get("_v", "$.results", "array<variant>")
    x = d.select(*id_cols, F.posexplode(F.coalesce(items, F.array().cast("array<variant>"))).alias("item_pos", "_it"))
    parts = ("marker", "value", "unit", "ref_low", "ref_high")
    x = x.select(*id_cols, "item_pos",
                 *[c for k in parts for c in _facts(F.try_variant_get("_it", f"$.{k}", "variant"), k)])
    x = _numbers(x, *parts)
    return (_once(x, [*id_cols, "item_pos"], F.when(_truthy("marker"), strip(_str("marker"))).alias("marker"),
                  finite_number("_value_d").alias("value"),
                  F.when(_truthy("unit"), _str("unit")).otherwise(F.lit("")).alias("unit"),
                  finite_number("_ref_low_d").alias("ref_low"), finite_number("_ref_high_d").alias("ref_high"))
            .where(F.col("marker").isNotNull() & F.col("value").isNotNull()))
