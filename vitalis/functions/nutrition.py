"""Nutrition column expressions: targets, unit conversion, totals, checks."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import dims
from .expr import col, strip

NUTRIENTS = ("kcal", "protein", "carbs", "fat")


def activity_multiplier(activity) -> Column:
    """Activity label -> TDEE multiplier; unknown labels use the default."""
    m = F.lit(dims.DEFAULT_ACTIVITY)
    for label, mult in reversed(dims.ACTIVITY):
        m = F.when(col(activity) == label, F.lit(mult)).otherwise(m)
    return m


def targets(weight_kg, height_cm, age, sex, activity, deficit_pct, protein_g_per_kg) -> Column:
    """Daily targets as one struct: Mifflin-St Jeor BMR times activity, minus
    the deficit but never below BMR; protein per kg; fat floor; carbs rest.

    Any NULL input gives NULL fields (no target), never a default.
    """
    w, h, a = col(weight_kg), col(height_cm), col(age)
    bmr = 10 * w + 6.25 * h - 5 * a + F.when(col(sex) == "Male", F.lit(5)).otherwise(F.lit(-161))
    tdee = bmr * activity_multiplier(activity)
    kcal = F.greatest(tdee * (1 - col(deficit_pct) / 100), bmr)
    protein = w * col(protein_g_per_kg)
    fat = F.greatest(0.8 * w, 0.25 * kcal / 9)
    carbs = F.greatest((kcal - protein * 4 - fat * 9) / 4, F.lit(0.0))
    ok = w.isNotNull() & h.isNotNull() & a.isNotNull() & col(deficit_pct).isNotNull()
    return F.when(ok, F.struct(
        bmr.alias("bmr"), tdee.alias("tdee"), kcal.alias("kcal"), protein.alias("protein"),
        carbs.alias("carbs"), fat.alias("fat"), (kcal == bmr).alias("floored")))


def canonical_unit(unit) -> Column:
    """Lower-cased, stripped unit (default ``serving``) through the synonym
    table."""
    u = F.lower(strip(F.coalesce(F.when(col(unit) != "", col(unit)), F.lit("serving"))))
    syn = F.create_map(*[x for a, c in dims.UNIT_SYNONYMS for x in (F.lit(a), F.lit(c))])
    return F.coalesce(F.try_element_at(syn, u), u)


def to_grams(quantity, unit, food_units) -> Column:
    """Quantity in a household unit -> struct(grams, exact).

    g/ml pass through; kg/l times 1000; a unit the food defines is exact; a
    piece/plate/serving of a food with a serving size is inexact; anything
    else uses the fallback table (default 100 g), inexact.
    """
    q = col(quantity)
    u = canonical_unit(unit)
    fu = col(food_units)
    own = F.try_element_at(fu, u)
    serving = F.try_element_at(fu, F.lit("serving"))
    fb = F.create_map(*[x for k, g in dims.FALLBACK_GRAMS for x in (F.lit(k), F.lit(float(g)))])
    fallback = F.coalesce(F.try_element_at(fb, u), F.lit(float(dims.DEFAULT_FALLBACK_GRAMS)))
    factor = (F.when(u.isin("g", "ml"), F.lit(1.0))
               .when(u.isin("kg", "l"), F.lit(1000.0))
               .when(own.isNotNull(), own)
               .when(u.isin("piece", "plate", "serving") & serving.isNotNull(), serving)
               .otherwise(fallback))
    exact = u.isin("g", "ml", "kg", "l") | own.isNotNull()
    return F.struct(product([q, factor]).alias("grams"), product([q, factor], 1).alias("grams_1dp"), exact.alias("exact"))


DEC = "decimal(18,4)"


def dec(x) -> Column:
    """Exact decimal view of a double with at most 4 decimals."""
    return col(x).try_cast(DEC)


def is_exact(x) -> Column:
    """Whether the decimal view of a double is the same number."""
    return F.coalesce(dec(x).cast("double") == col(x), F.lit(False))


def product(factors, places: int | None = None, divisor: int = 1) -> Column:
    """Product of two doubles over 1 or 100, rounded half-even to ``places``. Factors
    of at most 4 decimals and 14 digits before them are multiplied in DECIMAL, so a
    value such as 14.85 is a true tie whatever its binary approximation is; others, of
    any size and fineness, in double."""
    a, b = factors
    share = F.lit(1 / divisor).cast("decimal(3,2)")
    decimal, double = dec(a) * dec(b), col(a) * col(b) / F.lit(float(divisor))
    if divisor != 1:
        decimal = decimal * share
    if places is not None:
        decimal, double = F.bround(decimal, places), F.bround(double, places)
    return F.when(is_exact(a) & is_exact(b), decimal.cast("double")).otherwise(double)


def total(per100, grams) -> Column:
    """Nutrient amount for ``grams`` from a per-100 g value, 1 decimal half-even."""
    return product([per100, grams], 1, 100)


def macro_progress(eaten, target) -> Column:
    """struct(remaining, progress): progress = min(eaten/target, 1), 0 for a
    zero or missing target."""
    e, t = col(eaten), col(target)
    prog = F.when(t.isNull() | (t == 0), F.lit(0.0)).otherwise(F.least(F.try_divide(e, t), F.lit(1.0)))
    return F.struct((t - e).alias("remaining"), prog.alias("progress"))


def atwater_kcal(kcal, protein, carbs, fat) -> Column:
    """Estimated-food sanity check: clip nutrients at 0; when kcal differs
    from 4p+4c+9f by more than 25 % of it, trust the macros."""
    k, p, c, f = (F.greatest(F.coalesce(col(x), F.lit(0.0)), F.lit(0.0)) for x in (kcal, protein, carbs, fat))
    at = p * 4 + c * 4 + f * 9
    return F.when((at != 0) & (F.abs(k - at) / at > 0.25), at).otherwise(k)


def source_label(source, exact) -> Column:
    return F.when(col(exact), col(source)).otherwise(F.concat(col(source), F.lit(" (check grams)")))
