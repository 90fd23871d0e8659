"""Food log operators: enrichment, daily and meal totals, progress.

The built-in food dimension is a fixed 61-row table, broadcast explicitly;
per-user custom foods are joined on (user_id, name) with a shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import dims

from ..functions.expr import exact_sum, strip
from ..functions.nutrition import NUTRIENTS, macro_progress, total
from . import snapshot


def enrich_food_log(food_log: DataFrame, foods: DataFrame) -> DataFrame:
    """food_log(user_id, day, food_id, grams, ...) -> adds item and the four
    nutrient totals rounded to 1 decimal (what gets stored per row)."""
    f = F.broadcast(foods.select("food_id", F.col("name").alias("item"),
                                 *[F.col(n).alias(f"_p_{n}") for n in NUTRIENTS]))
    j = food_log.join(f, "food_id")
    return j.select(*[c for c in food_log.columns], "item",
                    *[total(f"_p_{n}", "grams").alias(n) for n in NUTRIENTS])


def daily_totals(food: DataFrame, cols=("kcal", "protein")) -> DataFrame:
    """Per (user, day) sums of the stored (rounded) nutrient values, exact."""
    return (food.groupBy("user_id", "day")
                .agg(*[exact_sum(c, 1).alias(c) for c in cols]))


def meal_totals(food: DataFrame, keys=("user_id", "day", "meal")) -> DataFrame:
    return food.groupBy(*keys).agg(*[exact_sum(c, 1).cast("double").alias(c) for c in NUTRIENTS])


def day_macros(spine: DataFrame, food: DataFrame) -> DataFrame:
    """Eaten totals for each (user_id, day) of ``spine``; days without food
    give zeros."""
    t = daily_totals(food, NUTRIENTS)
    j = spine.join(t, ["user_id", "day"], "left")
    return j.select("user_id", "day", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in NUTRIENTS])


def progress(eaten: DataFrame, targets: DataFrame) -> DataFrame:
    """eaten(user_id, day, kcal..fat) x targets(user_id, kcal..fat) ->
    remaining and progress per nutrient."""
    t = targets.select("user_id", *[F.col(n).alias(f"_t_{n}") for n in NUTRIENTS])
    j = eaten.join(t, "user_id")
    out = ["user_id", "day"]
    for n in NUTRIENTS:
        p = macro_progress(n, f"_t_{n}")
        out += [F.col(n).alias(f"{n}_eaten"), p["remaining"].alias(f"{n}_remaining"),
                p["progress"].alias(f"{n}_progress")]
    return j.select(*out)


def resolve_meal_items(items: DataFrame, matches: DataFrame, foods: DataFrame) -> DataFrame:
    """Parsed items -> stored food rows: match the name (``matches`` from
    ``fuzzy.match_food``), convert the quantity to grams (1 decimal), label
    the source, and compute the four totals from the rounded grams. Items
    without a match are dropped (no estimate available)."""
    from ..functions.nutrition import source_label, to_grams
    m = matches.select(F.col("mention"), "food_id", "source")
    f = F.broadcast(foods.select("food_id", F.col("name").alias("item"), "units",
                                 *[F.col(n).alias(f"_p_{n}") for n in NUTRIENTS]))
    j = items.join(m, "mention").join(f, "food_id")
    g = to_grams("quantity", "unit", "units")
    j = j.withColumn("_g", g).withColumn("grams", F.col("_g.grams_1dp"))
    return j.select("user_id", "day", "meal", "meal_id", "line", "item", "quantity", "unit", "grams",
                    source_label("source", "_g.exact").alias("source"),
                    *[total(f"_p_{n}", "grams").alias(n) for n in NUTRIENTS])


def food_dictionary(custom: DataFrame, foods: DataFrame) -> DataFrame:
    """Per-user dictionary entries that differ from the shared built-in
    table: custom foods, labelled ``built-in`` when they override a built-in
    key and ``custom`` otherwise. Built-in rows are not copied per user."""
    keys = F.broadcast(foods.select(F.col("name").alias("_k")))
    j = custom.join(keys, custom["name"] == F.col("_k"), "left")
    return j.select("user_id", "name", "kcal", "protein", "carbs", "fat",
                    F.when(F.col("_k").isNotNull(), "built-in").otherwise("custom").alias("source"))


def resolve_with_custom(items: DataFrame, choices: DataFrame, foods: DataFrame, custom: DataFrame,
                        estimates: DataFrame, cutoff: float = 85) -> DataFrame:
    """Parsed items -> stored food rows with per-user custom foods and
    estimates.

    Choice list of a user: the built-in strings in order, then the user's
    new custom names (save order). A custom name equal to a built-in string
    keeps that position but maps to the custom row; a custom row named like a
    built-in key replaces that key's values (for its aliases too). Built-in
    strings are scored once per distinct name; custom strings per (user,
    name), joined on user_id. All look-ups run over the distinct (user, name)
    pairs; the item log is joined once, with their result. Unmatched items take the estimate for their
    lower-cased name (source ``AI estimate``); without one they are skipped.
    """
    from ..functions.nutrition import source_label, to_grams
    names = items.select("user_id", "mention").distinct()
    known = resolve_names(names, choices, foods, custom, estimates, cutoff).alias("k")
    same = F.col("i.user_id").eqNullSafe(F.col("k.user_id")) & (F.col("i.mention") == F.col("k.mention"))
    it = items.alias("i").join(known, same).select("i.*", *[F.col(f"k.{c}") for c in known.columns if c not in names.columns])
    it = it.withColumn("_g", to_grams("quantity", "unit", "_p_units")).withColumn("grams", F.col("_g.grams_1dp"))
    # Estimated rows are offered for saving as custom foods.
    return it.select("user_id", "day", "meal", "meal_id", "line", "item", "quantity", "unit", "grams",
                     source_label("_src", "_g.exact").alias("source"), (F.col("_src") == "AI estimate").alias("remember"),
                     *[total(f"_p_{n}", "grams").alias(n) for n in NUTRIENTS])


def resolve_names(names: DataFrame, choices: DataFrame, foods: DataFrame, custom: DataFrame, estimates: DataFrame,
                  cutoff: float = 85) -> DataFrame:
    """Distinct (user_id, mention) -> item, ``_src``, values per 100 g and units of
    what ``resolve_with_custom`` takes for it; names without any are left out.

    The values of a custom match come with the match. Those saved under built-in
    strings, at most one a string of the fixed choices, meet a user's names once, as a map.
    """
    from . import fuzzy
    values = ("kcal", "protein", "carbs", "fat", "units")
    # Behind a generator, so that all uses share one shuffle of the names: their filters
    # and smaller distincts would otherwise be put in its place, each with its own scan.
    names = names.where(F.col("mention").isNotNull()).select(F.inline(F.array(F.struct("user_id", "mention"))))
    n_builtin = len(dims.food_choices())
    fnames = F.broadcast(foods.select("food_id", F.col("name").alias("b_key"), F.struct(*values).alias("_bf")))
    mentions = names.select("mention").distinct()
    b = fuzzy.best_match(mentions, F.broadcast(choices), query_col="mention", choice_col="choice", ord_col="ord", cutoff=cutoff,
                         lower_query=True, payload=("food_id",), passing_only=True).join(fnames, "food_id")
    b = b.select("mention", F.col("matched").alias("b_choice"), F.col("score").alias("b_score"), "b_key", "_bf")
    est = estimates.select(F.col("name_key").alias("_ek"), F.struct(*values).alias("_es"))
    b = (mentions.join(b, "mention", "left").withColumn("_ek", F.lower(strip("mention"))).join(est, "_ek", "left"))
    row = F.struct(*values).alias("_cu")
    bchoice = F.broadcast(choices.select(F.col("choice").alias("name")).distinct())
    new_custom = (custom.join(bchoice, "name", "left_anti")
                        .withColumn("ord", F.lit(n_builtin) + F.dense_rank().over(
                            Window.partitionBy("user_id").orderBy("cpos")) - 1))
    c = fuzzy.best_match(names, new_custom.select("user_id", "name", "ord", row),
                         query_col="mention", choice_col="name", ord_col="ord", cutoff=cutoff, keys=("user_id",),
                         lower_query=True, payload=("_cu",), passing_only=True)
    c = c.select("user_id", "mention", F.col("matched").alias("c_name"), F.col("score").alias("c_score"), F.col("_cu").alias("_new"))
    own = (custom.join(bchoice, "name").groupBy("user_id")
                 .agg(F.map_from_entries(F.collect_list(F.struct("name", row))).alias("_own")))
    it = names.join(c, ["user_id", "mention"], "left").join(b, "mention", "left").join(own, "user_id", "left")
    use_c = F.col("c_score").isNotNull() & (F.col("b_score").isNull() | (F.col("c_score") > F.col("b_score")))
    # A custom name; or a built-in choice string the user re-saved; or the built-in key
    # of the matched string, with the user's values if they re-saved that.
    saved, saved_key = (F.try_element_at("_own", F.col(x)) for x in ("b_choice", "b_key"))
    it = it.select("user_id", "mention", "b_key", "_bf", "_ek", "_es", F.inline(F.array(F.struct(
        F.when(use_c, F.col("c_name")).when(saved.isNotNull(), F.col("b_choice")).otherwise(F.col("b_key")).alias("item_key"),
        F.when(use_c, F.col("_new")).otherwise(F.coalesce(saved, saved_key)).alias("_cu")))))
    it = it.withColumn("_bf", F.when(F.col("item_key") == F.col("b_key"), F.col("_bf")))
    matched = F.col("item_key").isNotNull()
    src = (F.when(matched & F.col("_bf.kcal").isNull(), F.lit("custom"))
            .when(matched, F.lit("built-in")).otherwise(F.lit("AI estimate")))

    def pick(x):
        return (F.when(matched, F.coalesce(F.col(f"_cu.{x}"), F.col(f"_bf.{x}")) if x != "units" else
                       F.when(F.col("_cu.kcal").isNotNull(), F.col("_cu.units")).otherwise(F.col("_bf.units")))
                 .otherwise(F.col(f"_es.{x}")))
    it = it.where(matched | F.col("_es.kcal").isNotNull())
    return it.select("user_id", "mention", F.when(matched, F.col("item_key")).otherwise(F.col("_ek")).alias("item"),
                     src.alias("_src"), *[pick(x).alias(f"_p_{x}") for x in values])


def save_estimates(custom: DataFrame, resolved: DataFrame) -> DataFrame:
    """``custom`` with the estimates of ``resolve_names`` saved into it under their
    item names: a row saved again replaces the one of its user and name. ``saved`` marks
    the new rows; ``cpos`` stays null for them."""
    values = ["kcal", "protein", "carbs", "fat", "units"]
    new = (resolved.where(F.col("_src") == "AI estimate")
           .select("user_id", F.col("item").alias("name"), *[F.col(f"_p_{c}").alias(c) for c in values])
           .dropDuplicates(["user_id", "name"])
           .withColumn("cpos", F.lit(None).cast(custom.schema["cpos"].dataType)).withColumn("saved", F.lit(True)))
    return snapshot.upsert_replace(custom.withColumn("saved", F.lit(False)), new, ["user_id", "name"])
