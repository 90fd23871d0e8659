"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by hash. A document's virtual finish time is
the source's words up to and including it, divided by the source's weight (its
target). Documents are taken in the order of virtual finish times over all
sources until the total budget is spent; the k-th repeat of a source starts
where the previous one ended. Every source then spends its target at the same
virtual time, up to one document.

All of it is DataFrame operations. No source is ever one group of rows: running
totals go over ``2**BITS`` hash ranges a source first and inside one range then;
the global order likewise goes over ``2**BITS`` ranges of virtual time, of which
only the one where the budget ends is sorted row by row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import nested, row_key, written

BITS = 14
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Target of each source from (src, source, source_size; src
    names the source in joins): sources by code point,
    null last, weigh ``weights`` in turn; ``share`` of all sizes is dealt by
    weight, none above ``max_repeats`` times its size, the excess reshared.

    Closed form: the sources that stop at their cap are those of least cap per
    weight. With the sources in that order, the level (words per weight) left
    after the first k caps is (budget - caps) / (weights that remain); the first
    source whose own cap per weight is no less than that ends the capped ones.
    One row per source: this is the one place where all sources meet in a task.
    """
    everyone = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = (sizes.withColumn("weight", w.cast("double"))
         .withColumn("cap", F.lit(max_repeats) * F.col("source_size").cast("double"))
         .withColumn("budget", F.lit(share) * F.sum("source_size").over(everyone).cast("double")))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level).withColumn("place", F.row_number().over(order))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    s = s.withColumn("final", F.min(F.when(fits, F.struct("place", "level"))).over(everyone)["level"])
    return s.select("src", "source", "source_size",
                    F.when(F.col("final").isNull(), F.col("cap"))
                    .otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight"))).alias("target"))


def _plan(base: DataFrame, weights, share: float, max_repeats: int) -> DataFrame:
    """(row, size, source_size, target, finish) of a written table (row, id, src,
    source, size, shuffle); finish lists the virtual finish times of the copies
    that are taken."""
    ranges = 1 << BITS
    first = F.conv(F.substring("shuffle", 1, 4), 16, 10).cast("int")
    base = (base.select("row", "id", "src", "source", "size", "shuffle")
            .withColumn("range", F.shiftright(first, 16 - BITS)))
    per_range = written(base.groupBy("src", "range").agg(F.first("source").alias("source"),
                                                         F.sum("size").alias("words")), "ranges")
    goal = written(targets(per_range.groupBy("src").agg(F.first("source").alias("source"),
                                                        F.sum("words").alias("source_size")),
                           weights, share, max_repeats), "targets")

    # Words of the source up to and including each document.
    ahead = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (per_range.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
              .join(goal.select("src", "source_size", "target"), "src").select("src", "range", "ahead", "source_size",
                                                                               "target"))
    inside = (Window.partitionBy("src", "range").orderBy("shuffle", "id", "size", "row")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = base.withColumn("within", F.sum("size").over(inside)).join(starts, ["src", "range"])
    upto = F.col("ahead") + F.col("within")
    times = [F.when(F.col("target") > 0, (upto + k * F.col("source_size")) / F.col("target"))
             .otherwise(F.lit(None if k else 0.0).cast("double")) for k in range(max_repeats)]
    rows = written(rows.select("row", "id", "shuffle", "size", "source_size", "target",
                               F.array_compact(F.array(*times)).alias("times")), "times")

    # Where the budget ends: first among ranges of virtual time (all targets
    # are spent about time 1; the last range holds whatever lies far beyond),
    # then row by row in that range.
    budget = round(goal.agg(F.sum("target")).first()[0] or 0)
    copies = rows.select("id", "shuffle", "size", F.explode("times").alias("at"))
    slot = F.least(F.floor(F.col("at") * (ranges // 2)), F.lit(ranges)).cast("int")
    spent = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (copies.groupBy(slot.alias("slot")).agg(F.sum("size").alias("words"))
            .withColumn("end", F.sum("words").over(spent)).where(F.col("end") > budget)
            .agg(F.min(F.struct("slot", "end", "words"))).first()[0])
    finish = F.col("times")
    if last is not None:
        order = Window.orderBy("at", "shuffle", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = (copies.where(slot == last["slot"])
               .withColumn("spent", F.sum("size").over(order) + (last["end"] - last["words"]))
               .where(F.col("spent") <= budget).agg(F.max(F.struct("at", "shuffle", "id"))).first()[0])
        if cut is None:  # the budget ends before the first document of the range
            finish = F.filter("times", lambda at: at < last["slot"] / (ranges // 2))
        else:
            edge = F.struct(F.lit(cut["at"]).alias("at"), F.lit(cut["shuffle"]).alias("shuffle"),
                            F.lit(cut["id"]).cast(base.schema["id"].dataType).alias("id"))
            finish = F.filter("times", lambda at: F.struct(at.alias("at"), F.col("shuffle"), F.col("id")) <= edge)
    return rows.select("row", "size", "source_size", "target", finish.alias("finish"))


def _base(docs: DataFrame, *names) -> DataFrame:
    """The documents' sizes, with a row number that holds because it is written."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return written(docs.select(*names, F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"),
                               key.alias("src"), "source", word_count(F.col("text")).alias("size"),
                               digest.alias("shuffle")), "mix")


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (the source's),
    copies (0 to ``max_repeats``) and taken (words, repeats counted).

    Null and empty texts have size 0; they are taken with the documents around
    them and spend nothing. A null source is a source, the last one. Repeated
    rows are documents of their own. An empty table gives an empty plan. The
    same table gives the same mix; other columns are not looked at.
    """
    base = _base(docs)
    plan = _plan(base, weights, share, max_repeats)
    return (base.select(F.col("id").alias("doc_id"), "row").join(plan, "row")
            .select("doc_id", "size", "source_size", "target", F.size("finish").alias("copies"),
                    (F.size("finish") * F.col("size")).alias("taken")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as often as it is
    taken, in the order of virtual finish times over all sources. Texts move
    twice: to the times of their row, and to their place in the order.

    Nulls, empty texts, ties, repeated rows and empty tables are treated as
    ``mix_plan`` says. Columns of any name and type are kept as they are."""
    base = _base(docs, *row_key(docs, docs.columns))
    plan = _plan(base, weights, share, max_repeats)
    # Repeats of a row share the key; each has its own times.
    taken = (base.select("__id", "__hash", "row").join(plan, "row")
             .select("__id", "__hash", "row", F.explode("finish").alias("at")))
    return (nested(docs, docs.columns).dropDuplicates(["__id", "__hash"]).join(taken, ["__id", "__hash"])
            .repartitionByRange("at", "row").sortWithinPartitions("at", "row").select("__row.*"))
