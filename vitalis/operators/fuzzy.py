"""Best fuzzy match of free names against a choice list (foods, exercises,
lab markers): token-sort ratio, a cutoff, first-best wins ties.

Where all keys draw on one vocabulary there is no all-pairs join: a pair that passes
differs by at most ``d`` insertions and deletions, ``d`` bounded by the lengths, so of
``d + 1`` segments of the choice at least one stands unchanged in the query, shifted by
no more than the differences before it. Names meet on (length, segment number, text).

Each user's own names are few beside the queries, and single characters or segments
would make more rows than there are pairs. There a query meets the choices of its keys,
and a pair goes on only if its character counts allow the cutoff: every insertion or
deletion changes one count by one. The counts of 16 classes of characters are packed
into two whole numbers, so this is a few shifts a pair and loses none that passes. A
user's choices are met in 16 parts by hashes of the queries, so that a user with very many
queries is spread over tasks.

In one vocabulary (markers, exercises, the built-in foods) names are compared once per
*distinct* pair of normalised names, over all keys; the passing pairs are then joined
back to the queries and to the choices of their keys. Equal names need no score.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions.expr import let, strip

# Classes of characters; every other character belongs to a sixteenth. Correctness does
# not depend on them.
CLASSES = (" ", "e", "a", "i", "o", "r", "n", "t", "s", "l", "cd", "uh", "mgp", "bfy", "wkvxjqz")
_BITS, _HELD = 8, 255


def _described(df: DataFrame, name: str, letter: str) -> DataFrame:
    """``df`` with the length ``_<letter>l`` of a normalised name and its profile: two whole
    numbers ``_<letter>_0`` and ``_<letter>_1`` of eight counts each, at most 255, of how
    often each class of characters occurs."""
    merged = [(x, c[0]) for c in CLASSES for x in c[1:]]
    df = df.withColumn("_x", F.translate(F.col(name), "".join(x for x, _ in merged), "".join(c for _, c in merged)))
    length = F.length("_x")
    df = df.withColumns({f"_n{i}": length - F.length(F.replace("_x", F.lit(c[0]), F.lit(""))) for i, c in enumerate(CLASSES)})
    counts = [F.col(f"_n{i}") for i in range(len(CLASSES))]
    counts.append(length - sum(counts[1:], counts[0]))
    packed = [F.shiftleft(F.least(n, F.lit(_HELD)).cast("long"), _BITS * (i % 8)) for i, n in enumerate(counts)]
    words = {f"_{letter}_{j}": sum(packed[8 * j + 1:8 * j + 8], packed[8 * j]) for j in range(2)}
    return df.withColumns({f"_{letter}l": length, **words}).drop("_x", *[f"_n{i}" for i in range(len(CLASSES))])


def _changes(a: str, b: str) -> Column:
    """Insertions and deletions that the profiles in columns ``a``/``b`` + ``_0``, ``_1`` ask
    for at least."""
    def count(name, i):
        return F.shiftrightunsigned(F.col(f"{name}_{i // 8}"), _BITS * (i % 8)).bitwiseAND(F.lit(_HELD).cast("long"))
    differences = [F.abs(count(a, i) - count(b, i)) for i in range(len(CLASSES) + 1)]
    return sum(differences[1:], differences[0])


EPS = 1e-9  # a bound on a whole number is never lowered by a rounding error


def _floor(x) -> Column:
    return F.floor(x + EPS).cast("int")


def _edits(total, cutoff: float) -> Column:
    """Most insertions and deletions between two names of ``total`` characters that
    pass the cutoff."""
    return _floor(total * F.lit((100 - cutoff) / 100))


def _segments(length, cutoff: float) -> Column:
    """Number of segments of a choice: one more than the edits to any query."""
    return _edits(length + _floor(length * F.lit((200 - cutoff) / cutoff)), cutoff) + 1


def _segment(length, count, i) -> tuple[Column, Column]:
    """(start, length) of segment ``i`` of ``count`` nearly equal ones."""
    start = F.floor(i * length / count).cast("int")
    return start, F.floor((i + 1) * length / count).cast("int") - start


def _reach(q_len, c_len, start, size, cutoff: float) -> tuple[Column, Column]:
    """First and last place in a query where a segment of a choice may stand."""
    edits, longer = _edits(q_len + c_len, cutoff), q_len - c_len
    return (F.greatest(F.lit(0), start - F.floor((edits - longer) / 2).cast("int")),
            F.least(q_len - size, start + F.floor((edits + longer) / 2).cast("int")))


def _pairs_by_segments(qv: DataFrame, cv: DataFrame, cutoff: float) -> DataFrame:
    """Candidate pairs of qv(_qn, _ql) and cv(_cn, _cl, ...): each once, at the first
    segment of the choice that the query holds."""
    upto = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi))
    n, i, size, start = F.col("_k"), F.col("_i"), F.col("_size"), F.col("_start")

    def cut(df, length):
        at, wide = _segment(F.col(length), n, i)
        return df.withColumn("_start", at).withColumn("_size", wide)

    c = cut(cv.where("_cl > 0").withColumn("_k", _segments(F.col("_cl"), cutoff))
              .select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("_i")), "_cl")
    c = c.withColumn("_text", F.substring("_cn", start + 1, size)).drop("_start", "_size")
    ratio = (200 - cutoff) / cutoff
    least = F.greatest(F.lit(1), F.ceil(F.col("_ql") / ratio - EPS).cast("int"))
    q = (qv.where("_ql > 0").select("*", F.explode(upto(least, _floor(F.col("_ql") * ratio))).alias("_cl"))
           .withColumn("_k", _segments(F.col("_cl"), cutoff)).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("_i")))
    q = cut(q, "_cl")
    lo, hi = _reach(F.col("_ql"), F.col("_cl"), start, size, cutoff)
    texts = F.array_distinct(F.transform(upto(lo, hi), lambda p: F.substring(F.col("_qn"), p + 1, size)))
    q = q.select("_qn", "_ql", "_cl", "_i", F.explode(texts).alias("_text"))

    def held(j):
        at, wide = _segment(F.col("_cl"), n, j)
        first, last = _reach(F.col("_ql"), F.col("_cl"), at, wide, cutoff)
        window = F.substring(F.col("_qn"), first + 1, last - first + wide)
        return (first <= last) & (F.instr(window, F.substring(F.col("_cn"), at + 1, wide)) > 0)
    earlier = F.when(i > 0, F.exists(F.sequence(F.lit(0), i - 1), held)).otherwise(F.lit(False))
    return q.join(c, ["_cl", "_i", "_text"]).where(~earlier)


PARTS = 16


def _matches_in_keys(q: DataFrame, c: DataFrame, keys: list[str], query_col: str, payload: tuple[str, ...],
                     cutoff: float) -> DataFrame:
    """(keys, query_col, _b) of the queries that have a passing choice in their keys: the
    best one as (matched, ord, payload, score)."""
    qd = _described(q, "_qn", "q").withColumn("_part", F.pmod(F.hash("_qn"), F.lit(PARTS)))
    cd = _described(c, "_cn", "c").withColumn("_part", F.explode(F.array(*[F.lit(i) for i in range(PARTS)])))
    total = F.col("_ql") + F.col("_cl")
    near = qd.where("_ql > 0").join(cd.where("_cl > 0"), [*keys, "_part"]).where(
        (200 * F.least("_ql", "_cl") >= F.lit(cutoff) * total) & (100 * _changes("_q", "_c") <= F.lit(100 - cutoff) * total + EPS))
    # Behind a generator, so that the filter on it does not compute it again.
    lcs = F.when(F.col("_qn") == F.col("_cn"), F.col("_ql")).otherwise(
        let(sim.pattern_masks("_cn"), lambda masks: sim.lcs("_cl", masks, "_qn")))
    scored = near.select(*keys, query_col, "matched", "ord", *payload, "_ql", "_cl", F.inline(F.array(F.struct(lcs.alias("_lcs")))))
    score = sim.ratio_from_lcs("_lcs", "_ql", "_cl").alias("score")
    return (scored.where(sim.passes_cutoff("_lcs", "_ql", "_cl", cutoff)).groupBy(*keys, query_col)
            .agg(F.max_by(F.struct("matched", "ord", *payload, score), F.struct(score, -F.col("ord"), "matched")).alias("_b")))


def _passing_pairs(q: DataFrame, c: DataFrame, scope: list[str], cutoff: float) -> DataFrame:
    """(scope, _qn, _cn, score) of the distinct normalised names of one vocabulary that
    pass the cutoff; ``scope`` is empty. Each candidate pair is scored once."""
    qv = q.select(*scope, "_qn").distinct().withColumn("_ql", F.length("_qn"))
    cv = (c.select(*scope, "_cn").distinct().withColumn("_cl", F.length("_cn"))
           .withColumn("_masks", sim.pattern_masks("_cn")))
    cand = _pairs_by_segments(qv, cv, cutoff)
    # Behind a generator, so that the filter on it does not compute it again.
    lcs = F.when(F.col("_qn") == F.col("_cn"), F.col("_ql")).otherwise(sim.lcs("_cl", "_masks", "_qn"))
    scored = cand.select(*scope, "_qn", "_cn", "_ql", "_cl", F.inline(F.array(F.struct(lcs.alias("_lcs")))))
    return (scored.where(sim.passes_cutoff("_lcs", "_ql", "_cl", cutoff))
                  .select(*scope, "_qn", "_cn", sim.ratio_from_lcs("_lcs", "_ql", "_cl").alias("score")))


def best_match(queries: DataFrame, choices: DataFrame, *, query_col: str, choice_col: str, ord_col: str,
               cutoff: float, keys: tuple[str, ...] = (), lower_query: bool = False,
               payload: tuple[str, ...] = (), one_vocabulary: bool = False, passing_only: bool = False) -> DataFrame:
    """For each distinct (keys, query) the best choice with score >= cutoff.

    ``queries``: keys + query_col. ``choices``: keys + choice_col + ord_col
    (+ payload). ``lower_query`` lower-cases the query side (the food matcher
    does; exercise and marker matchers keep case). Result: keys, query_col,
    matched (choice), ord, payload..., score; NULLs when nothing passes.

    ``one_vocabulary`` says that the choices of all keys come from one list of
    names: names are then compared over all keys together, once a pair, and
    the keys only decide which passing pairs count. Without it (each user's own
    names) names are compared inside their keys. ``passing_only`` leaves out the queries
    for which nothing passes.
    """
    keys = list(keys)
    # The generator keeps this distinct: without it the distinct of _qn would
    # take its place and normalise every row of the log.
    q = (queries.select(*keys, query_col).where(F.col(query_col).isNotNull()).distinct()
                .select("*", F.inline(F.array(F.struct(sim.token_sort(query_col, lower=lower_query).alias("_qn"))))))
    c = (choices.select(*keys, F.col(choice_col).alias("matched"), F.col(ord_col).alias("ord"), *payload)
                .withColumn("_cn", sim.token_sort("matched")))
    if keys and not one_vocabulary:
        best = _matches_in_keys(q, c, keys, query_col, payload, cutoff)
        if not passing_only:
            best = q.select(*keys, query_col).join(best, [*keys, query_col], "left")
    else:
        pairs, how = _passing_pairs(q, c, [], cutoff), "inner" if passing_only else "left"
        found = q.join(pairs, "_qn", how).join(c, [*keys, "_cn"], how)
        ranked = F.when(F.col("matched").isNotNull(),
                        F.struct("score", (-F.col("ord")).alias("_nord"), "matched", "ord", *payload))
        best = found.groupBy(*keys, query_col).agg(F.max(ranked).alias("_b"))
    return best.select(*keys, query_col, F.col("_b.matched").alias("matched"), F.col("_b.ord").alias("ord"),
                       *[F.col(f"_b.{p}").alias(p) for p in payload], F.col("_b.score").alias("score"))


def match_food(names: DataFrame, choices: DataFrame, name_col: str = "mention", cutoff: float = 85) -> DataFrame:
    """Food names -> (name, food_id, matched, ord, score, source). Input is
    lower-cased and stripped before scoring; choices are the built-in keys and
    aliases in source order, a fixed list that is broadcast."""
    m = best_match(names, F.broadcast(choices), query_col=name_col, choice_col="choice", ord_col="ord",
                   cutoff=cutoff, lower_query=True, payload=("food_id",))
    return m.withColumn("source", F.when(F.col("food_id").isNotNull(), F.lit("built-in")))


def match_exercise(names: DataFrame, allowed: DataFrame, cutoff: float = 90) -> DataFrame:
    """(equipment, mention) -> best library name allowed for that equipment
    profile, case kept; unmatched names get NULL (they are dropped from
    plans)."""
    return best_match(names, F.broadcast(allowed), query_col="mention", choice_col="name", ord_col="exercise_id",
                      cutoff=cutoff, keys=("equipment",), one_vocabulary=True)


def canonical_marker(mentions: DataFrame, known: DataFrame, cutoff: float = 90) -> DataFrame:
    """(user_id, mention) -> marker: the best known marker of that user
    (case kept), else the stripped mention unchanged."""
    k = known.select("user_id", F.col("marker")).distinct()
    k = k.withColumn("ord", F.dense_rank().over(Window.partitionBy("user_id").orderBy("marker")))
    m = best_match(mentions.select("user_id", strip("mention").alias("mention")), k,
                   query_col="mention", choice_col="marker", ord_col="ord", cutoff=cutoff, keys=("user_id",),
                   one_vocabulary=True)
    return m.select("user_id", "mention", F.coalesce("matched", "mention").alias("marker"), "score")
