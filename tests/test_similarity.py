"""Fuzzy score and matching against brute force."""
import random

from pyspark.sql import functions as F

from vitalis.functions import similarity as sim
from vitalis.operators import fuzzy


def lcs_brute(a: str, b: str) -> int:
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def token_sort(s: str, lower=False) -> str:
    s = s.lower() if lower else s
    return " ".join(sorted(s.split()))


def test_lcs_matches_brute_force_short_and_long(spark):
    rnd = random.Random(7)
    pairs = []
    for n in range(120):
        la = rnd.choice([0, 1, 5, 17, 40, 62, 63, 90, 150])
        lb = rnd.randint(0, 120)
        a = "".join(rnd.choice("abcde ") for _ in range(la))
        b = "".join(rnd.choice("abcdef ") for _ in range(lb))
        pairs.append((n, a, b))
    df = spark.createDataFrame(pairs, "id int, a string, b string")
    # Masks are a stored column in the pipeline; materialise them here too.
    masked = spark.createDataFrame(
        [tuple(r) for r in df.select("id", "a", "b", sim.pattern_masks("a").alias("m")).collect()],
        "id int, a string, b string, m map<string,array<bigint>>")
    out = masked.select("id", "a", "b", sim.lcs(F.length("a"), F.col("m"), F.col("b")).alias("l"))
    for r in out.collect():
        assert r.l == lcs_brute(r.a, r.b), (r.a, r.b)


def test_best_match_equals_brute_force(spark):
    rnd = random.Random(11)
    words = ["egg", "white", "rice", "brown", "chicken", "curry", "dal", "fry", "milk", "tea", "oats", "roti"]
    choices = []
    for i in range(60):
        c = " ".join(rnd.sample(words, rnd.randint(1, 3)))
        if c not in [x for _, x in choices]:
            choices.append((len(choices), c))
    queries = []
    for i in range(400):
        base = rnd.choice(choices)[1]
        q = list(base)
        for _ in range(rnd.randint(0, 3)):
            op = rnd.random()
            pos = rnd.randint(0, max(0, len(q) - 1))
            if op < 0.4 and q:
                q.pop(pos)
            elif op < 0.7:
                q.insert(pos, rnd.choice("aeiou"))
            elif q:
                q[pos] = rnd.choice("xyz")
        queries.append(("".join(q).upper() if rnd.random() < 0.2 else "".join(q),))
    qdf = spark.createDataFrame(queries, "mention string")
    cdf = spark.createDataFrame(choices, "ord long, choice string")
    got = {r.mention: (r.ord, r.score) for r in
           fuzzy.best_match(qdf, cdf, query_col="mention", choice_col="choice", ord_col="ord", cutoff=85,
                            lower_query=True).collect()}
    for (m,) in set(queries):
        qn = token_sort(m.strip(), lower=True)
        best = None
        for o, c in choices:
            cn = token_sort(c)
            tot = len(qn) + len(cn)
            l = lcs_brute(qn, cn)
            if tot and 200 * l >= 85 * tot:
                s = 200.0 * l / tot
                if best is None or s > best[1]:
                    best = (o, s)
        assert got[m] == (best if best else (None, None)), m


def test_let_binds_once_and_keeps_value(spark):
    from pyspark.sql import functions as F

    from vitalis.functions.expr import let
    df = spark.createDataFrame([("b a c",), ("",), (None,)], "s string")
    got = [r.x for r in df.select(let(F.split("s", " "), lambda a: F.size(a) + F.size(a)).alias("x")).collect()]
    assert got == [6, 2, None]  # size(NULL) is NULL under ANSI mode


def test_segments_find_every_passing_pair(spark):
    """Pairs of one large vocabulary: exactly those that pass, from few candidates."""
    rnd = random.Random(23)
    for cutoff, letters in ((90, "abcdefghijklmnopqrstuvwxyz"), (85.0, "ab"), (72, "abcdefgh")):
        names = {"".join(rnd.choice(letters) for _ in range(rnd.choice([1, 2, 3, 5, 9, 14, 22, 40]))) for _ in range(150)}
        queries = set(rnd.sample(sorted(names), 40)) | {"", "z" * 30}
        for _ in range(250):
            s = list(rnd.choice(sorted(names)))
            for _ in range(rnd.randint(1, 6)):
                p = rnd.randint(0, len(s))
                s[p:p + rnd.randint(0, 1)] = rnd.choice(letters) * rnd.randint(0, 1)
            queries.add("".join(s))
        names.add("")
        q = spark.createDataFrame([(x,) for x in queries], "_qn string")
        c = spark.createDataFrame([(x,) for x in names], "_cn string")
        want = {(a, b) for a in queries for b in names
                if a and b and 200 * lcs_brute(a, b) >= cutoff * (len(a) + len(b))}
        got = [(r._qn, r._cn) for r in fuzzy._passing_pairs(q, c, [], cutoff).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        if len(letters) == 26:
            cand = fuzzy._pairs_by_segments(q.withColumn("_ql", F.length("_qn")), c.withColumn("_cl", F.length("_cn")), cutoff)
            assert cand.count() <= 3 * len(want)


def test_own_names_meet_inside_their_keys_by_character_counts(spark):
    """Choices of each user: the best passing one as by brute force, and the counts lose
    no pair that passes while they leave out most others."""
    from pyspark.sql import functions as F
    rnd = random.Random(31)
    names = ["".join(rnd.choice("etaoinshr dlu") for _ in range(rnd.randint(1, 18))) for _ in range(60)] + ["", "é" * 300, "é" * 299 + "x"]
    choices = [(u, i, n) for u in (1, 2, None) for i, n in enumerate(rnd.sample(names, 40) + names[-3:])]
    queries = {(u, None) for u in (1, 2)}
    for _ in range(300):
        s = list(rnd.choice(names))
        for _ in range(rnd.randint(0, 2)):
            p = rnd.randint(0, len(s))
            s[p:p + rnd.randint(0, 1)] = rnd.choice("abé")
        queries.add((rnd.choice([1, 2, 3, None]), "".join(s)))
    q = spark.createDataFrame(sorted(queries, key=str), "user_id int, mention string")
    c = spark.createDataFrame(choices, "user_id int, ord long, name string")
    args = dict(query_col="mention", choice_col="name", ord_col="ord", cutoff=85, keys=("user_id",))
    got = {(r.user_id, r.mention): (r.ord, r.score) for r in fuzzy.best_match(q, c, **args).collect()}
    want = {}
    for u, m in queries:
        if m is None:
            continue
        qn, best = token_sort(m.strip()), (None, None)
        for cu, o, n in choices:
            cn = token_sort(n)
            if cu == u and u is not None and qn and cn and 200 * lcs_brute(qn, cn) >= 85 * (len(qn) + len(cn)):
                score = 200.0 * lcs_brute(qn, cn) / (len(qn) + len(cn))
                if best[1] is None or score > best[1]:
                    best = (o, score)
        want[u, m] = best
    assert got == want
    passing = {(r.user_id, r.mention): (r.ord, r.score) for r in fuzzy.best_match(q, c, passing_only=True, **args).collect()}
    assert passing == {k: v for k, v in want.items() if v[0] is not None}

    def described(letter):
        rows = spark.createDataFrame([(n,) for n in names], "n string").select(F.col("n").alias(f"_{letter}n"))
        return fuzzy._described(rows, f"_{letter}n", letter)
    pairs = described("q").crossJoin(described("c")).select("_qn", "_cn", fuzzy._changes("_q", "_c").alias("d")).collect()
    for r in pairs:
        assert r.d <= len(r._qn) + len(r._cn) - 2 * lcs_brute(r._qn, r._cn), r
    near = [r for r in pairs if 100 * r.d <= 15 * (len(r._qn) + len(r._cn)) and r._qn != r._cn]
    assert len(near) < len(pairs) / 20
