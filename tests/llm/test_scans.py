"""License scan, centroid clustering and conversation repair against brute force."""
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.conftest import odd_rows
from vitalis.llm import centroids, conversations, licenses, queries

SF = "/root/testdata/sf0.001"


# -- licenses -----------------------------------------------------------------

def base_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, lab) for p, lab in licenses.BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None),
            sorted({lab for _, lab in at}))


NOTES = ["All rights reserved.", "Licensed under CC-BY NC 4.0.", "the GNU General\nPublic  License, version 3", "cc by cc by",
         "ALL RIGHTS reserved all rights reserved", "é cc-by", "accc by", "cc bye", "All right reserved", "all_rights-reserved ü",
         "Released under the MIT License.", "Generals public license", "0 general public license 1"]


def test_licenses_on_odd_rows(spark, odd_docs, no_docs, clashing):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(NOTES + ["word", "é", "cc", "by", "all", "rights", "-"]) for _ in range(rng.randrange(12)))
             for _ in range(200)] + NOTES + ["word " * 200_000 + "all rights reserved", "cc by " * 50_000]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    src = clashing(odd_docs).unionByName(extra, allowMissingColumns=True).withColumn("__marks", licenses.F.lit(1))
    got = sorted(licenses.find_licenses(src).collect(), key=str)
    want = sorted([(r[0], *base_of(r[1])) for r in odd_rows()] + [(1000 + i, *base_of(t)) for i, t in enumerate(texts)], key=str)
    plain = sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, list(r.base_labels)) for r in got], key=str)
    assert plain == want
    for r in got:
        assert set(r.base_labels) <= set(r.labels) and list(r.labels) == sorted(set(r.labels)) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(set(r.labels) - {"unparsed", "restricted"})
    assert licenses.find_licenses(no_docs).count() == 0


def test_expressions():
    parse = lambda t, strict=True: licenses.parse(t, 0, strict)
    assert parse("MIT OR Apache-2.0") == (17, 1, ["mit", "apache-2.0"])
    assert parse("GPL-3.0-only OR MIT AND AGPL-3.0")[1] == 3  # AND binds tighter
    assert parse("(GPL-3.0-only OR MIT) AND AGPL-3.0")[1] == 4
    assert parse("GPL-2.0+ WITH Classpath-exception-2.0 AND MIT") == (45, 2, ["gpl-2.0-or-later", "classpath-exception-2.0", "mit"])
    assert parse("GPL-2.0 WITH My-own-thing")[1] == 3 and parse("MIT WITH GCC-exception-3.1")[1] == 1
    assert parse("MIT. And so on") == (3, 1, ["mit"])
    assert parse("MIT OR") == (3, 1, ["mit"]) and parse("MIT OR (") == (3, 1, ["mit"]) and parse("MIT)") == (3, 1, ["mit"])
    for bad in ("", "OR MIT", "((MIT", "()", ")", "( MIT OR )", "\nMIT"):
        assert parse(bad) == (0, None, [])
    assert parse("Foo OR MIT") == (10, 1, ["foo", "mit"]) and parse("Foo OR MIT", False) == (0, None, [])
    assert parse("MIT and some prose") == (3, 1, ["mit"])  # lower case: known identifiers only
    assert parse("mitigating", False) == (0, None, []) and parse("GPLv3", False) == (5, 3, ["gplv3"])
    assert parse("MIT WITH a WITH b") == (10, 1, ["mit", "a"])


def test_expression_values_against_brute_force():
    """Random bracketed expressions against Python's own evaluation."""
    rng = random.Random(1)
    names = {"MIT": 1, "MPL-2.0": 2, "GPL-3.0": 3, "AGPL-3.0": 4, "Foo": 5}

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            n = rng.choice(list(names))
            return n, names[n]
        (a, x), (b, y) = make(depth - 1), make(depth - 1)
        op = rng.choice(["AND", "OR"])
        return f"({a} {op} {b})", (max if op == "AND" else min)(x, y)

    for _ in range(300):
        text, want = make(4)
        end, got, found = licenses.parse(text)
        assert (end, got) == (len(text), want) and len(found) == len(re.findall(r"[A-Z][\w.-]*", text)) - len(re.findall("AND|OR ", text))


def test_tags_and_offsets():
    text = "é // SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Zlib\nint x; license = \"Apache-2.0\""
    r = licenses.Scan(text).row()
    assert [text[e["start"]:e["end"]] for e in r["expressions"]] == ["(MIT OR GPL-2.0-only) AND Zlib", "Apache-2.0"]
    assert r["labels"] == ["apache-2.0", "gpl-2.0-only", "mit", "permissive", "zlib"]
    assert licenses.Scan("SPDX-License-Identifier: !").row()["labels"] == ["restricted", "unparsed"]
    assert licenses.Scan("a license is what the mitre wants").row()["labels"] == []


# -- centroids ----------------------------------------------------------------

def brute_clusters(rows, n, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) if abs(x) < 1e300 else int(x) * 64 for x in v]) for i, v in rows
            if v is not None and len(v) == n and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [list(r[1]) for r in order[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    pick = lambda v: min(range(len(cents)), key=lambda j: (dist(v, cents[j]), j))
    for _ in range(rounds):
        who = [pick(v) for _, v in kept]
        for j in range(len(cents)):
            mine = [v for w, (_, v) in zip(who, kept) if w == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [(i, pick(v), v) for i, v in kept]
    fit = lambda v: v if v is not None and v < 1 << 63 else None
    d = [fit(dist(v, cents[j])) for _, j, v in last]
    sums = {}
    for (_, j, _), x in zip(last, d):
        sums.setdefault(j, []).append(x)
    total = {j: None if None in x else sum(x) for j, x in sums.items()}
    every = None if None in total.values() else sum(total.values())
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted([(i, j, x, fit(total[j]), fit(every), sha[j]) for (i, j, _), x in zip(last, d)], key=str)


def clusters_of(df, **more):
    return sorted(map(tuple, centroids.cluster(df, **more)[0].collect()), key=str)


KIND = "vec_id long, embedding array<float>, cluster int, distance string, v int"


def test_centroids(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=64) * rng.choice([0.1, 1, 30])]) for i in range(150)]
    rows += [(3, rows[3][1])] * 4 + [(500 + i, rows[9][1]) for i in range(30)] + [(None, rows[7][1]), (None, rows[8][1])]
    rows += [((1 << 60) + 1, rows[1][1]), (601, None), (602, []), (603, [None] + [1.0] * 63), (604, [math.nan] * 64),
             (605, [math.inf] * 64), (606, [1.0] * 63), (607, [0.0] * 64), (608, [-0.0] * 64), (609, [-0.3] * 64)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], KIND)
    want = brute_clusters(rows, 64)
    assert clusters_of(df.repartition(5)) == want
    assert clusters_of(df.repartition(2)) == want
    big = rows + [(700, [1e30] * 64), (701, [-3e7] * 32 + [1.0] * 32), (702, [3.4e38] * 64)]
    big = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in big]
    assert clusters_of(spark.createDataFrame([(*r, 1, "x", 2) for r in big], KIND).repartition(3)) == brute_clusters(big, 64)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [1.0] * 64), (3, [0.5] * 64)], "vec_id long, embedding array<float>")
    assert clusters_of(df) == brute_clusters([(r.vec_id, r.embedding) for r in df.collect()], 64)
    none = centroids.cluster(df.limit(0))
    assert none[0].count() == 0 and none[1] == []


def test_bounds_are_bounds_and_leave_out():
    rng = np.random.default_rng(0)
    x = rng.integers(-30, 30, size=(400, 64)) + rng.integers(-300, 300, size=(8, 64))[rng.integers(8, size=400)]
    piv = x[:16].astype(np.int64)
    pairs = centroids.pivot_pairs(piv)
    assert 0 < len(pairs) <= centroids.PAIRS
    m = centroids.Model(piv, x[20:36], pairs)
    low = centroids.lower_bounds(m.distances(x), m.centroid_pivots, pairs)
    exact = ((x[:, None, :] - m.centroids[None]) ** 2).sum(axis=2)
    assert (low <= exact).all()
    who, dist, done = centroids.nearest(x, m.distances(x), m.centroids, m.centroid_pivots, pairs)
    assert (who == exact.argmin(axis=1)).all() and (dist == exact.min(axis=1)).all() and done < 0.7 * exact.size


# -- conversations ------------------------------------------------------------

GRAMMAR = re.compile(r"(s?(ua)+)?")


def brute_edits(rows):
    """All (cost, audit, lines) by plain enumeration of edits and inserts."""
    best = None
    options = []
    for role, text, fault in rows:
        edits = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            edits += [("K", more, (role, text)), ("R", 1 + more, ("user", text)), ("R", 1 + more, ("assistant", text))]
        options.append(edits)
    inserts = [()] + [tuple(c) for n in (1, 2) for c in itertools.product(("user", "assistant"), repeat=n)]
    for edits in itertools.product(*options):
        base = sum(e[1] for e in edits)
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            cost = base + 5 * sum(map(len, put))
            if best and cost > best[0]:
                continue
            audit, lines = "I" * len(put[0]), [(r, "") for r in put[0]]
            for e, p in zip(edits, put[1:]):
                audit += e[0] + "I" * len(p)
                lines += ([e[2]] if e[2] else []) + [(r, "") for r in p]
            if GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def dynamic_edits(rows):
    """The same by a table of (cost, audit, lines) a state, message by message."""
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserts(table):
        for _ in range(2):
            for st, (c, a, ls) in list(table.items()):
                to = nxt[st]
                new = (c + 5, a + "I", ls + [(name[to], "")])
                if to not in table or new[:2] < table[to][:2]:
                    table[to] = new
        return table

    table = inserts({"": (0, "", [])})
    for role, text, fault in rows:
        out = {}

        def put(st, new):
            if st not in out or new[:2] < out[st][:2]:
                out[st] = new

        for st, (c, a, ls) in table.items():
            put(st, (c + 2, a + "D", ls))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            i = role[:1]
            if i == nxt[st] or (i == "s" and st == ""):
                put(i, (c + more, a + "K", ls + [(role, text)]))
            put(nxt[st], (c + 1 + more, a + "R", ls + [(name[nxt[st]], text)]))
        table = inserts(out)
    return min(table[s] for s in ("", "a") if s in table)


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else
                    "truncated" if body[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def damage_brute(rows):
    out = []
    for conv, turn, role, text in rows:
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if f == 0:
            continue
        if f == 1:
            text = ""
        if f == 2:
            text = re.sub("[.!?]", "", text)
        if f == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if f == 3 else 1)
    return out


def report_brute(rows, damage=True):
    after = damage_brute(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out, lines = [], {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(),
                     hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest())
    for conv in {r[0] for r in rows}:
        mine = sorted([r for r in after if r[0] == conv], key=key)
        turns = [t for _, t, _, _ in mine if t is not None]
        marked = faults_of([r[2:] for r in mine])
        cost, audit, ls = dynamic_edits(marked)
        count = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in ls).encode()).hexdigest()))
        lines[conv] = ls
    return sorted(out, key=str), lines


def test_search_against_plain_enumeration():
    rng = random.Random(7)
    for _ in range(120):
        rows = faults_of([(rng.choice(["system", "user", "assistant", "tool", "", "user"]), rng.choice(["a.", "b", "", "c!", "d?"]))
                          for _ in range(rng.randrange(4))])
        cost, audit, lines = brute_edits(rows)
        assert dynamic_edits(rows) == (cost, audit, lines)
        steps = [1 if f in ("blank", "duplicate") else conversations.kind_of(r, f == "truncated") for r, _, f in rows]
        assert conversations.search(steps) == (cost, audit)
        got = conversations.apply_edits(audit, [1 if isinstance(s, int) else r[:2] for s, r in zip(steps, rows)], 0)
        assert [m[1:3] for m in got] == lines


def test_search_is_linear_in_long_conversations():
    rng = random.Random(3)
    steps = [(rng.choice("sua?"), rng.random() < 0.3) for _ in range(20_000)]
    cost, audit = conversations.search(steps)
    assert len(audit.replace("I", "")) == len(steps) and cost > 0


def messy_conversations(seed, n=400, convs=40):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([0, 0, 0, None, *range(convs)])  # conversation 0 is long
        rows.append((c, rng.choice([None, *range(60)]) if c == 0 else rng.choice([None, -3, *range(9)]),
                     rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
                     rng.choice(["a.", "bé", "", "c!", "d?", None, " \n", "long text " * 5 + ".", f"{rng.random()}."])))
    return rows + rows[:20]


CONV = "conv_id long, turn long, role string, text string, cost int, audit string, part int, copies_ int"


@pytest.mark.parametrize("rows_in_block,partitions", [(2048, 1), (5, 3), (1, 7)])
def test_repair(spark, monkeypatch, rows_in_block, partitions):
    monkeypatch.setattr(conversations, "BLOCK_ROWS", rows_in_block)
    rows = messy_conversations(rows_in_block, n=400)
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], CONV).repartition(partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        want, _ = report_brute(rows)
        got = sorted(map(tuple, conversations.repair(conversations.damaged(df)).report.collect()), key=str)
        assert got == want
        want, lines = report_brute(rows, damage=False)
        fixed = conversations.repair(df, messages=True)
        assert sorted(map(tuple, fixed.report.collect()), key=str) == want
        found = {}
        for r in sorted(fixed.messages.collect(), key=lambda r: r.position):
            found.setdefault(r.conv_id, []).append((r.role, r.text))
        assert found == {c: x for c, x in lines.items() if x}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repair_of_nothing_and_of_repeats(spark):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in messy_conversations(1)], CONV)
    assert conversations.repair(df.limit(0)).report.count() == 0
    # A conversation whose only message is dropped, and one of 5,000 equal rows.
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    hot = next(c for c in range(-1, -1000, -1) if zlib.crc32(f"{c}: ".encode()) % 20 > 4)
    rows = [(gone, 0, "user", "x.")] + [(hot, None, "user", "ok.")] * 5000
    got = {r.conv_id: r for r in conversations.repair(conversations.damaged(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).report.collect()}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got[hot].duplicate, got[hot].audit, got[hot].illegal, got[hot].cost) == (4999, "D" * 5000, 4999, 10_000)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_queries_of_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_conversation_repair(spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == report_brute(rows)[0]
    vec = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op12_centroid_clustering(spark, SF).collect()), key=str) == brute_clusters(vec, 64)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r.doc_id: r for r in queries.op11_license_scan(spark, SF).collect()}
    for d in docs:
        r = found[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (*base_of(d.text)[:4], ",".join(base_of(d.text)[4]))
