"""Operators on documents against brute force, and on odd rows."""
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer
import xxhash

from tests.llm.conftest import PROSE, odd_rows
from vitalis.llm import decontaminate, langid, mixing, passages, pii, pretokens, repair, simhash, token_counts, token_shards, tokens
from vitalis.llm.common import components, forest

SF = "/root/testdata/sf0.001"


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def union_find(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return find


# -- helpers ------------------------------------------------------------------

def test_forest_and_components(spark):
    rnd = random.Random(5)
    for n, m in ((30, 12), (200, 120), (60, 300)):
        links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + 40)]
        find = union_find(range(n + 41), links)
        a, b = forest(*(np.array(x) for x in zip(*links)))
        assert {int(x): int(y) for x, y in zip(a, b)} == {i: find(i) for i in range(n + 41) if find(i) != i}
        df = spark.createDataFrame(links + [(None, 3)], "a long, b long").repartition(4)
        got = {r.node: r.root for r in components(df).collect()}
        linked = {x for p in links if p[0] != p[1] for x in p}
        assert got == {i: find(i) for i in linked}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- SimHash ------------------------------------------------------------------

def simhash_of(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for r in odd_rows():
        assert simhash.fingerprint(r[1], 4) == (simhash_of(r[1]) if len(r[1] or "") < 10_000 else simhash.fingerprint(r[1], 4))


def test_every_pair_within_the_bits_meets_at_a_home():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2 ** 64, 4000, np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    home = simhash.home_keys(a)
    placed = np.hstack([simhash.home_keys(b), *simhash.replica_keys(b, 4)])
    assert all(set(h) & set(p) for h, p in zip(home.tolist(), placed.tolist()))


def test_link_fingerprints(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2 ** 63, 40).tolist()
    fps = sorted({f ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 6), replace=False)) for f in base for _ in range(12)})
    links = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= 4]
    find = union_find(fps, links)
    got = {r.node: r.root for r in simhash.link_fingerprints(
        spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)).collect()}
    assert {f: got.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_simhash_on_odd_rows(odd_docs, clashing):
    rows = odd_rows()
    got = simhash.near_duplicates(clashing(odd_docs)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[8].component_id == 1  # equal texts
    # Null, empty and blank texts share fingerprint 0 and link.
    assert by[4].fp == by[5].fp == by[6].fp == 0 and by[6].component_id == 4
    kept = simhash.keep_one(clashing(odd_docs))
    assert kept.columns == clashing(odd_docs).columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(8) == 0 and ids.count(1) == 1 and 5 not in ids and ids.count(None) == 1


# -- decontamination ----------------------------------------------------------

def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def contamination_of(t, items, window=10):
    w, hit, found = words(t), set(), set()
    for item, text in items:
        v = words(text)
        for win in {tuple(v[i:i + window]) for i in range(max(1, len(v) - window + 1))} if v else ():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


ITEMS = [(1, "What jumps over the lazy dog, and then they were thinking? Nothing."), (2, "Fuchs springt"), (10, None),
         (11, ""), (12, "DACHTEN sie nach"), (None, "renard brun"), (1, "jumps OVER the lazy"), (3, "four"),
         (4, "the quick brown fox jumps over the lazy dog and then they were thinking about what the weather would be")]


@pytest.mark.parametrize("block", [50_000, 3])
def test_contamination(spark, odd_docs, clashing, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(clashing(odd_docs), items, block_windows=block).collect()
    want = {}
    for r in odd_rows():
        want.setdefault((r[0], r[5 - 1]), contamination_of(r[1] if len(r[1] or "") < 10_000 else None, ITEMS))
    texts = {r[0]: r[1] for r in odd_rows()}
    for r in got:
        t = texts.get(r.doc_id)
        if r.doc_id is None or len(t or "") > 10_000:
            continue
        n, hit, found = contamination_of(t, ITEMS)
        assert (r.n_words, r.n_hit, r.item_ids, r.contaminated) == (n, hit, found, hit > 0)
        assert sum(len(words(t[s.start:s.end])) for s in r.spans) == hit
    assert sum(r.contaminated for r in got) >= 5


def test_clean_only_and_empty_tables(spark, odd_docs, no_docs, clashing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    src = clashing(odd_docs)
    out = decontaminate.clean_only(src, items)
    assert out.columns == src.columns
    ids = {r.doc_id for r in out.collect()}
    assert not ids & {1, 2, 3, 8, 12} and {4, 5, 6, 7, 9, 10, 11} <= ids
    assert decontaminate.clean_only(no_docs, items).count() == 0
    assert decontaminate.clean_only(odd_docs, items.limit(0)).count() == odd_docs.count()


# -- mixing -------------------------------------------------------------------

def water_fill(sizes):
    """Targets by resharing until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        left = budget - sum(out.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return out


def test_mixing(odd_docs, clashing, no_docs):
    rows = odd_rows()
    got = mixing.mix_plan(clashing(odd_docs)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, source = {}, {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
        source[r[0]] = r[3]
    goal = water_fill(sizes)
    taken = {s: 0 for s in sizes}
    for r in got:
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        if r.doc_id is not None:
            s = source[r.doc_id]
            assert r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-6
            taken[s] += r.taken
    largest = {s: max(size(r[1]) for r in rows if r[3] == s) for s in sizes}
    assert all(abs(taken[s] - goal[s]) <= largest[s] + 60 for s in sizes if s != "a")
    again = mixing.mix_plan(odd_docs.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mix(clashing(odd_docs))
    assert mixed.columns == clashing(odd_docs).columns
    assert sum(size(r.text) for r in mixed.select("text").collect()) == sum(r.taken for r in got)
    assert mixing.mix_plan(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


# -- personal data ------------------------------------------------------------

def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2)
               for i, c in enumerate(reversed(d))) % 10 == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15)]

PIECES = ["a.b@c.de", "x@y@z.org.", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111",
          "4111-1111-1111-1112", "5500000000000004", "+49 (30) 123.456-78", "+1 2", "+123456789012345678", " ", "  ", "-", ".",
          "@", "+", "7", "12", "é", "😀", "_x@d.e-f.gh", "a@b", "\n", "call", "card 3782 822463 10005", "378282246310005",
          "IBAN DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB82WEST12345698765431", "ssn 123-45-6789", "123-45-6789"]


def test_pii(spark):
    rnd = random.Random(9)
    texts = [None, "", "a@b.c" * 3, "9" * 5000, "a" * 20_000 + "@", "x@" + "y." * 3000 + "z", "1." * 3000, "4111111111111111 " * 900]
    texts += ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 9))) for _ in range(1500)]
    texts += texts[:3]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in pii.find_pii(rows).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        for kind, pattern, valid in BASE:
            want = [(m.start(), m.end()) for m in re.finditer(pattern, t or "") if valid(m.group())]
            assert [(s.start, s.end) for s in got[i][f"pii_{kind}"]] == want, (t[:80], kind)
            assert all(0 < s.score <= 1 for s in got[i][f"pii_{kind}"])


def test_added_kinds(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 here", "GB82WEST12345698765432", "GB82WEST12345698765431",
             "my ssn: 123-45-6789", "part 123-45-6789", "ssn 000-45-6789", "amex 378282246310005", "id 378282246310005"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (len(r.pii_iban), len(r.pii_ssn), len(r.pii_card_short)) for r in pii.find_pii(rows).collect()}
    assert [got[i] for i in range(8)] == [(1, 0, 0), (1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 0, 0), (0, 0, 0), (0, 0, 1), (0, 0, 0)]


# -- tokens -------------------------------------------------------------------

MESS = ["'s", "'t", "'re", "'ll", "'", "s", "re", "l", "a", " ", "  ", "\n", "\t", " ", " ", "1", "²", "!", "é", "中", "😀",
        "<|endoftext|>", "͸", "\x00", "́", "A", "'D", "x" * 300]


def messy(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(MESS) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_encoder_equals_the_library():
    enc = tokens.Encoder(tokens.default_vocabulary())
    plain = Tokenizer.from_file(tokens.default_vocabulary())
    assert enc.encode(["hello <|endoftext|> x"])[0].tolist() == [31373, 220, 50256, 2124]
    texts = messy(8000, 3) + [r[1] or "" for r in odd_rows()]
    for size in (1, 500):
        part = texts[:400] if size == 1 else texts
        for i in range(0, len(part), size):
            ids, n = enc.encode(part[i:i + size])
            want = [e.ids for e in plain.encode_batch(part[i:i + size], add_special_tokens=False)]
            assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]


def test_repair_round_trip():
    rng = np.random.default_rng(0)
    for _ in range(150):
        sizes = rng.integers(0, 6, rng.integers(1, 40))
        ids = rng.integers(0, rng.integers(1, 5), sizes.sum()).astype(np.uint16)
        part = repair.compress(ids, sizes, 50257, min_count=2)
        shard = repair.load(repair.dump(part, 50257, np.arange(len(sizes)), np.zeros(len(sizes))))
        assert (repair.Grammar(shard, 50257).expand(shard["symbols"]) == ids).all()
        ends = np.cumsum(sizes)
        data = repair.dump(part, 50257, np.arange(len(sizes)), np.zeros(len(sizes)))
        file = repair.ShardFile(lambda begin, size: data[begin:begin + size])
        for k in range(len(sizes)):
            own = ids[ends[k] - sizes[k]:ends[k]].tolist()
            assert file.document(k).tolist() == own
            assert all(file.document(k, i, j).tolist() == own[i:j] for i in range(6) for j in range(i, 7))
    ids = np.tile(np.arange(8, dtype=np.uint16), 500)
    part = repair.compress(ids, np.array([len(ids)]), 50257)
    assert len(part["symbols"]) <= len(ids) / 4 and len(part["rules"])


def test_no_frequent_pair_is_left():
    """The most frequent pair of a round is replaced, so none stays that rounds could take."""
    rng = np.random.default_rng(1)
    for kinds, room in ((40, 50257), (300, 70000)):
        ids = (rng.zipf(1.3, 30000) % kinds).astype(np.uint32)
        sizes = np.full(300, 100)
        part = repair.compress(ids, sizes, room, pairs_a_round=20)
        left = Counter()
        at = 0
        for n in part["doc_symbols"].tolist():
            own = part["symbols"][at:at + n].tolist()
            left.update(zip(own, own[1:]))
            at += n
        size = lambda x: 1 if x < room else int(part["lengths"][x - room])
        over = {p: c for p, c in left.items() if c >= repair.MIN_COUNT and size(p[0]) + size(p[1]) <= repair.MAX_EXPANSION}
        assert not over and len(part["rules"]) > 100
        assert (repair.Grammar(part, room).expand(part["symbols"]) == ids).all()


def test_documents_by_byte_range(spark, odd_docs, tmp_path):
    index = token_shards.write_shards(odd_docs, str(tmp_path / "ids"), shard_ids=500)
    places = index.selectExpr("part", "block", "explode(sequence(-1, n_docs)) as k").unionByName(
        spark.createDataFrame([(0, 0, None), (99, 0, 0)], "part long, block long, k long"))
    got = sorted(token_shards.read_documents(index, places).collect(), key=lambda r: (r.part, r.block, r.k))
    whole = sorted(token_shards.read_shards(index).collect(), key=lambda r: r.start)
    assert [(len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got] == [(r.n_tokens, r.ids_crc32) for r in whole]


def test_token_shards(spark, odd_docs, no_docs, clashing):
    enc = Tokenizer.from_file(tokens.default_vocabulary())
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, ))
    got = token_shards.token_output(clashing(odd_docs)).collect()
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append(enc.encode(r[1] or "", add_special_tokens=False).ids + [0])
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    at = 0
    for r in got:
        crcs = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids[r.doc_id]]
        assert r.start == at and r.ids_crc32 in crcs and r.n_tokens in [len(x) for x in ids[r.doc_id]]
        at += r.n_tokens
    assert token_shards.token_output(no_docs).count() == 0


def test_many_shards(spark, odd_docs, tmp_path):
    index = token_shards.write_shards(odd_docs, str(tmp_path / "ids"), shard_ids=500)
    assert index.count() > 3
    got = sorted(token_shards.read_shards(index).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def best_cut(word, pieces):
    """Fewest pieces of a most probable cutting, by trying all."""
    best = {0: (0.0, 0)}
    for end in range(1, len(word) + 1):
        options = [(best[b][0] + pieces[word[b:end]], best[b][1] + 1) for b in range(end) if word[b:end] in pieces]
        top = max(o[0] for o in options)
        best[end] = (top, min(o[1] for o in options if o[0] == top))
    return best[len(word)][1]


def test_token_counts(odd_docs, no_docs, clashing):
    pieces = token_counts.load_pieces(token_counts.default_vocabulary())
    own = token_counts.counter(token_counts.default_vocabulary())
    pattern = __import__("regex").compile(__import__("public_tokenizers").PATTERN)
    texts = [t for t in messy(600, 4) if "͸" not in t and "x" * 300 not in t] + list(PROSE.values())
    pre, tok = own.count(texts)
    for t, p, n in zip(texts, pre, tok):
        cut = pattern.findall(t)
        assert p == len(cut) and n == sum(best_cut(c.encode(), pieces) for c in cut)
    got = token_counts.count_tokens(clashing(odd_docs)).collect()
    assert len(got) == odd_docs.count() and all(r.n_tokens == 0 for r in got if r.doc_id in (4, 5))
    assert token_counts.count_tokens(no_docs).count() == 0


def test_pretokens_follow_the_pattern():
    pattern = __import__("regex").compile(__import__("public_tokenizers").PATTERN)
    texts = [t for t in messy(5000, 8) if "͸" not in t]
    cut = pretokens.Cut(texts)
    got = cut.strings(np.arange(len(cut.start)))
    assert [got[i:j] for i, j in zip(cut.bounds, cut.bounds[1:])] == [pattern.findall(t) for t in texts]


def test_token_counts_of_unknown_code_points():
    pieces = token_counts.load_pieces(token_counts.default_vocabulary())
    own = token_counts.counter(token_counts.default_vocabulary())
    pattern = __import__("regex").compile(__import__("public_tokenizers").PATTERN)
    texts = ["!\u0378!", "a \u0378\u0378. b", "\u0378", "plain text", ""] + [t for t in messy(1500, 15) if "x" * 300 not in t]
    assert sum("\u0378" in t for t in texts) > 200
    for size in (len(texts), 1):
        part = texts if size > 1 else texts[:200]
        for i in range(0, len(part), size):
            for t, p, n in zip(part[i:i + size], *own.count(part[i:i + size])):
                cut = pattern.findall(t)
                assert p == len(cut) and n == sum(best_cut(c.encode(), pieces) for c in cut), t


# -- language -----------------------------------------------------------------

def longest_matches(text, sample):
    """Phrases of a text against a sample, one longest match after another."""
    n = i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[i:j + 1] in sample:
            j += 1
        i = max(j, i + 1)
        n += 1
    return n


def test_phrases_are_longest_matches():
    samples = {k: [v] for k, v in PROSE.items()}
    model = langid.Model(samples)
    texts = ["the dog thinks about the weather", "über den hund", "xyz qq", "le chien brun", "a"]
    counts, _ = model.phrases(texts)
    for t, row in zip(texts, counts):
        for lang, n in zip(model.languages, row):
            sample = "".join(map(chr, langid.normalise(PROSE[lang]))) + " "
            want = longest_matches(t, sample)
            assert want <= n <= want + 1, (t, lang)


@pytest.mark.parametrize("cells", [langid.DENSE_CELLS, 0] if hasattr(langid, "DENSE_CELLS") else [0])
def test_every_letter_of_a_large_script_counts(monkeypatch, cells):
    monkeypatch.setattr(langid, "DENSE_CELLS", cells, raising=False)
    rnd = random.Random(14)
    signs = [chr(0x4E00 + i) for i in range(1500)]
    zipf = [1 / (i + 1) for i in range(len(signs))]
    zh = "".join(signs) + "".join(rnd.choices(signs, zipf, k=6000))
    ja = "".join(chr(0x3041 + rnd.randrange(80)) for _ in range(900))
    samples = {"zh": [zh[:4000], zh[4000:]], "ja": [ja], **{k: [v] for k, v in PROSE.items()}}
    model = langid.Model(samples)
    texts = ["".join(signs[900:1100]), "".join(rnd.choices(signs, zipf, k=200)), ja[100:300], "über den " + signs[1400] * 3,
             zh[3950:4050], "ΑΒΓ"]
    counts, size = model.phrases(texts)
    for t, row in zip(texts, counts):
        for lang, n in zip(model.languages, row):
            sample = "".join("".join(map(chr, langid.normalise(v))) + " " for v in samples[lang])
            want = longest_matches("".join(map(chr, langid.normalise(t))), sample)
            assert want <= n <= want + 1, (t, lang)
    assert model.predict(texts[:3])[0] == ["zh", "zh", "ja"] and counts[0][model.languages.index("zh")] <= 2


def test_language_id(spark, odd_docs, no_docs, clashing):
    model = langid.fit(odd_docs)
    got = {r.doc_id: r for r in langid.identify(clashing(odd_docs).drop("score", "lang_pred"), model).collect()}
    for r in got.values():
        assert 0 <= r.score <= 1 and r.lang_pred in {*PROSE, "und"}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6, 7))
    assert (got[1].lang_pred, got[2].lang_pred, got[3].lang_pred) == ("en", "de", "fr")
    src = clashing(odd_docs)
    kept = langid.known_language_only(src)
    assert kept.columns == src.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {1, 2, 3, 8} <= ids and not ids & {4, 5, 6, 7}
    assert langid.identify(no_docs, langid.fit(no_docs)).count() == 0
    nothing = langid.identify(odd_docs, langid.fit(no_docs)).collect()
    assert all(r.lang_pred == "und" for r in nothing)


def test_marks_alone_are_no_text(odd_docs):
    model = langid.fit(odd_docs)
    lang, score, _ = model.predict(["\u0301\u0302", "e\u0301", "1 \u0301 2", "", "the quick brown \u0301 fox"])
    assert [x == "und" for x in lang] == [True, False, True, True, False] and score[0] == score[2] == 0


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "zzz yyy" if zlib.crc32(str(i).encode()) % 3 == 1 else "abc abd", "aa") for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all("z" not in t for v in model.samples.values() for t in v)


# -- passages -----------------------------------------------------------------

def prose(rnd, n):
    return [f"w{rnd.randrange(4000)}" for _ in range(n)]


def test_passages(spark, odd_docs, no_docs, clashing):
    rnd = random.Random(12)
    passage = prose(rnd, 70)
    fuzzy = passage[:30] + ["changed"] + passage[31:50] + ["one", "two"] + passage[50:]
    short = prose(rnd, 15)
    texts = {1: prose(rnd, 200) + passage + prose(rnd, 50), 2: prose(rnd, 80) + fuzzy + prose(rnd, 90),
             3: passage + prose(rnd, 30), 4: prose(rnd, 100) + short, 5: short + prose(rnd, 100), 6: prose(rnd, 300)}
    rows = [(i, " ".join(t)) for i, t in texts.items()] + [(7, " ".join(texts[6])), (8, None), (9, ""), (3, " ".join(texts[3]))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = {(r.doc_id, r.source_id) for r in got}
    assert found == {(2, 1), (3, 1), (7, 6)}
    for r in got:
        a, b = texts[min(r.doc_id, 6)], texts[r.source_id]
        assert r.similarity >= 0.8 and r.end_word - r.first_word >= 40
        if r.doc_id != 2:
            assert a[r.first_word:r.end_word] == b[r.source_first_word:r.source_end_word]
    three = [r for r in got if r.doc_id == 3]
    assert [(r.first_word, r.end_word, r.source_first_word, r.source_end_word) for r in three] == [(0, 70, 200, 270)]
    assert passages.repeated_passages(no_docs).count() == 0
    odd = {(r.doc_id, r.source_id) for r in passages.repeated_passages(clashing(odd_docs)).collect()}
    assert (10, 9) in odd


def test_chains_against_all_predecessors():
    rnd = random.Random(3)
    for _ in range(200):
        pts = sorted({(rnd.randrange(60), rnd.randrange(60)) for _ in range(rnd.randint(1, 14))})
        x, y = [p[0] for p in pts], [p[1] for p in pts]
        best = []
        for j in range(len(pts)):
            s = 5.0
            for i in range(j):
                if x[i] < x[j] and y[i] < y[j]:
                    s = max(s, 5 + best[i] - 0.05 * (x[j] - x[i] + y[j] - y[i]))
            best.append(s)
        chains = passages.chains_of(x, y)
        assert sorted(t for c in chains for t in c) == list(range(len(pts)))
        c = chains[0]
        score = 5.0 * len(c) - 0.05 * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]])
        assert abs(score - max(best)) < 1e-9


def test_common_subsequence():
    rnd = random.Random(4)
    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 9))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
        assert passages._common(a, b) == table[-1][-1]


def test_digest_forms():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_passage_shared_in_part_with_an_earlier_document(spark):
    rnd = random.Random(5)
    words = lambda n: [f"w{rnd.randrange(10 ** 7)}" for _ in range(n)]
    rows, want = [], set()
    for i, cut in enumerate(range(6, 38, 6)):
        p, a = words(60), 3 * i
        rows += [(a, words(50) + p[:cut] + words(50)), (a + 1, words(70) + p + words(30)), (a + 2, words(20) + p + words(90))]
        want.add((a + 2, 20, 80, a + 1, 70, 130))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = {tuple(r)[:6] for r in passages.repeated_passages(df).collect()}
    assert got == want


def test_chains_with_steps_of_bounded_width():
    rnd = random.Random(8)
    for _ in range(200):
        pts = sorted({(rnd.randrange(90), rnd.randrange(90)) for _ in range(rnd.randint(1, 25))})
        x, y = [p[0] for p in pts], [p[1] for p in pts]
        best = []
        for j in range(len(pts)):
            before = [best[i] - 0.05 * (x[j] - x[i] + y[j] - y[i]) for i in range(j)
                      if 0 < x[j] - x[i] <= 12 and 0 < y[j] - y[i] <= 12]
            best.append(5 + max([0.0, *before]))
        c = passages.chains_of(x, y, max_gap=12)[0]
        assert abs(5.0 * len(c) - 0.05 * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]]) - max(best)) < 1e-9


def test_two_passages_of_one_pair_of_documents(spark):
    rnd = random.Random(6)
    words = lambda n: [f"w{rnd.randrange(10 ** 7)}" for _ in range(n)]
    rows, want = [], set()
    for i, (one, between, two) in enumerate([(200, 150, 200), (200, 300, 300), (1000, 300, 500)]):
        p, q = words(one), words(two)
        rows += [(2 * i, words(20) + p + words(between) + q + words(5)), (2 * i + 1, words(7) + p + words(between) + q + words(30))]
        want |= {(2 * i + 1, 7, 7 + one, 2 * i, 20, 20 + one),
                 (2 * i + 1, 7 + one + between, 7 + one + between + two, 2 * i, 20 + one + between, 20 + one + between + two)}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    assert {tuple(r)[:6] for r in passages.repeated_passages(df).collect()} == want


def test_passage_whose_parts_earlier_documents_hold(spark):
    rnd = random.Random(7)
    words = lambda n: [f"w{rnd.randrange(10 ** 7)}" for _ in range(n)]
    rows, want = [], set()
    for i, cuts in enumerate([(30,)] * 12 + [(20, 40)] * 8):
        p, d = words(60), 10 * i
        for k, (lo, hi) in enumerate(zip((0, *cuts), (*cuts, 60))):
            rows.append((d + k, words(50) + p[lo:hi] + words(50)))
        rows += [(d + 8, words(70) + p + words(30)), (d + 9, words(20) + p + words(90))]
        want.add((d + 9, 20, 80, d + 8, 70, 130))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    assert {tuple(r)[:6] for r in passages.repeated_passages(df).collect()} == want


def test_changed_passages_are_found(spark):
    rnd = random.Random(11)
    words = lambda n: [f"w{rnd.randrange(10 ** 7)}" for _ in range(n)]
    rows, kinds = [], [(40, 0.1), (55, 0.15), (80, 0.1), (80, 0.2), (120, 0.2)]
    for i in range(250):
        n, rate = kinds[i % 5]
        p = words(n)
        q = list(p)
        for k in rnd.sample(range(1, n - 1), round(n * rate)):
            q[k] = words(1)[0]
        rows += [(2 * i, words(70) + p + words(70)), (2 * i + 1, words(50) + q + words(90))]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = passages.repeated_passages(df).collect()
    text = dict(rows)
    for r in got:
        a, b = text[r.doc_id][r.first_word:r.end_word], text[r.source_id][r.source_first_word:r.source_end_word]
        assert r.source_id == r.doc_id - 1 and min(len(a), len(b)) >= 40
        assert abs(r.similarity - passages._common(a, b) / max(len(a), len(b))) < 1e-9 and r.similarity > 0.8 - 1e-9
    found = {r.doc_id // 2 for r in got}
    assert all(sum(i in found for i in range(k, 250, 5)) >= 48 for k in range(5))


def test_passage_repeated_inside_one_document(spark):
    rnd = random.Random(13)
    words = lambda n: [f"w{rnd.randrange(10 ** 7)}" for _ in range(n)]
    p = words(60)
    rows = [(1, words(30) + p + words(300) + p + words(200) + p + words(10)), (2, words(40) + p + words(5)), (3, words(200))]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows + rows[:1]], "doc_id long, text string")
    assert {tuple(r)[:6] for r in passages.repeated_passages(df).collect()} == {
        (1, 390, 450, 1, 30, 90), (1, 650, 710, 1, 390, 450), (2, 40, 100, 1, 30, 90)}


def test_short_periods_are_one_passage(spark):
    rnd = random.Random(17)
    cycle = [f"c{rnd.randrange(10 ** 7)}" for _ in range(30)]
    rows = [(1, "word " * 5000), (2, "a b " * 3000), (3, " ".join(cycle * 60)), (4, "word " * 4000), (5, " ".join(cycle[7:] + cycle * 50))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) <= 20
    for i, n in ((1, 4990), (2, 5980), (3, 1730), (4, 3990), (5, 1440)):
        hit = set()
        for r in got:
            if r.doc_id == i:
                hit.update(range(r.first_word, r.end_word))
        assert len(hit) >= n, (i, len(hit))


def test_passage_whose_runs_of_seeds_earlier_documents_hold(spark):
    rnd = random.Random(19)
    words = lambda n: [f"w{rnd.randrange(10 ** 7)}" for _ in range(n)]
    rows, want = [], set()
    for i in range(6):
        size, d = (40, 45, 60, 80, 100, 120)[i], 50 * i
        p = words(size)
        # Every run of four seeds stands in an earlier document with 30 words of the passage.
        rows += [(d + k, words(50) + p[lo:lo + 30] + words(50)) for k, lo in enumerate(range(0, size - 29, 2 if size == 40 else 5))]
        rows += [(d + 48, words(70) + p + words(30)), (d + 49, words(20) + p + words(90))]
        want.add((d + 49, 20, 20 + size, d + 48, 70, 70 + size))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    assert {tuple(r)[:6] for r in passages.repeated_passages(df).collect()} == want


def test_passage_that_begins_in_a_short_period(spark):
    rnd = random.Random(23)
    rows = []
    for i in range(12):
        p = ["so"] * 20 + [f"w{rnd.randrange(10 ** 7)}" for _ in range(20)]
        rows += [(9 * i, p[:20] * (1 + i % 3) + ["x"] * 60), (9 * i + 1, p[22:] + [f"y{i}" for i in range(60)]),
                 (9 * i + 2, p[11:33] + [f"z{i}" for i in range(60)]),
                 (9 * i + 3, ["so"] * i + p), (9 * i + 4, ["so"] * (i * 5 % 13) + p)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    words, hit = {d: w for d, w in rows}, {d: set() for d, _ in rows}
    for r in passages.repeated_passages(df).collect():
        hit[r.doc_id].update(range(r.first_word, r.end_word))
    for i in range(12):
        n = len(words[9 * i + 4])
        assert hit[9 * i + 4].issuperset(range(n - 40, n)), i


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_passages_of_a_table_against_all_pairs(spark):
    """Every word of an equal run of 40 words or more with an earlier place (that is not
    the same text less than a seed window before), found by comparing everything with
    everything, is covered; and every passage is one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    words = {r.doc_id: decontaminate.words_of(r.text) for r in docs.collect()}
    got = passages.repeated_passages(docs).collect()
    hit = {i: set() for i in words}
    for r in got:
        a, b = words[r.doc_id][r.first_word:r.end_word], words[r.source_id][r.source_first_word:r.source_end_word]
        assert min(len(a), len(b)) >= 40 and (r.source_id, r.source_first_word) < (r.doc_id, r.first_word)
        assert abs(r.similarity - passages._common(a, b) / max(len(a), len(b))) < 1e-9 and r.similarity >= 0.8 - 1e-9
        hit[r.doc_id].update(range(r.first_word, r.end_word))
    seen, due = {}, 0
    for i in sorted(words):
        for k in range(len(words[i]) - 39):
            run = tuple(words[i][k:k + 40])
            first = seen.setdefault(run, (i, k))
            if first[0] < i or k - first[1] >= passages.WINDOW:
                due += 1
                assert hit[i].issuperset(range(k, k + 40)), (i, k)
    assert due > 1000


def test_words_around_chains_are_written_once(spark, monkeypatch):
    rnd = random.Random(29)
    p = prose(rnd, 90)
    rows = [(i, " ".join(prose(rnd, 60) + p + prose(rnd, 60))) for i in range(9)]
    tables, keep = {}, passages.written

    def spy(df, name):
        out = keep(df, name)
        kinds = {k for _, k in out.dtypes}
        ranges = out.select("src", "src_tag", "y0", "y1").distinct().count() if name == "chains" else 0
        tables.setdefault(name, []).append((out.count(), "binary" in kinds, ranges))
        return out

    monkeypatch.setattr(passages, "written", spy)
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(1, 9))
    assert "seeds" not in tables  # a row for every seed: they go to their tasks at once
    chains = tables["chains"]
    assert sum(n for n, _, _ in chains) >= 8
    # A row for each chain and one for each range of a source.
    assert sum(n for v in tables.values() for n, words, _ in v if words) == sum(n + ranges for n, _, ranges in chains)


def test_seeds_of_a_batch_are_those_of_its_texts():
    rnd = random.Random(31)
    sizes = [rnd.choice([0, 3, 5, 6, 11, 12, 13, 20, 45, 200]) for _ in range(120)]
    texts = [" ".join(f"w{rnd.randrange(10 ** 9)}" for _ in range(n)) if n else rnd.choice([None, ""]) for n in sizes]
    of, h, at, _ = passages.seeds_of(texts)
    for i, t in enumerate(texts):
        _, every, place, _ = passages.seeds_of([t], window=1)
        every = every.tolist()
        assert place.tolist() == list(range(len(every)))
        least = {min(range(k, min(k + passages.WINDOW, len(every))), key=every.__getitem__)
                 for k in range(max(len(every) - passages.WINDOW + 1, 1)) if every}
        assert sorted(zip(at[of == i].tolist(), h[of == i].tolist())) == [(k, every[k]) for k in sorted(least)]


def test_steps_and_ends_against_common_subsequences():
    rnd = random.Random(37)
    for _ in range(300):
        a, b = ([rnd.choice("abcdef") for _ in range(rnd.randint(0, 12))] for _ in "ab")
        assert passages._prefixes(a, b) == [passages._common(a[:n], b[:n]) for n in range(min(len(a), len(b)) + 1)]
        best = passages._common(a, b)
        i = min(n for n in range(len(a) + 1) if passages._common(a[:n], b) == best)
        j = min(n for n in range(len(b) + 1) if passages._common(a[:i], b[:n]) == best)
        assert passages._end(a, b) == (i, j)
        both = sum(min(a.count(w), b.count(w)) for w in set(a))
        assert [passages.hopeless(a, b, n) for n in range(1, 13)] == [both < n for n in range(1, 13)]


def test_fingerprints_of_one_anchor_are_compared_in_small_pieces():
    import numpy as np
    import pandas as pd
    from vitalis.llm import simhash
    assert simhash.CHUNK_PAIRS <= 1 << 18  # six tasks share an executor
    fp = np.unique(np.int64(1) << np.arange(40) | np.int64(1))
    fp = np.unique((fp[:, None] | fp[None, :]).ravel())  # some 800 within four bits of each other
    rows = pd.DataFrame({"key": np.zeros(len(fp), np.int64), "home": True, "fp": fp})
    edges = pd.concat(list(simhash._compare(4)(iter([rows]))))
    assert len(edges) == len(fp) - 1
