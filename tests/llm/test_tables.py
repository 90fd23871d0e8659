"""WARC, vectors, registered queries and the pipeline."""
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from vitalis.llm import embeddings, langid, queries, simhash, tokens, warc

SF = "/root/testdata/sf0.001"


# -- WARC ---------------------------------------------------------------------

def test_warc(spark, tmp_path):
    big, other = "<p>é\r\n\r\n" + "x" * 1200, "y" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2\nz%", big), (3, None, big), (4, "u", other), (5, "u", "small"),
            (6, "u", "small"), (7, "u", None), (8, "u", ""), (None, "n", big), (None, "n", "z" * 1500), (9, "w", "z" * 1500),
            (9, "w", "z" * 1500)]
    pages = spark.createDataFrame([(*r, 5, "clash") for r in rows], "page_id long, url string, html string, offset int, path string")
    index = warc.write_archives(pages.repartition(3), str(tmp_path / "w"))
    got = warc.read_records(index).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert [(by[i][0].record_type, by[i][0].refers_to) for i in (1, 2, 3)] == [("revisit", 3), ("revisit", 3), ("response", None)]
    assert all(by[i][0].record_type == "response" for i in (4, 5, 6, 7, 8)) and [r.record_type for r in by[9]] == ["response"] * 2
    assert {(r.record_type, r.refers_to) for r in by[None]} == {("revisit", 3), ("revisit", 9)}
    html = {r[0]: (r[2] or "").encode() for r in rows if r[0]}
    url = {r[0]: r[1] for r in rows}
    for r in got:
        if r.page_id is not None:
            assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == hashlib.sha1(html[r.page_id]).hexdigest()
            assert r.url == url[r.page_id]
            assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html[r.page_id]
    some = warc.read_records(index.where("page_id in (2, 7)"), payloads=False).collect()
    assert sorted(r.page_id for r in some) == [2, 7]
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_ranges_join_neighbours():
    got = list(warc.ranges(["a", "a", "a", "b"], [0, 10, 500, 0], [10, 10, 10, 5], max_gap=100, max_read=1000))
    assert got == [(0, 2, "a", 0, 20), (2, 3, "a", 500, 510), (3, 4, "b", 0, 5)]


# -- vectors ------------------------------------------------------------------

def brute_vectors(rows):
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            (a, u, p), (b, v, q) = rows[i], rows[j]
            if p is not None and p == q and ok(u) and ok(v) and len(u) == len(v):
                x, y = np.array(u, np.float32).astype(float), np.array(v, np.float32).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[i].append(j)
                    links[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), low, rows[i][0] is not None and rows[i][0] == low))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [2048, 7])
def test_near_vectors(spark, tile):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 40))
    rows = []
    for i in range(160):
        v = base[rng.integers(12)] + rng.normal(size=40) * rng.choice([0.0, 0.05, 0.25, 0.4])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    rows += [(160 + k, rows[5][1], rows[5][2]) for k in range(9)] + [(rows[7])] * 2
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 40, 1), (203, [None] + [1.0] * 39, 1), (204, [math.nan] * 40, 1),
             (205, [math.inf] + [0.0] * 39, 1), (206, rows[5][1], None), (None, rows[5][1], rows[5][2]),
             (207, rows[5][1][:5], rows[5][2]), (208, rows[5][1][:5], rows[5][2])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "vec_id long, embedding array<float>, label int, copies int, cls string").repartition(5)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df, tile=tile).collect()), key=str)
    assert got == brute_vectors(rows)


def test_no_vectors(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# -- queries and pipeline -----------------------------------------------------

def test_registered():
    names = E.queries()
    assert {q.split("_")[0] for q in names if re.match(r"op\d+_", q)} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in queries.op9_language_id(spark, SF).collect() if r.held_out]
    assert len(got) > 40 and np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.97


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_pipeline_against_plain_python(spark):
    """Each stage on its predecessor's documents, and the last stage's ids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    one = steps["language_id"](spark, docs, SF).collect()
    model = langid.fit(docs)
    lang, _, rate = model.predict([r.text for r in docs.collect()])
    want = [r.doc_id for r, a, b in zip(docs.collect(), lang, rate) if a != "und" and b <= langid.MAX_PHRASE_RATE]
    assert sorted(r.doc_id for r in one) == sorted(want) and list(one[0].asDict()) == cols

    two = steps["simhash_near_dedup"](spark, spark.createDataFrame(one, docs.schema), SF).collect()
    fps = {r.doc_id: simhash.fingerprint(r.text, 4) for r in one}
    seen, want = set(), []
    for i in sorted(fps):
        if i not in seen:
            want.append(i)
            todo = [i]
            while todo:
                a = todo.pop()
                near = [j for j in fps if j not in seen and (fps[a] ^ fps[j]).bit_count() <= 4]
                seen.update(near)
                todo += near
    assert sorted(r.doc_id for r in two) == want and list(two[0].asDict()) == cols

    three = steps["benchmark_decontamination"](spark, spark.createDataFrame(two, docs.schema), SF).collect()
    hit = {r.doc_id for r in queries.op2_benchmark_decontamination(spark, SF).collect() if r.contaminated}
    assert sorted(r.doc_id for r in three) == sorted(i for i in want if i not in hit)

    four = steps["source_mixing"](spark, spark.createDataFrame(three, docs.schema), SF).collect()
    count = {}
    for r in four:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert set(count.values()) <= {1, 2} and set(count) <= {r.doc_id for r in three} and list(four[0].asDict()) == cols
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert abs(sum(size(r.text) for r in four) - 1.5 * sum(size(r.text) for r in three)) <= max(size(r.text) for r in three)

    five = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r.start)
    enc = Tokenizer.from_file(tokens.default_vocabulary())
    assert [r.doc_id for r in five] == sorted(r.doc_id for r in four)
    text, at = {r.doc_id: r.text for r in three}, 0
    for r in five:
        ids = enc.encode(text[r.doc_id], add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += r.n_tokens
