"""The registered queries of this package and their DuckDB SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ..sources.tables import read_table
from . import (centroids, conversations, decontaminate, embeddings, langid, licenses, mixing, passages, pii, simhash,
               token_counts, token_shards, warc)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    items = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return decontaminate.contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return mixing.mix_plan(docs).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    # One value per document before the digests, so that the patterns run once.
    found = pii.find_pii(docs)
    base, every = ([F.col(f"pii_{k}") for k in kinds] for kinds in (pii.BASE, pii.BASE | pii.ADDED))
    return found.select("doc_id", *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in pii.BASE],
                        F.sha2(pii.joined(*base), 256).alias("base_sha256"), pii.joined(*every).alias("spans"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_output(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    return langid.identify(docs, langid.fit(docs)).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return simhash.near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))[0]


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return conversations.repair(conversations.damaged(rows)).report.withColumnRenamed("sha", "repaired_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_substring_dedup, op2_benchmark_decontamination, op3_source_mixing, op4_pii, op5_warc, op6_token_ids,
    op7_embedding_near_dedup, op8_token_counts, op9_language_id, op10_simhash_near_dedup,
    op11_license_scan, op12_centroid_clustering, op13_conversation_repair)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLE: dict[str, str] = {}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL

ORACLE["op2_benchmark_decontamination"] = r"""
WITH dw AS (
  SELECT rowid AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS rowid, doc_id, coalesce(text, '') AS text FROM documents)),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + 9], ' ') AS s
  FROM bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
grams AS (
  SELECT r, ks.k, i, array_to_string(w[i : i + ks.k - 1], ' ') AS s
  FROM dw, ks, unnest(range(1, len(w) - ks.k + 2)) AS t(i) WHERE len(w) >= ks.k),
hits AS (SELECT r, g.k, i, item_id FROM grams g JOIN win USING (k, s)),
hitw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items,
              string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hitw USING (r) LEFT JOIN it USING (r)
"""

ORACLE["op3_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             ([3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
      FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
          / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
f AS (SELECT *, (SELECT arg_min(level, place) FROM l WHERE level * weight <= cap) AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM f),
p AS (SELECT d.*, t.source_size, t.target, row_number() OVER () AS r,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, doc_id, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT r, shuffle, doc_id, size, CASE WHEN target > 0 THEN (upto + k.k * source_size) / target
                                            WHEN k.k = 0 THEN 0.0 END AS finish
      FROM p, (VALUES (0), (1)) AS k(k)),
o AS (SELECT r, size, sum(size) OVER (ORDER BY finish, shuffle, doc_id NULLS FIRST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM k WHERE finish IS NOT NULL),
x AS (SELECT r, sum(size) AS taken FROM o WHERE spent <= (SELECT round(sum(target)) FROM t) GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM p LEFT JOIN x USING (r)
"""

ORACLE["op5_warc"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM q
"""


ORACLE["op7_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
      WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)
        AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
      WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.norm * b.norm) >= 0.93),
c AS (SELECT r AS a, r AS b FROM v UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
m AS (SELECT c.a, min(v.vec_id) AS low FROM c JOIN v ON v.r = c.b GROUP BY c.a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, low AS component_id, coalesce(vec_id = low, false) AS kept
FROM v JOIN m ON m.a = v.r LEFT JOIN n ON n.a = v.r
"""


def _centroid_sql(rounds: int = centroids.ROUNDS) -> str:
    """The rounds are written out one after the other."""
    assign = """
a{r} AS (SELECT p.r, arg_min(c.j, {{'d': list_sum(list_transform(list_zip(p.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'j': c.j}}) AS j,
        min(list_sum(list_transform(list_zip(p.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
      FROM p, c{r} c GROUP BY p.r)"""
    update = """,
s{r} AS (SELECT j, k, sum(x) AS s, count(*) AS n FROM (SELECT a.j, unnest(p.v) AS x, unnest(range(64)) AS k FROM a{r} a JOIN p USING (r)) GROUP BY j, k),
m{r} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS HUGEINT) ORDER BY k) AS c FROM s{r} GROUP BY j),
c{n} AS (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m USING (j)),"""
    return ("""
WITH p AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
           FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS j, v AS c FROM p ORDER BY j LIMIT 16),"""
            + "".join(assign.format(r=r) + update.format(r=r, n=r + 1) for r in range(rounds)) + assign.format(r=rounds) + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN p USING (r) JOIN c{rounds} USING (j)
""")


ORACLE["op12_centroid_clustering"] = _centroid_sql()


def _repair_sql() -> str:
    """One recursion step a message; a state holds its best (cost, audit, text)."""
    # CRC-32 as a reduction: each byte is taken in, then eight shifts.
    crc = ("xor(list_reduce(flatten(list_transform(range(1, strlen(key) + 1), lambda i: [CAST(1000 + ('0x' || hex(encode(key))[2 * i - 1 : 2 * i])::BIGINT AS BIGINT), "
           "1, 1, 1, 1, 1, 1, 1, 1])), lambda c, b: CASE WHEN b >= 1000 THEN xor(c, b - 1000) "
           "ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT), 4294967295)")
    ins = lambda s, role: f"{{'c': {s}.c + 5, 'a': {s}.a || 'I', 't': {s}.t || '{role}:' || chr(10)}}"
    never = "{'c': 1000000000000::BIGINT, 'a': '', 't': ''}"
    # After a message: nothing yet, after system, after user, after assistant.
    plain = ("SELECT {key}, list_min([{d0}]) AS s0, list_min([{d1}]) AS s1, list_min([{d2}]) AS s2, list_min([{d3}]) AS s3 {rest}")
    drop = lambda s: f"{{'c': {s}.c + 2, 'a': {s}.a || 'D', 't': {s}.t}}"
    more = "CASE fault WHEN 'truncated' THEN 5 ELSE 0 END"
    keep = lambda s, i: (f"CASE WHEN NOT gone AND left(role, 1) = '{i}' THEN {{'c': {s}.c + {more}, 'a': {s}.a || 'K', "  # noqa: E731
                         f"'t': {s}.t || role || ':' || text || chr(10)}} ELSE {never} END")
    turn = lambda s, r: (f"CASE WHEN NOT gone THEN {{'c': {s}.c + 1 + {more}, 'a': {s}.a || 'R', "  # noqa: E731
                         f"'t': {s}.t || '{r}:' || text || chr(10)}} ELSE {never} END")
    step = plain.format(key="l.conv_id, l.i + 1 AS i, l.c", rest="FROM l JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i + 1",
                        d0=drop("q0"), d1=f"{drop('q1')}, {keep('q0', 's')}",
                        d2=", ".join([drop("q2"), *[keep(s, "u") for s in ("q0", "q1", "q3")], *[turn(s, "user") for s in ("q0", "q1", "q3")]]),
                        d3=", ".join([drop("q3"), keep("q2", "a"), turn("q2", "assistant")]))

    def closed(source: str) -> str:
        """Two inserts at most follow a message."""
        one = (f"SELECT conv_id, i, c, s0, s1, list_min([s2, {ins('s0', 'user')}, {ins('s1', 'user')}, {ins('s3', 'user')}]) AS s2, s3, s2 AS o2 FROM ({source})")
        return f"SELECT conv_id, i, c, s0 AS q0, s1 AS q1, s2 AS q2, list_min([s3, {ins('s2', 'assistant')}]) AS q3 FROM ({one})"

    begin = f"SELECT conv_id, 0::BIGINT AS i, 0 AS c, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, {never} AS s1, {never} AS s2, {never} AS s3 FROM ids"
    return rf"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations),
d AS (SELECT *, {crc} % 20 AS fault FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations)),
e AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN ''
             WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy FROM d WHERE fault <> 0),
n AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
             left(lag(role) OVER w, 1) AS before, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM e
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy)),
f AS (SELECT *, fault IN ('blank', 'duplicate') AS gone FROM (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
             WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n)),
l AS ({closed(begin)} UNION ALL {closed(step)}),
g AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
b AS (SELECT l.conv_id, list_min([q0, q3]) AS best FROM l LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM l.conv_id
      WHERE l.i = coalesce(g.n, 0))
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
       sha256(best.t[1 : length(best.t) - 1]) AS repaired_sha256
FROM b LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id
"""


ORACLE["op13_conversation_repair"] = _repair_sql()
