"""The text operators' queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, conversations, decontam, exact, html, langid, lines, ngrams, paragraphs, passages, pieces, simhash, topk, toxicity
from .common import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo n; -1 for null, so that a row without id is learned from and not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(-1))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = langid.learn(docs.where(remainder(3) != 1).select("text", "lang"))
    return langid.predict(docs.select("doc_id", "text"), filters).select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.learn(docs, table(spark, sf_dir, "labels").where(remainder(5) != 0))
    return toxicity.score(docs.select("doc_id", "text"), index).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted", "evidence")


def op5_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ngrams.train(docs.where(remainder(5) != 1), least=1)
    return ngrams.score(docs, model).select("doc_id", (remainder(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text to its n best segmentations, decodes the best again and keeps a digest: counts, scores, and hashes of the ids of the best and of all."""
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), all_ids=True)
    back = pieces.decode(coded)
    return back.select("doc_id", "n_pieces", "piece_score", "nbest_scores", F.xxhash64("ids").alias("ids_hash"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same_text"), F.size("nbest_ids").alias("n_best"), F.xxhash64("nbest_ids").alias("nbest_hash"))


def op7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of 50 words or more that occur again, alike or nearly, and passages of about 50 that differing paragraphs share."""
    docs = table(spark, sf_dir, "documents")
    whole = paragraphs.repeated(docs, min_words=50).select("doc_id", F.lit("paragraph").alias("kind"), F.col("paragraph").alias("place"), "n_words", "class_doc_id", F.col("class_paragraph").alias("class_place"), "n_class", "removed")
    parts = passages.repeated(docs).select("doc_id", F.lit("passage").alias("kind"), F.col("start").cast("long").alias("place"), F.col("n_words").cast("long").alias("n_words"), "class_doc_id", F.col("class_start").cast("long").alias("class_place"), "n_class", "removed")
    return whole.unionByName(parts)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated(table(spark, sf_dir, "documents"), short_copies=True).drop("row")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


def damaged(turns: DataFrame) -> DataFrame:
    """conversations after the damage that the check sum of `conv_id:turn` names; nulls of any column count as one space there, in role and in text."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    rows = turns.where(hit != 0).select("conv_id", "turn", F.when(hit == 4, F.lit("user")).otherwise(spaced("role")).alias("role"), text.alias("text"), F.explode(F.when(hit == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.drop("copy")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    bad = damaged(turns)
    plans = stored(conversations.audits(bad), "conversations")
    every = turns.select("conv_id").distinct()
    whole = conversations.digests(bad, plans).withColumnRenamed("conv", "id")
    found = every.join(plans, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(whole, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(name) for c, name in (("gap", "gaps"), *((c, c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")))]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = exact.ExactIndex(spark, exact.buckets_for(docs))
    index.insert(docs)
    return index.groups().select(F.col("doc").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters, marks = list("ABCDE"), ["good", "toxic"]
    rows = audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit.orders(audit.edges(rows, filters, marks), filters, marks)


QUERIES = {"op1_langid": op1_langid, "op4_decontam": op4_decontam, "op2_toxicity": op2_toxicity, "op3_topk": op3_topk, "op5_ngrams": op5_ngrams, "op6_pieces": op6_pieces, "op7_paragraphs": op7_paragraphs, "op8_lines": op8_lines, "op9_simhash": op9_simhash, "op10_html": op10_html, "op11_conversations": op11_conversations, "op12_exact": op12_exact, "op13_audit": op13_audit}

_SHINGLES = r"""
SELECT {key} AS id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s, len(w) AS n
FROM (SELECT {key}, regexp_extract_all(lower(text), '[0-9a-z_\x{{80}}-\x{{10FFFF}}]+') AS w FROM {table}) WHERE len(w) > 0"""

_CRC = """
list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({key}, ''), lambda x: ord(x)::BIGINT)),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))"""
_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"

# Carries the repaired turns along with the cost and the edits; grammar states are nothing (0), system (1), user (2), assistant (3).
_REPAIR = r"""
WITH RECURSIVE crc AS (SELECT __TABLE__ AS tab),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(__CRC__, 4294967295) % 20 AS hit FROM conversations, crc),
d AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h JOIN (VALUES (1), (2)) copies(n) ON n = 1 OR hit = 3 WHERE hit <> 0),
n AS (
  SELECT *, row_number() OVER w AS k, substr(role, 1, 1) AS ini, lag(substr(role, 1, 1)) OVER w AS prev
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (
  SELECT conv_id, turn, k, role, text, ini, prev, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
           WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd'
           WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault
  FROM n),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size
  FROM f GROUP BY conv_id),
ins(s, t, e, said) AS (VALUES (0, 0, '', []::VARCHAR[]), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (3, 2, 'I', ['user:']),
  (2, 3, 'I', ['assistant:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:'])),
edits(s, t, e, ini, price, role) AS (VALUES (0, 1, 'K', 's', 0, NULL), (0, 2, 'K', 'u', 0, NULL), (1, 2, 'K', 'u', 0, NULL), (3, 2, 'K', 'u', 0, NULL), (2, 3, 'K', 'a', 0, NULL),
  (0, 2, 'R', NULL, 3, 'user'), (1, 2, 'R', NULL, 3, 'user'), (3, 2, 'R', NULL, 3, 'user'), (2, 3, 'R', NULL, 3, 'assistant'),
  (0, 0, 'D', NULL, 4, NULL), (1, 1, 'D', NULL, 4, NULL), (2, 2, 'D', NULL, 4, NULL), (3, 3, 'D', NULL, 4, NULL)),
p AS (
  SELECT g.conv_id, 0::BIGINT AS k, ins.t AS s, {'c': (3 * length(ins.e))::BIGINT, 'a': ins.e, 'said': ins.said} AS b FROM g, ins WHERE ins.s = 0
  UNION ALL
  SELECT f.conv_id, f.k, ins.t, min({'c': (p.b.c + x.price + CASE WHEN f.fault = 't' AND x.e <> 'D' THEN 3 ELSE 0 END + 3 * length(ins.e))::BIGINT, 'a': p.b.a || x.e || ins.e,
    'said': list_concat(p.b.said, CASE WHEN x.e = 'D' THEN []::VARCHAR[] ELSE [coalesce(x.role, f.role) || ':' || f.text] END, ins.said)})
  FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.k = p.k + 1
  JOIN edits x ON x.s = p.s AND (x.e = 'D' OR f.fault NOT IN ('b', 'd')) AND (x.ini IS NULL OR x.ini = f.ini)
  JOIN ins ON ins.s = x.t
  GROUP BY f.conv_id, f.k, ins.t),
done AS (SELECT p.conv_id, min(p.b) AS b FROM p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.size = p.k WHERE p.s IN (0, 3) GROUP BY p.conv_id)
SELECT o.conv_id, coalesce(g.gaps, 0) AS gaps, coalesce(g.blank, 0) AS blank, coalesce(g.duplicate, 0) AS duplicate, coalesce(g.truncated, 0) AS truncated,
  coalesce(g.illegal, 0) AS illegal, coalesce(done.b.c, 0) AS cost, coalesce(done.b.a, '') AS audit, sha256(coalesce(array_to_string(done.b.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id
""".replace("__TABLE__", _CRC_TABLE).replace("__CRC__", _CRC.format(key="concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))"))

ORACLES = {
    "op12_exact": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d""",
    "op13_audit": r"""
WITH RECURSIVE o AS (SELECT '' AS s UNION ALL SELECT s || f FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(s, f)),
w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         coalesce(min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id, false) AS e
  FROM documents),
d AS (
  SELECT part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic
  FROM w),
h AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY part, fails),
steps AS (SELECT s AS filter_order, k::INTEGER AS step, s[k:k] AS f, s[1:k - 1] AS earlier FROM o, range(1, 6) r(k) WHERE length(s) = 5),
r AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN translate(fails, earlier || f, '') = fails THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN translate(fails, earlier, '') = fails AND contains(fails, f) THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN translate(fails, earlier, '') <> fails AND contains(fails, f) THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN translate(fails, earlier, '') = fails AND contains(fails, f) THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN translate(fails, earlier, '') = fails AND contains(fails, f) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM h, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM r""",
    "op11_conversations": _REPAIR,
    "op4_decontam": f"""
WITH d AS (SELECT DISTINCT id, s FROM ({_SHINGLES.format(key="doc_id", table="documents")})),
i AS (SELECT DISTINCT id, s FROM ({_SHINGLES.format(key="item_id", table="benchmark")})),
n AS (SELECT id, count(*) AS n FROM i GROUP BY id),
p AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_found FROM d JOIN i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, n_found, n_found / CAST(n AS DOUBLE) AS containment
FROM p JOIN n ON n.id = p.item_id WHERE n_found >= 0.8 * n - 1e-9""",
    "op3_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
