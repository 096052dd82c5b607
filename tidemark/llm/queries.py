"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    collisions, conversations, decontamination, duplicates, embeddings, language, mixing, quality, ranking, sharding, tokens, toxicity, training, warc,
)
from tidemark.session import scratch_path, through_table

SHARDS = tuple(range(24))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(_table(spark, sf_dir, "documents"))


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch 0 inserts every document under two tokenizer versions, batch 1 takes back later copies of a text, batch 2
    revises word counts where marks stand alone, and a repeat of batch 1 changes nothing."""
    docs = _table(spark, sf_dir, "documents")
    text = F.col("text").cast("string")
    counted = tokens.piece_counts(docs).select(
        "doc_id", "source", "lang", "pieces", mixing.word_count(text).alias("words"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*")), F.lit(0)).cast("long").alias("clean_words"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_hash"))
    counted = through_table(counted, "token-counts")
    first = through_table(counted.where("text_hash is not null").groupBy("text_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
                          .where("n > 1").drop("n"), "first-copies")
    # Rows are judged by their own text, whatever other rows share the id; null texts are no copies of each other.
    counted = counted.join(first, "text_hash", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))
    copies = counted.where("copy")
    rollup = tokens.Rollup(spark, scratch_path(spark, "token-rollup"))
    versions = (("whitespace-1", "words"), ("byte-bpe-50k", "pieces"))
    rollup.commit(0, tokens.inserts(counted, *versions[0]).unionByName(tokens.inserts(counted, *versions[1])))
    gone = tokens.deletes(copies, *versions[0]).unionByName(tokens.deletes(copies, *versions[1]))
    rollup.commit(1, gone)
    rollup.commit(2, tokens.revisions(counted.where("not copy"), "whitespace-1", "words", "clean_words"))
    rollup.commit(1, gone)
    return rollup.totals()


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    field = training.fitted(docs, _table(spark, sf_dir, "labels"), "toxic", toxicity.PER_CLASS, ("text",), toxicity.fit_frame)
    scored = toxicity.tag(docs, field)
    return scored.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    machine = training.fitted(docs, _table(spark, sf_dir, "labels"), "quality", quality.PER_CLASS, ("text", "n_chars"), quality.fit_frame)
    scored = quality.score(docs, machine)
    return scored.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured",
                         "position", "intact")


def op8_near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.near_texts(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs, language.dictionaries(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op10_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return conversations.repaired(conversations.damaged(turns), turns)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {f.__name__: f for f in (op1_near_embeddings, op2_source_mix, op3_token_rollup, op4_toxicity, op5_shards, op6_quality, op7_capture_index,
                                 op8_near_texts, op9_language, op10_contaminated, op11_repaired_conversations, op12_ranked_search, op13_nearest_vectors)}

ORACLE_SQL: dict[str, str] = {
    "op1_near_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e,
         embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
         AND len([x FOR x IN embedding IF x <> 0]) > 0 AS usable
  FROM embeddings),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
    ON a.vec_id <> b.vec_id AND a.usable AND b.usable AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.x = v.vec_id) AS n_links,
       (SELECT min(y) FROM reach r WHERE r.x = v.vec_id) AS component_id,
       v.vec_id = (SELECT min(y) FROM reach r WHERE r.x = v.vec_id) AS kept
FROM v""",
    "op2_source_mix": r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source_key, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (
  SELECT doc_id, no_source, source_key, size,
         -ln(u) / power((length(translate(t, '#%$&*!|<>{}', '')) + 1) / (length(t) + 1), 2) AS key FROM d),
s AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY no_source, source_key) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM (SELECT no_source, source_key, sum(size)::BIGINT AS source_size FROM k GROUP BY no_source, source_key)),
r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER w, 0) AS left_size,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS left_weight
  FROM s WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, no_source, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, cap * left_weight > weight * left_size AS is_open FROM r),
l AS (SELECT left_size, left_weight FROM o WHERE is_open ORDER BY cap / weight, no_source, source_key LIMIT 1),
g AS (
  SELECT no_source, source_key, source_size,
         CASE WHEN is_open THEN weight * (SELECT left_size FROM l) / (SELECT left_weight FROM l) ELSE cap END AS target FROM o),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS n FROM g),
p AS (
  SELECT doc_id, size, source_size, target, n, round(target - n * source_size)::BIGINT
         - coalesce(sum(size) OVER (PARTITION BY no_source, source_key ORDER BY key, doc_id, size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM k JOIN f USING (no_source, source_key))
SELECT doc_id, size, source_size, target, (n * size + least(greatest(room, 0), size))::BIGINT AS taken FROM p""",
    "op7_capture_index": r"""
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host,
         regexp_matches(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://') AS has_host
  FROM pages),
k AS (
  SELECT *, CASE WHEN has_host THEN array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')'
              || coalesce(nullif(string_split(substr(url, length(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')) + 1), '#')[1], ''), '/')
              ELSE coalesce(url, '') END AS urlkey,
         strftime(make_timestamp((1704067200 + page_id % 1000000000) * 1000000), '%Y%m%d%H%M%S') AS captured,
         min(page_id) OVER (PARTITION BY payload_digest) AS first_page
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to,
       urlkey, captured, row_number() OVER (ORDER BY urlkey, captured, page_id) - 1 AS position, true AS intact
FROM k""",
    "op12_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
s AS (SELECT count(*)::BIGINT AS big_n, sum(len(terms))::BIGINT AS big_l FROM d WHERE len(terms) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
o AS (
  SELECT row_id, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT row_id, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY row_id, doc_id, n, term),
w AS (SELECT term, floor(1000.0::DOUBLE * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM o, s GROUP BY term, big_n),
p AS (
  SELECT q.item_id, o.row_id, o.doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM o JOIN w USING (term) JOIN q USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM p WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op13_nearest_vectors": """
WITH v AS (
  SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS score
  FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20""",
}
