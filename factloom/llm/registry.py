"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import decontamination, exact_dedup, merkle, packing, phrases, pieces, pii, sharding, simhash, tokens, toxicity, url_filter, warc
from factloom.session import table

SHARDS = 40
TOKEN_LIMIT = 1024


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces_of(table(spark, sf_dir, "documents"), tokens.vocabulary())
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.document_columns(table(spark, sf_dir, "documents"))
    return sharding.shard_rows(rows, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.group_documents(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.digest_columns(decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.count_tokens(docs, tokens.vocabulary())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "severity", "p_toxic", "grade", "toxic")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest_columns(pii.find_pii(docs))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    return merkle.digest_columns(merkle.prove(merkle.document_leaves(table(spark, sf_dir, "documents"), tampered)))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(docs, tokens.vocabulary("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


OP4_SQL = """
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS place,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM keyed
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked"""


OP6_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, words FROM (SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents)
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(words), 10) AS n, array_to_string(words[i : i + 9], ' ') AS w
  FROM (SELECT item, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM items WHERE len(words) > 0)
), placed AS (
  SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i, len(words) AS size FROM docs
), lengths AS (
  SELECT DISTINCT n FROM windows
), runs AS (
  SELECT r, i, size, word, """ + ", ".join(f"lead(word, {k}) OVER o AS w{k}" for k in range(1, 10)) + r"""
  FROM placed WINDOW o AS (PARTITION BY r ORDER BY i)
), spots AS (
  SELECT r, n, i, concat_ws(' ', word, """ + ", ".join(f"CASE WHEN n > {k} THEN w{k} END" for k in range(1, 10)) + r""") AS w
  FROM runs, lengths WHERE i + n - 1 <= size
), found AS (
  SELECT r, i, s.n, item FROM spots s JOIN windows USING (w)
), hits AS (
  SELECT r, count(DISTINCT word_at) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS word_at FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""

OP9_SQL = """
WITH digests AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY x ORDER BY page_id NULLS LAST) AS place,
    first_value(page_id) OVER (PARTITION BY x ORDER BY page_id NULLS LAST) AS original
  FROM digests
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN original END AS refers_to
FROM ranked"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_packing": op2_packing,
        "op3_sharding": op3_sharding,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_simhash": op5_simhash,
        "op6_decontamination": op6_decontamination,
        "op7_token_counts": op7_token_counts,
        "op8_toxicity": op8_toxicity,
        "op9_warc": op9_warc,
        "op10_pii": op10_pii,
        "op11_merkle": op11_merkle,
        "op12_collocations": op12_collocations,
        "op13_sentencepiece": op13_sentencepiece,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.verdict_sql(), "op4_exact_dedup": OP4_SQL, "op6_decontamination": OP6_SQL, "op9_warc": OP9_SQL, "op11_merkle": merkle.SQL, "op12_collocations": phrases.SQL}
