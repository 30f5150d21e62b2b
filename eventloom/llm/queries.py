"""The queries op1 to op10 over whole tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from eventloom.llm import bpe, chat, exact_dedup, html_extract, langid, licenses, mixing, secret_scan, simhash, vector_topk

SHARE, EPOCHS, SEED = 1.5, 2.0, 17


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix_report(docs, seed=SEED, weights=(3, 1, 2), budget_ratio=SHARE, max_epochs=EPOCHS)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(_table(spark, sf_dir, "documents"), keep="max")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_text(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", "n_chars", "decided.shared", "decided.put_back", "decided.named")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.col("vec_id") % 50 == 0
    return vector_topk.exact_top_k(_table(spark, sf_dir, "embeddings"), asked, k=5, scale=256)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"), shingle=3, index=simhash.EXACT_64)
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("print")[0])), 16, "0").alias("fingerprint"), "component_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(_table(spark, sf_dir, "documents")))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_digest(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_table(spark, sf_dir, "documents"))


def op10_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))
    spans = F.transform("masks", lambda m: F.concat_ws("-", m["start"], m["end"]))
    return rendered.withColumn("masks", F.array_join(spans, ","))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_exact_dedup,
        op3_html_extraction,
        op4_license_scan,
        op5_exact_top_k,
        op6_simhash,
        op7_secret_scan,
        op8_byte_bpe,
        op9_language_id,
        op10_chat_perspectives,
    )
}

_FILL = """
best{n} AS (
  SELECT source, min({{'off': abs(gap - size), 'h': h, 'size': size}}) AS best FROM gaps{last}
  WHERE need > 0 AND NOT extra AND abs(gap - size) < gap GROUP BY source),
gaps{n} AS (
  SELECT g.* REPLACE (g.extra OR coalesce(g.h = b.best.h, false) AS extra, g.gap - coalesce(b.best.size, 0) AS gap)
  FROM gaps{last} g LEFT JOIN best{n} b ON g.source IS NOT DISTINCT FROM b.source)"""
fill_rounds = ",".join(_FILL.format(n=n, last=n - 1) for n in range(1, mixing.FILL_ROUNDS + 1))

_OP1 = f"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
         CAST({EPOCHS} * source_size AS DOUBLE) AS cap, CAST({SHARE} * sum(source_size) OVER () AS DOUBLE) AS budget
  FROM sources),
levels AS (
  SELECT *, cap / weight AS ratio, sum(weight) OVER () AS all_weights,
         coalesce(sum(cap) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM weighted
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
clamped AS (
  SELECT *, ratio <= (budget - cap_before) / (all_weights - weight_before) AS full_up FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN full_up THEN cap ELSE weight * ((budget - sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER ())
              / nullif(sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER (), 0)) END AS target
  FROM clamped),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
ranked AS (
  SELECT s.doc_id, s.size, s.h, s.source, p.source_size, p.target, p.whole,
         p.target - p.whole * p.source_size AS need,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h) AS upto
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
gaps0 AS (
  SELECT *, need > 0 AND upto <= need AS extra,
         need - coalesce(max(CASE WHEN need > 0 AND upto <= need THEN upto END) OVER (PARTITION BY source), 0) AS gap
  FROM ranked),
{fill_rounds}
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM gaps{mixing.FILL_ROUNDS}
"""

_OP2 = """
WITH rows AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content
  FROM documents),
classes AS (
  SELECT content, max(doc_id) AS keep_id, count(*) AS group_size, sha256(content) AS text_sha256 FROM rows GROUP BY content)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM rows JOIN classes USING (content)
"""

_OP5 = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

_OP10 = f"""
WITH said AS (
  SELECT DISTINCT conv_id, turn,
         translate(regexp_replace(coalesce(role, 'unknown'), '<(\\\\*)\\|', '<\\\\\\1|', 'g'), chr(13) || chr(10), '  ') AS role,
         regexp_replace(coalesce(text, ''), '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS text,
         coalesce(CAST(floor(turn / {chat.PIECE}) AS BIGINT), -1) AS piece
  FROM conversations),
parted AS (
  SELECT *, CAST(CASE WHEN count(*) OVER (PARTITION BY conv_id, piece) > {chat.PART_ROWS} THEN
      (row_number() OVER (PARTITION BY conv_id, piece ORDER BY turn NULLS FIRST, role, text) - 1) // {chat.PART_ROWS} ELSE 0 END AS INTEGER) AS part
  FROM said),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> 'system'),
heads AS (
  SELECT s.*, p.speaker,
         '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant'
                                ELSE 'user name=' || role END || chr(10) AS head
  FROM parted s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, length(head) + length(text) + 11 AS n,
         coalesce(sum(length(head) + length(text) + 11) OVER (
           PARTITION BY conv_id, speaker, piece, part ORDER BY turn NULLS FIRST, role, text
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM heads)
SELECT conv_id, speaker, piece, part, CAST(count(*) AS INTEGER) AS n_turns,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text,
       coalesce(string_agg(CASE WHEN role = speaker THEN CAST(begins + length(head) AS VARCHAR) || '-' || CAST(begins + n - 1 AS VARCHAR) END,
                           ',' ORDER BY turn NULLS FIRST, role, text), '') AS masks
FROM placed GROUP BY conv_id, speaker, piece, part
"""

#: Where a query is missing here, SQL can't express it: tests/llm holds it against a brute-force version.
ORACLE_SQL = {
    "op1_mixing": _OP1,
    "op2_exact_dedup": _OP2,
    "op5_exact_top_k": _OP5,
    "op10_chat_perspectives": _OP10,
}
