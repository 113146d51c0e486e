"""The ten operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, mixing, packing, secrets, simhash, token_counts, topk, toxicity, urls
from .common import table

PIECES, WORD_BPE = "piece_bpe_32k.model", "word_bpe_49k.json"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    all_ = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.format_conversations(spark, all_).mapInArrow(chat.read_back, chat.DIGEST)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(spark, table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(spark, table(spark, sf_dir, "documents")).drop("_row")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), tokenizer_file(WORD_BPE))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark, table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spark, table(spark, sf_dir, "documents"), token_counts.load_pieces(tokenizer_file(PIECES)))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_topk, op3_chat, op4_toxicity, op5_secrets, op6_exact_dedup, op7_packing, op8_mixing, op9_urls, op10_token_counts)}

_GUARD = r"replace(replace(replace(replace(replace({0}, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"

ORACLE = {
    "op2_topk": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op3_chat": rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_GUARD.format("role")}) + length({_GUARD.format("text")}) + 20) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op6_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
    row_number() OVER () AS n FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, n)""",
    "op8_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST(('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE)
    / CASE WHEN text = '' THEN 1.0::DOUBLE ELSE greatest(0.05::DOUBLE, length(translate(text, '0123456789#$%&*+<>=@[]^_{|}~', ''))::DOUBLE / length(text)) END AS key
  FROM d
), sizes AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS s, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM sized GROUP BY source
), lvl(lev, n) AS (
  SELECT sum(s) / sum(w), CAST(-1 AS BIGINT) FROM sizes
  UNION ALL
  SELECT lev, n FROM (
    SELECT ((SELECT sum(s) FROM sizes) - coalesce((SELECT sum(s * 3) FROM sizes WHERE s * 3 <= w * lvl.lev), 0))
        / (SELECT sum(w) FROM sizes WHERE s * 3 > w * lvl.lev) AS lev,
      (SELECT count(*) FROM sizes WHERE s * 3 <= w * lvl.lev) AS n, lvl.n AS before
    FROM lvl) x WHERE n <> before AND lev IS NOT NULL
), t AS (
  SELECT source, s, least(s * 3.0::DOUBLE, w * (SELECT lev FROM lvl ORDER BY n DESC LIMIT 1)) AS target FROM sizes
), e AS (
  SELECT *, CASE WHEN s = 0 THEN 0 ELSE floor(target / s) END AS epochs FROM t
), o AS (
  SELECT z.doc_id, z.size, e.s, e.target, e.epochs, e.target - e.epochs * e.s AS part,
    sum(z.size) OVER (PARTITION BY z.source, z.key, z.doc_id) AS tie,
    sum(z.size) OVER (PARTITION BY z.source ORDER BY z.key, z.doc_id NULLS LAST) AS upto
  FROM sized z JOIN e ON z.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target,
  CAST(epochs * size + CASE WHEN upto <= part THEN size WHEN upto - tie > part THEN 0 ELSE floor(size * ((part - (upto - tie)) / tie)) END AS BIGINT) AS taken
FROM o""",
}
