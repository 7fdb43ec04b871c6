"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, language_id, line_dedup, minhash, packing, token_counts, topk, warc
from .common import materialise, shared_path, table

#: Planted conversation: its texts contain another template's control strings.
PROBE_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archives back, assemble the captures, and answer from their nested records.

    The page's id comes from a capture's metadata record, its address from the request.
    """
    path = shared_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = materialise(warc.read_records(spark, path, content=False).drop("content"), "records")
    captures = warc.resolve_revisits(materialise(warc.assemble(records), "captures"))
    return captures.select(
        F.col("page_key").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("main.record_type").alias("record_type"), F.col("refers_key").cast("long").alias("refers_to"),
        F.get("requests", F.lit(0))["target_uri"].alias("url"), (1 + F.size("requests") + F.size("metadata")).cast("long").alias("n_records"),
    )


OP1_SQL = r"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, url, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
  regexp_replace(coalesce(url, 'about:blank'), '[\x00-\x20\x7F]', '%20', 'g') AS url, CAST(3 AS BIGINT) AS n_records
FROM f
"""


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and the planted one, write them, read them back and digest what they say."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat.digest_formatted(materialise(chat.format_conversations(turns.unionByName(probe)), "formatted"))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
e AS (
  SELECT *, regexp_replace(text, '\\|<\|turn\|>|<\|text\|>|<\|over\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>', '\0+', 'g') AS longer FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(coalesce(length(role), 2) + length(longer) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 3-word shingles and a similarity of 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents to token files, then count each one's tokens from the files."""
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"), shared_path(spark, "tokens"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents' tokens into sequences of 512 to 4096."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from a bounded sample of the labelled documents that aren't held out; predict all."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.LanguageModel.train(language_id.training_sample(docs))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best matches of every fiftieth vector among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id AND len(a.q) = len(b.q)
),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete from every document the passages that an earlier one has; digest what is left."""
    out = line_dedup.delete_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, digest both."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group all documents by equal text."""
    return exact_dedup.annotate(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def queries():
    return {
        "op1_warc": op1_warc, "op2_chat": op2_chat, "op3_minhash": op3_minhash, "op4_token_counts": op4_token_counts, "op5_packing": op5_packing,
        "op6_language_id": op6_language_id, "op7_bpe": op7_bpe, "op8_topk": op8_topk, "op9_line_dedup": op9_line_dedup, "op10_exact_dedup": op10_exact_dedup,
    }


def oracle_sql():
    return {"op1_warc": OP1_SQL, "op2_chat": OP2_SQL, "op8_topk": OP8_SQL, "op10_exact_dedup": OP10_SQL}
