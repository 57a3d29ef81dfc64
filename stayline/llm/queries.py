"""One query per operator, over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    byte_bpe,
    conversations,
    nearest,
    ngram_lm,
    packing,
    quality_model,
    quality_rules,
    sharding,
    simhash,
    substrings,
    token_orc,
    warc,
)
from .common import scratch, staged, table

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 1
SEQUENCE = 4096
NEIGHBOURS = 20
SHARDS = 16
SHARD_SEED = 20_240_229


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    token_orc.write(table(spark, sf_dir, "documents"), folder, WORD_VOCABULARY, END_ID)
    return token_orc.digests(spark, folder)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.removed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest.nearest(rows, rows.filter("vec_id % 20 = 0"), NEIGHBOURS)


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.scores(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    found = warc.read(spark, folder, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    sizes = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharding.sharded(sizes, "source", SHARDS, SHARD_SEED).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = staged(packing.pieces(docs, WORD_VOCABULARY, END_ID, SEQUENCE), "pieces")
    return packing.pack(rows, SEQUENCE)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("text", "n_kept_words", "clean_text")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.aligned(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, PIECES, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def op12_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return ngram_lm.scores(table(spark, sf_dir, "documents"), F.crc32(doc_id.cast("binary")) % 7 == 2)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    judged, lines = conversations.repair(conversations.damaged(rows))
    found = judged.join(conversations.digests(lines), "key", "left")
    every = rows.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key")).distinct()
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, "key", "left").select(
        "conv_id",
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in columns),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_orc": op1_token_orc,
    "op2_simhash": op2_simhash,
    "op3_substrings": op3_substrings,
    "op4_nearest": op4_nearest,
    "op5_quality_model": op5_quality_model,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_warc": op7_warc,
    "op8_sharding": op8_sharding,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_alignment": op11_alignment,
    "op12_ngram_lm": op12_ngram_lm,
    "op13_conversations": op13_conversations,
}

#: Every word, window and line of the texts, by unnesting; the patterns are those of quality_rules.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
runs AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS run FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM runs QUALIFY count(*) OVER (PARTITION BY r, run) > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
lines AS (
  SELECT r, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
lined AS (
  SELECT r, count(*) - count(DISTINCT line) AS dup, sum(n) FILTER (
    (n >= 8 OR regexp_matches(line, '__CLOSED__'))
    AND 100 * length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) <= 20 * n
    AND 100 * len(regexp_extract_all(line, '__SHOUT__')) <= 20 * n
    AND 100 * len(regexp_extract_all(line, '__SEPARATOR__')) <= 20 * n
    AND NOT regexp_matches(line, '__BOILERPLATE__')
  ) AS kept FROM lines GROUP BY r
),
base AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
    coalesce(repeated.n, 0) AS n_repeat_words, coalesce(kept, 0) AS n_kept
  FROM d JOIN w USING (r) LEFT JOIN repeated USING (r) LEFT JOIN lined USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_kept >= 60 * n_words AS kept
FROM base
"""
for _name in ("CLOSED", "SHOUT", "SEPARATOR", "BOILERPLATE"):
    OP10_SQL = OP10_SQL.replace(f"__{_name}__", getattr(quality_rules, _name).replace("'", "''"))

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> best THEN best END AS refers_to
FROM d
"""

ORACLES: dict[str, str] = {"op7_warc": OP7_SQL, "op10_quality_rules": OP10_SQL}
