"""The corpus pipeline: good documents, clean lines, one of each near-duplicate, no repeated passages, packed.

Every stage takes (spark, docs, sf_dir) and returns what it keeps; each is written and read again before the next.
All but the last return the columns of ``documents``; n_chars follows a changed text.

- ``quality_model``: fitted on this corpus and its labels; documents scored below 0.5 go.
- ``quality_rules``: failing lines go from the texts; documents that lose too much, or fail the base rules, go.
- ``near_duplicates``: of each component of SimHash links, the document with the smallest id stays.
- ``repeated_passages``: words under 20-word windows that start earlier elsewhere go; the document stays,
  with its words joined by one space if it lost any.
- ``packed``: pieces of at most 4096 tokens, each with its sequence and its place there.

Nulls, empty texts, repeated rows and empty tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm import packing, quality_model, quality_rules, simhash, substrings
from stayline.llm.common import small_batches, staged, table
from stayline.llm.queries import END_ID, SEQUENCE, WORD_VOCABULARY


def _apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` of ``docs``, whose further columns bear names meanwhile that no operator adds."""
    small_batches(docs.sparkSession)
    own = {c: c if c in ("doc_id", "text", "n_chars") else f"_own_{c}" for c in docs.columns}
    out = stage(docs.select([F.col(f"`{c}`").alias(n) for c, n in own.items()]))
    return out.select([F.col(f"`{n}`").alias(c) for c, n in own.items()])


def _with_text(docs: DataFrame, text: Column) -> DataFrame:
    docs = docs.withColumn("text", text)
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return _apart(docs, lambda d: quality_model.scored(d, model, d.columns).filter("score >= 0.5"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _apart(docs, lambda d: _with_text(quality_rules.judged(d).filter("kept"), F.col("clean_text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _apart(docs, simhash.keep_first)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return _apart(docs, lambda d: _with_text(substrings.deduplicated(d), text))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = staged(packing.pieces(docs, WORD_VOCABULARY, END_ID, SEQUENCE), "pieces")
    return packing.pack(rows, SEQUENCE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_model", quality),
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packed", packed),
]

#: Neither the fitted model nor the tokenizer can be said in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
