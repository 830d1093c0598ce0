"""Corpus pipeline: language ID, near-dedup, exact substring dedup, mixing and packing over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs, extra ones included; a column of theirs that bears the name of
an operator's output is only set aside for the operator. An empty table passes every stage as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import langid, minhash, mixing, packing, suffixes
from flowlens.session import materialize

TOKENIZER = "word_bpe_49k.json"
MIN_LANGUAGE_SCORE = 0.5
PASSAGE_WORDS = 51


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, or whose language gets less than half of the probability; a null lang
    becomes the predicted one. A null or empty text has no letter and goes; a null doc_id is judged by its text like any
    other; equal rows get equal verdicts; a tie between languages falls to the first in order."""
    names = docs.columns
    scored = langid.predict(docs, langid.fit(docs))
    kept = scored.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*[F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else c for c in names])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near copies (five-word shingles, similarity 0.8): that of the smallest doc_id,
    with all its rows, of which equal ones are kept once. Documents without words, and rows with a null doc_id, are linked
    with nothing and stay; rows of one doc_id count as one document, whatever their texts."""
    return minhash.dedup(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur twice, in one document or in several, go wherever they stand, whatever their
    bytes; a document goes if that leaves it without a word. A null or empty text has no passage and stays as it is, with its
    n_chars; a null doc_id is cut like any other, and equal rows lose what they share."""
    names = docs.columns
    cut = suffixes.strip_passages(docs, PASSAGE_WORDS)
    alive = (F.col("n_removed") == 0) | (mixing.words(F.col("remaining")) > 0)
    values = {"text": F.col("remaining"), "n_chars": F.when(F.col("n_removed") == 0, F.col("n_chars"))
              .otherwise(F.length("remaining").cast("long"))}
    return cut.where(alive).select(*[values.get(c, F.col(c)).alias(c) for c in names])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it. Documents without words, a null text among them, are never
    taken; a null source is a source of its own, apart from the empty one; equal rows share what is taken of them, rows
    unlike in any column keep their own values."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, a row each. A null text is its end id alone; a null doc_id is kept; equal rows
    and copies are packed each on their own."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: No SQL twin: a trained network, sketches and a tokenizer cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a table in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
