"""The corpus pipeline: five stages over documents, each a table of the columns of documents but the last.

For every stage: an empty table gives no rows; texts of any length are taken whole; columns beside doc_id,
text, lang and source are carried along, whatever their names. Null texts are handled as each stage says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridledger.llm import common, exact_dedup, langid, mixing, near_copies, pieces


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, with the predicted one as their lang.

    Texts that are null or without a letter go, as do those whose two nearest languages are about as near.
    Without any lang to learn from, all go. Repeated rows fare alike; ties go to the first by code point."""
    return langid.keep_languages(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the largest doc_id; null doc_ids come last, a null text equals an empty one.

    Of rows that repeat doc_id and text, one stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more), that with the smallest doc_id.

    A text of fewer words is one shingle, as is a null or empty one; null doc_ids come last; of rows that
    repeat doc_id and text, one stays."""
    return near_copies.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the order of its schedule.

    Texts without words go; a null source is one source, the last; rows that repeat doc_id, source and text
    are each taken as often as the one that is taken most."""
    return mixing.repeat_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document that the mix holds, with doc_id, source and language; a null text has none.

    Rows that repeat doc_id and text get the same pieces."""
    return pieces.encode(docs, keep=("source", "lang"))


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing sources", mixed), ("SentencePiece", encoded)]

#: Hashed n-grams, fingerprints and sampled pieces have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.docs_of(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
