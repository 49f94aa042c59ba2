"""A training corpus from raw documents: language, near copies, repeats, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import bpe, jaccard, langid, mixing, suffix_dedup
from skyloom.llm.common import crc_mod, materialise, table, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (null or empty text, no letter) go; a missing lang is filled in.

    Rows that repeat a doc_id or all values are judged each on their own; rows
    without doc_id are like others; of equal scores the language that is first
    by code point counts; an empty table stays empty; all columns are kept.
    """
    net = langid.fit(docs.withColumn("doc_id", F.col("doc_id").cast("long")), crc_mod(F.col("doc_id"), 3) != 1)
    pred, score = unused(docs, "lang_pred"), unused(docs, "lang_score")
    told = langid.identify(docs, net, tuple(docs.columns), (pred, score)).filter(F.col(pred) != langid.UNDETERMINED)
    return told.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest doc_id stays.

    Rows without doc_id stay, and so do documents without words, which are near
    to none; all rows of a doc_id that stays stay (equal ids are one document);
    an empty table stays empty; all columns are kept.
    """
    return jaccard.one_of_each_group(docs, jaccard.near_groups(docs)).select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that stand earlier too are cut out of the texts; all documents stay.

    A null text becomes empty; rows without doc_id keep their texts; rows of
    one doc_id are one document, see remove_repeats; n_chars is counted anew;
    an empty table stays empty; all columns are kept.
    """
    return suffix_dedup.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words, and those that the rounding takes 0 times, are not part of it.

    A null source is a source of its own; rows that repeat a doc_id, or all
    values, count each on their own, and rows without doc_id are like others;
    an empty table stays empty; all columns are kept.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left, a row for each row; a null text is empty."""
    return bpe.bpe_digests(bpe.bpe_encode_decode(docs))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("suffix_array_dedup", repeats),
    ("mixing", mixture),
    ("bpe", tokens),
]

#: SQL expresses neither the network nor BPE merges; tests hold stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
