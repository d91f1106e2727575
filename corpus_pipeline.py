"""Training-corpus pipeline: five stages from ``documents`` to a weighted mix.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame;
all but the last return the columns of ``documents``; extra columns, whatever their names, are left out
first. Very long texts are worked on whole. An empty table gives an empty result. ``run`` writes each stage's result as Parquet to the
session's shared folder and reads it again, so that an executor lost later costs no earlier stage; the
tables that a stage's operator wrote for itself go with the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.cluster import Scratch, collected, table
from jobloom.llm.decontaminate import contamination
from jobloom.llm.minhash_dedup import near_duplicates
from jobloom.llm.queries import mixed
from jobloom.llm.substring_dedup import dedup_substrings
from jobloom.llm.toxicity_fm import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates share 80 % of their five-word shingles; repeated passages have 50 words or more.
SHINGLE, PERCENT, PASSAGE = 5, 80, 50


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the factorization machine rejects.

    Null and empty texts have the bias as their score and stay, unless that rejects; repeated rows go or stay
    together; a row with a null id is judged like any other. Without labels of both classes nothing goes.
    """
    return score_toxicity(docs.select(COLUMNS), table(spark, sf_dir, "labels")).where("predicted = 0").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates.

    Rows with a null id, and null or empty texts, are in no group and stay; rows that share an id go or
    stay together, so repeated rows of a kept document stay.
    """
    docs = docs.select(COLUMNS)
    gone = near_duplicates(docs, SHINGLE, PERCENT).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller id has as well; documents left without words go.

    Null and empty texts lose nothing and stay, as do rows with a null id; repeated rows of one id are cut
    alike. ``n_chars`` is counted anew where words went, and else stays as it was given.
    """
    cut = dedup_substrings(docs.select(COLUMNS), PASSAGE).where("n_removed = 0 or n_removed < n_words")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark passages.

    Null and empty texts hold none; repeated rows go or stay together; an empty benchmark drops nothing.
    """
    return contamination(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).where("not contaminated").select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reads the sources by their target weights; adds ``domain``, ``n_tokens`` and ``epoch``.

    A null language or source, or a source without a number, is a child of its own; texts without words
    are read where their hash falls; rows of one id and text are read together.
    """
    return mixed(docs.select(COLUMNS))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("passages", passages), ("decontaminate", decontaminate), ("mixing", mixing)]

#: The first stage is a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        before = docs
        with collected():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if at:
            scratch.forget(before)
    return docs
