"""Keyword counts of postings, safe to run again."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise, strip, title_case
from .merge import upsert
from .plugins import KeywordTagger


def number_batches(rows: DataFrame, order: str, size: int, most: int) -> DataFrame:
    """The first ``most`` rows of a work list with ``batch``, from 0, of ``size`` rows each.

    The limit bounds what one task numbers.
    """
    return rows.orderBy(order).limit(most).withColumn("batch", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size).cast("long"))


def batch_prompts(rows: DataFrame) -> DataFrame:
    """(batch, prompt): the descriptions of a batch under numbered headings."""
    one = F.struct("job_id", F.coalesce("job_title", F.lit("Unknown")).alias("title"), F.coalesce("description", F.lit("")).alias("text"))
    listed = F.array_sort(F.collect_list(one))
    prompt = F.transform(listed, lambda j, i: F.concat(F.lit("\n\n--- JOB "), (i + 1).cast("string"), F.lit(": "), j["title"], F.lit(" ---\n"), j["text"]))
    return rows.groupBy("batch").agg(F.array_join(prompt, "").alias("prompt"))


def mentions(jobs: DataFrame, tagger: KeywordTagger) -> DataFrame:
    """(job_id, keyword, category), a row for each mention; postings whose tagging failed give none."""
    found = jobs.select("job_id", F.explode(tagger(F.col("description"))).alias("k"))
    return found.select("job_id", keyword_name(F.col("k.keyword")).alias("keyword"), normalise(F.col("k.category")).alias("category"))


def keyword_name(text: Column) -> Column:
    return title_case(strip(text))


def count_keywords(found: DataFrame) -> DataFrame:
    return found.groupBy("keyword", "category").agg(F.count("*").alias("count"))


def add_counts(state: DataFrame, counts: DataFrame, at: datetime) -> DataFrame:
    """Adds new counts to stored ones; only the keywords counted anew are stamped."""
    new = counts.groupBy("keyword", "category").agg(F.sum("count").alias("_n"))
    total = new.join(state.select("keyword", "category", "count"), ["keyword", "category"], "left")
    total = total.select("keyword", "category", (F.coalesce("count", F.lit(0)) + F.col("_n")).alias("count"))
    return upsert(state, total, ["keyword", "category"], stamp={"last_updated": F.lit(at).cast("timestamp")})


def add_mentions(state: DataFrame, found: DataFrame, analysed: DataFrame) -> DataFrame:
    """Mentions of postings not analysed before, added to the stored ones.

    ``analysed`` are the (job_id) already in the state, those without a keyword included. Counts are a view
    on the mentions, so a run repeated after a crash counts nothing twice.
    """
    return state.unionByName(found.join(analysed.select("job_id").distinct(), "job_id", "left_anti"))


def mark_analysed(jobs: DataFrame, done: DataFrame, at: datetime) -> DataFrame:
    """Stamps the postings of successful batches."""
    flag = done.select("job_id").distinct().withColumn("_done", F.lit(True))
    stamp = F.when(F.col("_done"), F.lit(at).cast("timestamp")).otherwise(F.col("insights_analyzed_at"))
    return jobs.join(flag, "job_id", "left").withColumn("insights_analyzed_at", stamp).select(*jobs.columns)
