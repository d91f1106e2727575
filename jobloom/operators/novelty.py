"""Which fetched postings are new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise


def stored_keys(jobs: DataFrame) -> DataFrame:
    """Distinct (company_key, title_key) of stored postings that have both."""
    rows = jobs.select(normalise(F.col("company")).alias("company_key"), normalise(F.col("job_title")).alias("title_key"))
    return rows.where("company_key <> '' and title_key <> ''").distinct()


def new_by_id(fetched: DataFrame, jobs: DataFrame) -> DataFrame:
    """Fetched rows whose id isn't stored, each id once; rows without an id are dropped."""
    return fetched.where(F.col("job_id").isNotNull()).dropDuplicates(["job_id"]).join(jobs.select("job_id"), "job_id", "left_anti")


def new_by_id_and_key(fetched: DataFrame, jobs: DataFrame) -> DataFrame:
    """As ``new_by_id``, and without those whose company and title are stored under another id.

    The pair is compared only if both parts hold more than white space; else a new id is enough.
    """
    rows = new_by_id(fetched, jobs)
    keyed = rows.withColumn("company_key", F.nullif(normalise(F.col("company")), F.lit(""))).withColumn("title_key", F.nullif(normalise(F.col("job_title")), F.lit("")))
    return keyed.join(stored_keys(jobs), ["company_key", "title_key"], "left_anti").select(*rows.columns)


def skipped(fetched: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: how many fetched ids are ``by_id`` stored, ``by_key`` stored, or ``kept``."""
    ids = fetched.where(F.col("job_id").isNotNull()).dropDuplicates(["job_id"])
    known = ids.join(jobs.select("job_id"), "job_id", "left_semi").select("job_id", F.lit("by_id").alias("why"))
    kept = new_by_id_and_key(ids, jobs).select("job_id", F.lit("kept").alias("why"))
    why = ids.select("job_id").join(known.union(kept), "job_id", "left")
    return why.agg(*[F.count_if(F.coalesce("why", F.lit("by_key")) == w).alias(w) for w in ("by_id", "by_key", "kept")])


def with_description(rows: DataFrame) -> DataFrame:
    """Rows worth saving: a description with more than white space."""
    return rows.where(F.length(normalise(F.col("description"))) > 0)
