"""Ageing of postings: expire, check, delete, each as state -> state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import contains_any
from .listings import expirable, older_than

#: Phrases of a page whose posting is closed.
CLOSED = ("this job is no longer available", "job is closed", "No longer accepting applications")


def expire(jobs: DataFrame, settings: Settings) -> DataFrame:
    """Active postings scraped long ago and not pursued become expired and inactive."""
    due = F.coalesce(expirable(settings), F.lit(False))
    return jobs.withColumns({"job_state": F.when(due, "expired").otherwise(F.col("job_state")), "is_active": F.when(due, False).otherwise(F.col("is_active"))})


def is_closed(status: Column, body: Column) -> Column:
    """True for a closed posting, false for an open one, null if the page could not be read.

    404 means closed, any other error status open; else the phrases decide.
    """
    return F.when(status == 404, True).when(status >= 400, False).when(status.isNotNull(), contains_any(body, CLOSED))


def apply_checks(jobs: DataFrame, pages: DataFrame, settings: Settings) -> DataFrame:
    """Closed postings become removed and inactive; all that could be checked are stamped.

    ``pages`` are captured responses (job_id, http_status, body); one that failed has a null status. If
    a posting has several, the first that says it is closed counts.
    """
    seen = pages.select("job_id", is_closed(F.col("http_status"), F.col("body")).alias("closed")).groupBy("job_id").agg(F.max("closed").alias("_closed"))
    at = F.lit(settings.as_of).cast("timestamp")
    out = jobs.join(seen, "job_id", "left")
    closed = F.coalesce("_closed", F.lit(False))
    return out.withColumns({
        "job_state": F.when(closed, "removed").otherwise(F.col("job_state")),
        "is_active": F.when(closed, False).otherwise(F.col("is_active")),
        "last_checked": F.when(F.col("_closed").isNotNull(), at).otherwise(F.col("last_checked")),
    }).select(*jobs.columns)


def check_tallies(pages: DataFrame) -> DataFrame:
    """(outcome, n): inactive, active or failed."""
    outcome = F.when(F.col("closed"), "inactive").when(~F.col("closed"), "active").otherwise("failed")
    return pages.select(is_closed(F.col("http_status"), F.col("body")).alias("closed")).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def purge(jobs: DataFrame, settings: Settings) -> DataFrame:
    """Without inactive postings that expired or were removed long ago; an unknown age or state stays."""
    old = ~F.col("is_active") & F.col("job_state").isin("expired", "removed") & older_than("scraped_at", settings, settings.deletion_days)
    return jobs.where(~F.coalesce(old, F.lit(False)))


def maintain(jobs: DataFrame, pages: DataFrame, settings: Settings) -> DataFrame:
    """The daily round: expire, check, delete."""
    return purge(apply_checks(expire(jobs, settings), pages, settings), settings)
