"""Work lists and listing pages.

Every order is total: ``job_id`` breaks ties. Where an order names no null placement, descending keys put
nulls first and ascending keys last. Each function returns ``rn``, the place of a row in the order. Give
them postings without long texts and add these to the page: whatever columns there are, they return.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.ranking import interest_rank, page, rank
from ..functions.text import search_matches

#: Statuses of postings that a person is pursuing.
PURSUED = ("applied", "offer", "interviewing")
_STATUS = ("offer", "interviewing", "applied")


def _open() -> Column:
    return F.col("is_active") & (F.col("job_state") == "new")


def _same(column: str, value: str | None) -> Column:
    return F.lit(True) if value is None else F.col(column) == value


def jobs_to_score(jobs: DataFrame, limit: int) -> DataFrame:
    """Active postings without a score, oldest first."""
    rows = jobs.where(F.col("is_active") & F.col("resume_score").isNull())
    return page(rows, [F.asc_nulls_last("scraped_at"), F.asc("job_id")], 1, limit)


def jobs_to_apply(jobs: DataFrame, limit: int) -> DataFrame:
    """Active new postings with a score, best first."""
    rows = jobs.where(F.col("is_active") & (F.col("status") == "new") & F.col("resume_score").isNotNull())
    return page(rows, [F.desc_nulls_first("resume_score"), F.asc("job_id")], 1, limit)


def unanalysed_jobs(jobs: DataFrame, limit: int) -> DataFrame:
    """Active new postings with a description whose keywords were not taken yet.

    A column ``has_description`` stands for the description where there is one.
    """
    flag = "has_description" in jobs.columns
    there = F.col("has_description") if flag else F.col("description").isNotNull()
    rows = jobs.where(_open() & F.col("insights_analyzed_at").isNull() & there).drop(*(["has_description"] if flag else []))
    return page(rows, [F.asc("job_id")], 1, limit)


def not_pursued() -> Column:
    """Null for a posting without a status, which therefore neither expires nor is checked."""
    return ~F.col("status").isin(*PURSUED)


def older_than(column: str, settings: Settings, days: int) -> Column:
    return F.col(column) < F.lit(settings.as_of - timedelta(days=days)).cast("timestamp")


def expirable(settings: Settings) -> Column:
    return older_than("scraped_at", settings, settings.expiry_days) & not_pursued() & F.col("is_active")


def jobs_to_check(jobs: DataFrame, settings: Settings, provider: str = "linkedin") -> DataFrame:
    """Active postings of a provider not looked at for some days, the longest ago first."""
    rows = jobs.where(F.col("is_active") & (F.col("provider") == provider) & not_pursued() & older_than("last_checked", settings, settings.recheck_days))
    return page(rows, [F.asc_nulls_last("last_checked"), F.asc("job_id")], 1, settings.check_limit)


def applied_jobs(
    jobs: DataFrame,
    number: int,
    size: int,
    provider: str | None = None,
    search: str | None = None,
    status: str | None = None,
    sort_by: str | None = None,
    sort_order: str = "desc",
    offer: str = "offer",
) -> DataFrame:
    """A page of postings applied to.

    Without ``status``, those applied for, in interviews or with an offer. ``sort_by`` is application_date
    or resume_score, any other name sorts by status and latest application, as does no name. ``offer`` is
    the status that means an offer; the oldest form of this list wrote ``offered``.
    """
    listed = ("applied", "interviewing", offer)
    wanted = F.col("status").isin(*listed) if status is None else F.col("status") == status
    rows = jobs.where(_open() & wanted & _same("provider", provider) & search_matches(search, F.col("job_title"), F.col("company")))
    order = []
    if sort_by in ("application_date", "resume_score") and sort_order in ("asc", "desc"):
        order.append({"asc": F.asc_nulls_last, "desc": F.desc_nulls_last}[sort_order](sort_by))
    names = (offer, *_STATUS[1:])
    order += [rank(F.col("status"), names).asc(), F.desc_nulls_first("application_date"), F.asc("job_id")]
    return page(rows, order, number, size)


RESCORE = ("job_id", "job_title", "company", "description", "level", "resume_score", "resume_link")


def jobs_for_rescore(jobs: DataFrame, resumes: DataFrame, limit: int) -> DataFrame:
    """New postings with a tailored résumé that were scored with the general one only."""
    rows = jobs.where(_open() & (F.col("status") == "new") & F.col("customized_resume_id").isNotNull() & (F.col("resume_score_stage") == "initial") & ~F.col("is_interested").eqNullSafe(False))
    links = resumes.where(F.col("resume_link").isNotNull()).select("id", "resume_link")
    rows = rows.join(links, F.col("customized_resume_id") == F.col("id"))
    return page(rows.select(*[c for c in RESCORE if c in rows.columns]), [F.desc_nulls_first("resume_score"), F.asc("job_id")], 1, limit)


def jobs_for_generation(jobs: DataFrame, number: int, size: int, least: int = 50) -> DataFrame:
    """A page of well-scored new postings without a tailored résumé, those of interest first."""
    rows = jobs.where(_open() & (F.col("status") == "new") & (F.col("resume_score") >= least) & F.col("customized_resume_id").isNull())
    rows = rows.drop("posted_at", "insights_analyzed_at")
    return page(rows, [interest_rank(F.col("is_interested")).asc(), F.desc_nulls_first("resume_score"), F.asc("job_id")], number, size)


def top_scored_jobs(
    jobs: DataFrame,
    resumes: DataFrame,
    number: int,
    size: int,
    provider: str | None = None,
    least: int = 50,
    most: int = 100,
    interested: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """A page of new postings with a tailored résumé and a score in the range.

    ``interested`` is 'true', 'false' or 'null_value'; any other text matches nothing, None everything.
    """
    choice = {None: F.lit(True), "true": F.col("is_interested").eqNullSafe(True), "false": F.col("is_interested").eqNullSafe(False), "null_value": F.col("is_interested").isNull()}
    rows = jobs.where(
        _open()
        & (F.col("status") == "new")
        & F.col("resume_score").between(least, most)
        & _same("provider", provider)
        & choice.get(interested, F.lit(False))
        & search_matches(search, F.col("job_title"), F.col("company"))
    ).drop("posted_at", "insights_analyzed_at")
    rows = rows.join(resumes.select("id", "resume_link"), F.col("customized_resume_id") == F.col("id")).drop("id")
    order = [interest_rank(F.col("is_interested")).asc(), rank(F.col("resume_score_stage"), ("custom", "initial")).asc(), F.desc_nulls_last("resume_score"), F.desc_nulls_first("scraped_at"), F.asc("job_id")]
    return page(rows, order, number, size)


#: The parts of a résumé that a look-up by email returns.
RESUME_PARTS = ("name", "email", "phone", "location", "summary", "skills", "education", "experience", "projects", "certifications", "languages", "links")


def resume_by_email(resumes: DataFrame, email: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The stored résumé with an email, all columns or some; none without an email."""
    return lookup(resumes, "email", email, columns) if email else resumes.select(*(columns or resumes.columns)).limit(0)


def lookup(rows: DataFrame, column: str, value: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The row with a key, all columns or some; none if it isn't there."""
    found = rows.where(F.col(column) == value)
    return (found if columns is None else found.select(*columns)).limit(1)
