"""Whole rounds, each from captured pages and state to a new state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame

from ..sources import captured
from .listings import jobs_for_rescore, jobs_to_score
from .merge import update_scores, upsert_jobs
from .novelty import new_by_id, new_by_id_and_key, with_description
from .plugins import Scorer
from .resumes import score_jobs


def ingest_html(search_pages: DataFrame, detail_pages: DataFrame, jobs: DataFrame, at: datetime) -> DataFrame:
    """Postings on search pages (html) that aren't stored yet, saved with the details (job_id, html) captured for them.

    One without details, or whose details have no description, is left out.
    """
    new = new_by_id(captured.search_ids(search_pages), jobs)
    details = detail_pages.dropDuplicates(["job_id"]).join(new.select("job_id"), "job_id", "left_semi")
    return upsert_jobs(jobs, with_description(captured.html_postings(details)), at)


def ingest_json(search_pages: DataFrame, details: DataFrame, jobs: DataFrame, at: datetime) -> DataFrame:
    """As ``ingest_html`` for captured JSON search pages (search, url, first, body) and details (body).

    A posting whose company and title are stored under another id is left out as well.
    """
    new = new_by_id_and_key(captured.item_records(captured.follow_pages(search_pages).select("item")), jobs)
    found = captured.json_postings(details).join(new.select("job_id"), "job_id", "left_semi").dropDuplicates(["job_id"])
    return upsert_jobs(jobs, with_description(found), at)


def score_round(jobs: DataFrame, texts: DataFrame, resume_text: Column, scorer: Scorer, limit: int) -> DataFrame:
    """Scores the oldest active postings without a score; ``texts`` are the (job_id, description) of postings."""
    work = jobs_to_score(jobs, limit).select("job_id", "job_title").join(texts, "job_id", "left")
    return update_scores(jobs, score_jobs(work, resume_text, scorer), "initial")


def rescore_round(jobs: DataFrame, resumes: DataFrame, texts: DataFrame, scorer: Scorer, limit: int) -> DataFrame:
    """Scores postings again with their tailored résumés (id, resume_link, text); one whose document gave no text waits."""
    work = jobs_for_rescore(jobs, resumes, limit).select("job_id", "job_title", "resume_link").join(texts, "job_id", "left")
    work = work.join(resumes.where("text <> ''").select("resume_link", "text").dropDuplicates(["resume_link"]), "resume_link")
    return update_scores(jobs, score_jobs(work, work["text"], scorer), "custom")
