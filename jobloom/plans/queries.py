"""Queries over the derived relations, each with the SQL that DuckDB must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import fields
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text
from ..functions.html import text_of
from ..operators import flows, insights, lifecycle, listings, merge, novelty, plugins, resumes
from ..schema import CUSTOM_RESUMES, RESUME
from ..sources import captured, derived
from ..sources.derived import JOBS_SQL, RESUMES_SQL, table

Query = Callable[[SparkSession, str], DataFrame]
SETTINGS = Settings(as_of=datetime(1999, 1, 1))
_NOW = "TIMESTAMP '1999-01-01 00:00:00'"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_JOBS, _BOTH = f"WITH {JOBS_SQL}", f"WITH {JOBS_SQL}, {RESUMES_SQL}"
_NUMBER = "CAST(job_id AS BIGINT)"
_PAGED = "job_id, company, job_title, level, location, description, status, is_active, application_date, resume_score, notes, scraped_at, last_checked, job_state, resume_score_stage, is_interested, customized_resume_id, provider"
_ALL = f"{_PAGED}, posted_at, insights_analyzed_at"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _page_sql(source: str, columns: str, where: str, order: str, size: int, number: int = 1) -> str:
    first = (number - 1) * size
    return f"{source}, ranked AS (SELECT {columns}, row_number() OVER (ORDER BY {order}, job_id) AS rn FROM {where}) SELECT * FROM ranked WHERE rn > {first} AND rn <= {first + size}"


def _slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings without their texts, which the pages add."""
    return derived.jobs(spark, sf_dir, description=False)


_RESCORE_FROM = """jobs JOIN customized_resumes cr ON customized_resume_id = cr.id WHERE is_active AND status = 'new' AND job_state = 'new'
 AND resume_link IS NOT NULL AND resume_score_stage = 'initial' AND is_interested IS NOT FALSE"""


@query(_page_sql(_BOTH, ", ".join(listings.RESCORE), _RESCORE_FROM, "resume_score DESC NULLS FIRST", 10))
def rescore_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = listings.jobs_for_rescore(_slim(spark, sf_dir), derived.customized_resumes(spark, sf_dir), SETTINGS.score_limit)
    return derived.described(page, spark, sf_dir)


_INTEREST = "CASE WHEN is_interested THEN 1 WHEN is_interested IS NULL THEN 2 ELSE 3 END"
_STATUS = "CASE status WHEN 'offer' THEN 1 WHEN 'interviewing' THEN 2 WHEN 'applied' THEN 3 ELSE 4 END"
_OPEN = "is_active AND job_state = 'new'"


@query(_page_sql(_JOBS, _PAGED, f"jobs WHERE {_OPEN} AND status = 'new' AND resume_score >= 50 AND customized_resume_id IS NULL", f"{_INTEREST}, resume_score DESC NULLS FIRST", 25, 2))
def resume_generation_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.described(listings.jobs_for_generation(_slim(spark, sf_dir), 2, 25), spark, sf_dir)


_TOP = f"jobs JOIN customized_resumes cr ON customized_resume_id = cr.id WHERE {_OPEN} AND status = 'new'"
_TOP_ORDER = f"{_INTEREST}, CASE resume_score_stage WHEN 'custom' THEN 1 WHEN 'initial' THEN 2 ELSE 3 END, resume_score DESC NULLS LAST, scraped_at DESC NULLS FIRST"


@query(_page_sql(_BOTH, f"{_PAGED}, resume_link", f"{_TOP} AND resume_score BETWEEN 50 AND 100 AND provider = 'linkedin'", _TOP_ORDER, 20))
def top_scored_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.described(listings.top_scored_jobs(_slim(spark, sf_dir), derived.customized_resumes(spark, sf_dir), 1, 20, provider="linkedin"), spark, sf_dir)


@query(_page_sql(_BOTH, f"{_PAGED}, resume_link", f"{_TOP} AND resume_score BETWEEN 10 AND 90 AND is_interested IS NULL AND (job_title ILIKE '%a_t%' OR company ILIKE '%a_t%')", _TOP_ORDER, 20))
def top_scored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.described(listings.top_scored_jobs(_slim(spark, sf_dir), derived.customized_resumes(spark, sf_dir), 1, 20, least=10, most=90, interested="null_value", search="a_t"), spark, sf_dir)


_APPLIED_ORDER = f"{_STATUS}, application_date DESC NULLS FIRST"


@query(_page_sql(_JOBS, _ALL, f"jobs WHERE {_OPEN} AND status IN ('applied', 'interviewing', 'offered')", "CASE status WHEN 'offered' THEN 1 WHEN 'interviewing' THEN 2 WHEN 'applied' THEN 3 ELSE 4 END, application_date DESC NULLS FIRST", 30, 2))
def applied_page_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.described(listings.applied_jobs(_slim(spark, sf_dir), 2, 30, offer="offered"), spark, sf_dir)


@query(_page_sql(_JOBS, _ALL, f"jobs WHERE {_OPEN} AND status IN ('applied', 'interviewing', 'offer') AND provider = 'careers_future' AND (job_title ILIKE '%an%' OR company ILIKE '%an%')", _APPLIED_ORDER, 30, 2))
def applied_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.described(listings.applied_jobs(_slim(spark, sf_dir), 2, 30, provider="careers_future", search="an"), spark, sf_dir)


@query(_page_sql(_JOBS, _ALL, f"jobs WHERE {_OPEN} AND status = 'interviewing'", _APPLIED_ORDER, 30))
def applied_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.described(listings.applied_jobs(_slim(spark, sf_dir), 1, 30, status="interviewing"), spark, sf_dir)


@query(_page_sql(_JOBS, _ALL, f"jobs WHERE {_OPEN} AND status IN ('applied', 'interviewing', 'offer')", f"resume_score ASC NULLS LAST, {_APPLIED_ORDER}", 40))
def applied_dynamic_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.described(listings.applied_jobs(_slim(spark, sf_dir), 1, 40, sort_by="resume_score", sort_order="asc"), spark, sf_dir)


@query(_page_sql(_JOBS, _ALL, "jobs WHERE is_active AND resume_score IS NULL", "scraped_at ASC NULLS LAST", 10))
def jobs_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.described(listings.jobs_to_score(_slim(spark, sf_dir), SETTINGS.score_limit), spark, sf_dir)


@query(_page_sql(_JOBS, _ALL, "jobs WHERE is_active AND status = 'new' AND resume_score IS NOT NULL", "resume_score DESC NULLS FIRST", 50))
def jobs_to_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.described(listings.jobs_to_apply(_slim(spark, sf_dir), 50), spark, sf_dir)


@query(_page_sql(_JOBS, _ALL, f"jobs WHERE {_OPEN} AND insights_analyzed_at IS NULL AND description IS NOT NULL", "1", 200).replace("ORDER BY 1, job_id", "ORDER BY job_id"))
def unanalysed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = listings.unanalysed_jobs(derived.with_text_flag(_slim(spark, sf_dir), spark, sf_dir), SETTINGS.analyse_limit)
    return derived.described(work, spark, sf_dir)


_FREE = "status NOT IN ('applied', 'offer', 'interviewing')"


@query(_page_sql(_JOBS, _ALL, f"jobs WHERE is_active AND provider = 'linkedin' AND {_FREE} AND last_checked < {_NOW} - INTERVAL 3 DAY", "last_checked ASC NULLS LAST", 50))
def activity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.described(listings.jobs_to_check(_slim(spark, sf_dir), SETTINGS), spark, sf_dir)


_STATE = "job_id, status, is_active, job_state, scraped_at, last_checked"
_SLIM = _STATE.split(", ")
_DUE = f"coalesce(scraped_at < {_NOW} - INTERVAL 30 DAY AND {_FREE} AND is_active, false)"


@query(f"{_JOBS} SELECT job_id, status, is_active AND NOT {_DUE} AS is_active, CASE WHEN {_DUE} THEN 'expired' ELSE job_state END AS job_state, scraped_at, last_checked FROM jobs")
def expire_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.expire(derived.jobs(spark, sf_dir, description=False).select(*_SLIM), SETTINGS)


@query(f"{_JOBS} SELECT {_STATE} FROM jobs WHERE NOT coalesce(NOT is_active AND job_state IN ('expired', 'removed') AND scraped_at < {_NOW} - INTERVAL 60 DAY, false)")
def purge_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.purge(derived.jobs(spark, sf_dir, description=False).select(*_SLIM), SETTINGS)


def captured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response for each posting whose number is a multiple of three: found, gone, refused, closed or failed."""
    key = F.col("o_orderkey")
    body = F.when(key % 5 == 2, "<p>NO LONGER accepting applications</p>").when(key % 5 == 3, "This JOB IS CLOSED").otherwise(F.col("o_orderpriority"))
    status = F.when(key % 7 == 0, 404).when(key % 7 == 1, 503).when(key % 7 != 2, 200)
    return table(spark, sf_dir, "orders").where(key % 3 == 0).select(key.cast("string").alias("job_id"), status.alias("http_status"), body.alias("body"))


_PAGES_SQL = """pages_ AS (SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE WHEN o_orderkey % 7 = 0 THEN true WHEN o_orderkey % 7 = 1 THEN false
 WHEN o_orderkey % 7 <> 2 THEN o_orderkey % 5 IN (2, 3) END AS closed FROM orders WHERE o_orderkey % 3 = 0)"""


@query(f"{_JOBS}, {_PAGES_SQL} SELECT job_id, status, is_active AND NOT coalesce(closed, false) AS is_active, CASE WHEN closed THEN 'removed' ELSE job_state END AS job_state, scraped_at, CASE WHEN closed IS NOT NULL THEN {_NOW} ELSE last_checked END AS last_checked FROM jobs LEFT JOIN pages_ USING (job_id)")
def check_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.apply_checks(derived.jobs(spark, sf_dir, description=False).select(*_SLIM), captured_pages(spark, sf_dir), SETTINGS)


@query(f"WITH {_PAGES_SQL} SELECT CASE WHEN closed THEN 'inactive' WHEN NOT closed THEN 'active' ELSE 'failed' END AS outcome, count(*) AS n FROM pages_ GROUP BY 1")
def check_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.check_tallies(captured_pages(spark, sf_dir))


@query(f"""{_JOBS}, {_PAGES_SQL},
 e AS (SELECT job_id, status, is_active AND NOT {_DUE} AS is_active, CASE WHEN {_DUE} THEN 'expired' ELSE job_state END AS job_state, scraped_at, last_checked FROM jobs),
 c AS (SELECT job_id, status, is_active AND NOT coalesce(closed, false) AS is_active, CASE WHEN closed THEN 'removed' ELSE job_state END AS job_state, scraped_at, CASE WHEN closed IS NOT NULL THEN {_NOW} ELSE last_checked END AS last_checked FROM e LEFT JOIN pages_ USING (job_id))
 SELECT * FROM c WHERE NOT coalesce(NOT is_active AND job_state IN ('expired', 'removed') AND scraped_at < {_NOW} - INTERVAL 60 DAY, false)""")
def maintained_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.maintain(derived.jobs(spark, sf_dir, description=False).select(*_SLIM), captured_pages(spark, sf_dir), SETTINGS)


@query(f"{_JOBS} SELECT {_STATE} FROM jobs WHERE {_DUE}")
def expirable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.jobs(spark, sf_dir, description=False).select(*_SLIM).where(listings.expirable(SETTINGS))


@query(f"{_JOBS} SELECT job_id, CASE WHEN {_NUMBER} % 5 = 1 THEN {_NOW} ELSE last_checked END AS last_checked FROM jobs")
def touched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.jobs(spark, sf_dir, description=False).select("job_id", "last_checked")
    return merge.touch(rows, rows.where(F.col("job_id").cast("long") % 5 == 1), "job_id", "last_checked", SETTINGS.as_of)


@query("SELECT DISTINCT CAST(o_orderkey % 1000 AS VARCHAR) AS job_id FROM orders WHERE o_orderkey % 7 <> 0")
def html_search_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search pages made of orders: a card each, some with a URN that names no posting."""
    key = F.col("o_orderkey")
    urn = F.when(key % 7 == 0, "urn:li:x:1").otherwise(F.concat(F.lit("urn:li:jobPosting:"), (key % 1000).cast("string")))
    html = F.concat(F.lit('<ul><li><div class="base-card wide" data-entity-urn="'), urn, F.lit('"><a>x</a></div></li><li>none</li></ul>'))
    return captured.search_ids(table(spark, sf_dir, "orders").select(html.alias("html")))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Inc & ' || o_orderstatus WHEN o_orderkey % 3 = 1 THEN 'Link' ELSE 'Flavor' END AS company,
 o_orderpriority AS job_title, CASE WHEN o_orderkey % 4 = 0 THEN 'Mid' END AS level, CASE WHEN o_orderkey % 3 = 2 THEN 'Flavor' END AS location,
 'Line ' || o_orderkey || chr(10) || 'two' AS description, 'linkedin' AS provider FROM orders""")
def html_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail pages made of orders, with the places of a field present in turn."""
    key, join = F.col("o_orderkey"), F.concat
    image = F.when(key % 3 == 0, join(F.lit('<a><img alt=" Inc &amp; '), "o_orderstatus", F.lit(' "></a>'))).otherwise("<a>x</a>")
    link = F.when(key % 3 == 1, '<a class="topcard__org-name-link big"> Link </a>').otherwise("")
    flavor = F.when(key % 3 == 2, '<div class="topcard__flavor-row"><span class="topcard__flavor">Flavor</span></div>').otherwise("")
    title = F.when(key % 2 == 0, join(F.lit('<div class="top-card-layout__entity-info"><a>'), "o_orderpriority", F.lit("</a></div>"))).otherwise(join(F.lit('<h1 class="top-card-layout__title">'), "o_orderpriority", F.lit("</h1>")))
    level = F.when(key % 4 == 0, '<ul class="description__job-criteria-list"><li><h3 class="description__job-criteria-subheader">Seniority level</h3><span class="description__job-criteria-text">Mid</span></li></ul>').otherwise("")
    body = join(F.lit('<div class="show-more-less-html__markup">Line '), key.cast("string"), F.lit("<br>\n\n<p> two </p></div>"))
    html = join(F.lit('<div class="top-card-layout__card">'), image, F.lit("</div>"), link, flavor, title, level, body)
    return captured.html_postings(table(spark, sf_dir, "orders").select(key.cast("string").alias("job_id"), html.alias("html")))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'H' WHEN o_orderkey % 3 = 1 THEN 'P' END AS company, o_orderpriority AS job_title, 'Singapore' AS location,
 CASE WHEN o_orderkey % 4 = 0 THEN 'Not applicable' ELSE 'L' || (o_orderkey % 5) END AS level, 'careers_future' AS provider, CASE WHEN o_orderkey % 6 <> 0 THEN 'Do ' || o_orderstatus END AS description,
 CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS posted_at FROM orders""")
def json_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON details made of orders, with companies, levels, texts and times missing in turn."""
    key = F.col("o_orderkey")
    named = lambda x: F.struct(x.alias("name"))
    item = F.struct(
        key.cast("string").alias("uuid"), F.col("o_orderpriority").alias("title"), F.when(key % 6 == 0, "").otherwise(F.concat(F.lit("<p>Do  "), "o_orderstatus", F.lit("</p>"))).alias("description"),
        named(F.when(key % 3 == 0, "H").otherwise("")).alias("hiringCompany"), F.when(key % 3 < 2, named(F.lit("P"))).alias("postedCompany"),
        F.when(key % 4 == 0, F.array().cast("array<struct<position:string>>")).otherwise(F.array(F.struct(F.concat(F.lit("L"), (key % 5).cast("string")).alias("position")))).alias("positionLevels"),
        F.struct(F.when(key % 5 == 0, "").otherwise(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("createdAt")).alias("metadata"),
    )
    return captured.json_postings(table(spark, sf_dir, "orders").select(F.to_json(item).alias("body")))


def _fetched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings whose number ends in 7 to 9 as fetched, those that end in 0 to 7 as stored."""
    rows = derived.jobs(spark, sf_dir, description=False).select("job_id", "company", "job_title")
    last = F.right("job_id", F.lit(1))
    return rows.where(last >= "7"), rows.where(last <= "7")


_FETCH_SQL = f"{_JOBS}, fetched AS (SELECT job_id, company, job_title FROM jobs WHERE right(job_id, 1) >= '7'), stored AS (SELECT job_id, company, job_title FROM jobs WHERE right(job_id, 1) <= '7')"
_KEYS_SQL = "keys AS (SELECT DISTINCT lower(trim(company)) AS c, lower(trim(job_title)) AS t FROM stored WHERE trim(company) <> '' AND trim(job_title) <> '')"
_NEW_SQL = f"{_FETCH_SQL}, {_KEYS_SQL}, fresh AS (SELECT * FROM fetched WHERE job_id NOT IN (SELECT job_id FROM stored)), kept AS (SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM keys WHERE c = lower(trim(f.company)) AND t = lower(trim(f.job_title))))"


@query(f"{_FETCH_SQL} SELECT * FROM fetched WHERE job_id NOT IN (SELECT job_id FROM stored)")
def new_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty.new_by_id(*_fetched(spark, sf_dir))


@query(f"{_NEW_SQL} SELECT * FROM kept")
def new_by_id_and_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty.new_by_id_and_key(*_fetched(spark, sf_dir))


@query(f"{_NEW_SQL} SELECT (SELECT count(*) FROM fetched) - (SELECT count(*) FROM fresh) AS by_id, (SELECT count(*) FROM fresh) - (SELECT count(*) FROM kept) AS by_key, (SELECT count(*) FROM kept) AS kept")
def skipped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty.skipped(*_fetched(spark, sf_dir))


@query(f"{_FETCH_SQL}, {_KEYS_SQL} SELECT c AS company_key, t AS title_key FROM keys")
def normalised_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty.stored_keys(_fetched(spark, sf_dir)[1])


@query(f"{_JOBS} SELECT job_id, description FROM jobs WHERE length(trim(description)) > 0")
def described_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty.with_description(derived.jobs(spark, sf_dir).select("job_id", "description"))


@query(f"{_JOBS} SELECT DISTINCT job_id FROM jobs")
def stored_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.jobs(spark, sf_dir, description=False).select("job_id").distinct()


#: A vocabulary for the stand-in tagger: the commonest words of the fixture's languages.
TERMS = {"with": "Skill ", "from": "skill", "there": "tool", "und": "Attribute", "nicht": "attribute", "avec": "Skill", "para": "TOOL", "once": "tool"}


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.jobs(spark, sf_dir).where("description is not null").select("job_id", "description")
    return insights.mentions(rows, plugins.dictionary_tagger(TERMS))


_TERMS_SQL = ", ".join(f"('{t}', '{t.capitalize()}', '{c.strip().lower()}')" for t, c in TERMS.items())
_FOUND_SQL = f"{_JOBS}, terms(t, keyword, category) AS (VALUES {_TERMS_SQL}), found AS (SELECT job_id, keyword, category FROM (SELECT job_id, unnest(regexp_extract_all(lower(description), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM jobs) JOIN terms USING (t))"


@query(f"{_FOUND_SQL} SELECT keyword, category, count(*) AS \"count\" FROM found GROUP BY ALL")
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.count_keywords(_found(spark, sf_dir))


def _stored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    names = F.element_at(F.array(*[F.lit(t.capitalize()) for t in TERMS]), (key % len(TERMS) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").where("p_partkey < 6").select(names.alias("keyword"), F.when(key % 2 == 0, "skill").otherwise("tool").alias("category"), (key + 100).alias("count"))
    return rows.withColumn("last_updated", F.lit("1998-01-01 00:00:00").cast("timestamp"))


_STORED_SQL = "stored AS (SELECT CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{t.capitalize()}'" for i, t in enumerate(TERMS)) + " END AS keyword, CASE WHEN p_partkey % 2 = 0 THEN 'skill' ELSE 'tool' END AS category, p_partkey + 100 AS n FROM part WHERE p_partkey < 6)"


@query(f"{_FOUND_SQL}, {_STORED_SQL}, c AS (SELECT keyword, category, count(*) AS n FROM found GROUP BY ALL) SELECT keyword, category, coalesce(stored.n, 0) + coalesce(c.n, 0) AS \"count\", CASE WHEN c.n IS NULL THEN TIMESTAMP '1998-01-01 00:00:00' ELSE {_NOW} END AS last_updated FROM stored FULL JOIN c USING (keyword, category)")
def keyword_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.add_counts(_stored_counts(spark, sf_dir), insights.count_keywords(_found(spark, sf_dir)), SETTINGS.as_of)


@query(f"{_JOBS} SELECT job_id, CASE WHEN right(job_id, 1) = '4' THEN {_NOW} ELSE insights_analyzed_at END AS insights_analyzed_at FROM jobs")
def mark_analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.jobs(spark, sf_dir, description=False).select("job_id", "insights_analyzed_at")
    return insights.mark_analysed(rows, rows.where(F.right("job_id", F.lit(1)) == "4"), SETTINGS.as_of)


@query(rf"""{_page_sql(_JOBS, _ALL, f"jobs WHERE {_OPEN} AND insights_analyzed_at IS NULL AND description IS NOT NULL", "1", 200).replace("ORDER BY 1, job_id", "ORDER BY job_id").replace(" SELECT * FROM ranked", ", work AS (SELECT * FROM ranked")}),
 b AS (SELECT *, (row_number() OVER (ORDER BY job_id) - 1) // 10 AS batch, (row_number() OVER (ORDER BY job_id) - 1) % 10 + 1 AS k FROM work)
 SELECT CAST(batch AS BIGINT) AS batch, string_agg(chr(10) || chr(10) || '--- JOB ' || k || ': ' || coalesce(job_title, 'Unknown') || ' ---' || chr(10) || coalesce(description, ''), '' ORDER BY k) AS prompt FROM b GROUP BY 1""")
def keyword_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.batch_prompts(insights.number_batches(unanalysed_jobs(spark, sf_dir), "job_id", SETTINGS.keyword_batch, SETTINGS.analyse_limit))


def _scores(rows: DataFrame) -> DataFrame:
    number = F.col("job_id").cast("long")
    return rows.where(number % 3 == 0).select("job_id", F.when(number % 4 != 0, number % 101).cast("short").alias("resume_score"))


@query(f"{_JOBS} SELECT job_id, CASE WHEN {_NUMBER} % 3 = 0 AND {_NUMBER} % 4 <> 0 THEN CAST({_NUMBER} % 101 AS SMALLINT) ELSE resume_score END AS resume_score, CASE WHEN {_NUMBER} % 3 = 0 AND {_NUMBER} % 4 <> 0 THEN 'custom' ELSE resume_score_stage END AS resume_score_stage FROM jobs")
def score_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.jobs(spark, sf_dir, description=False).select("job_id", "resume_score", "resume_score_stage")
    return merge.update_scores(rows, _scores(rows), "custom")


@query(f"{_JOBS} SELECT job_id, status, CASE WHEN {_NUMBER} % 9 = 0 THEN 'r' || job_id ELSE customized_resume_id END AS customized_resume_id FROM jobs")
def resume_link_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.jobs(spark, sf_dir, description=False).select("job_id", "status", "customized_resume_id")
    links = rows.where(F.col("job_id").cast("long") % 9 == 0).select("job_id", F.concat(F.lit("r"), "job_id").alias("customized_resume_id"))
    return merge.link_resumes(rows, links)


@query(f"{_BOTH} SELECT job_id, cr.id AS customized_resume_id FROM jobs LEFT JOIN (SELECT id FROM customized_resumes WHERE resume_link IS NOT NULL) cr ON customized_resume_id = cr.id")
def fk_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.jobs(spark, sf_dir, description=False).select("job_id", "customized_resume_id")
    return merge.release_orphans(rows, derived.customized_resumes(spark, sf_dir).where("resume_link is not null"))


@query(f"""{_JOBS}, stored AS (SELECT job_id, company, status, job_state, is_active, scraped_at FROM jobs WHERE {_NUMBER} % 10 < 8),
 new AS (SELECT job_id, upper(company) AS company FROM jobs WHERE {_NUMBER} % 10 > 5)
 SELECT job_id, CASE WHEN new.job_id IS NOT NULL THEN new.company ELSE stored.company END AS company, CASE WHEN stored.job_id IS NULL THEN 'new' ELSE status END AS status,
 CASE WHEN stored.job_id IS NULL THEN 'new' ELSE job_state END AS job_state, CASE WHEN stored.job_id IS NULL THEN true ELSE is_active END AS is_active,
 CASE WHEN stored.job_id IS NULL THEN {_NOW} ELSE scraped_at END AS scraped_at FROM stored FULL JOIN new USING (job_id)""")
def jobs_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.jobs(spark, sf_dir, description=False).select("job_id", "company", "status", "job_state", "is_active", "scraped_at")
    number = F.col("job_id").cast("long") % 10
    return merge.upsert_jobs(rows.where(number < 8), rows.where(number > 5).select("job_id", F.upper("company").alias("company")), SETTINGS.as_of)


def _people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored and parsed résumés; some parsed ones have no email."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(key, "c_name", "c_mktsegment")
    stored = rows.where(key % 3 < 2).select(F.concat("c_name", F.lit("@example.com")).alias("email"), F.col("c_name").alias("name"), F.lit("1998-01-01 00:00:00").cast("timestamp").alias("parsed_at"))
    email = F.when(key % 5 == 0, "").when(key % 7 == 0, None).otherwise(F.concat("c_name", F.lit("@example.com")))
    return stored, rows.where(key % 3 > 0).select(email.alias("email"), F.col("c_mktsegment").alias("name"))


@query(f"""WITH s AS (SELECT c_name || '@example.com' AS email, c_name AS name FROM customer WHERE c_custkey % 3 < 2),
 p AS (SELECT c_name || '@example.com' AS email, c_mktsegment AS name FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0)
 SELECT email, CASE WHEN p.email IS NOT NULL THEN p.name ELSE s.name END AS name, CASE WHEN p.email IS NOT NULL THEN {_NOW} ELSE TIMESTAMP '1998-01-01 00:00:00' END AS parsed_at FROM s FULL JOIN p USING (email)""")
def resume_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert_resume(*_people(spark, sf_dir), SETTINGS.as_of)


@query("SELECT c_name || '@example.com' AS email, c_name AS name FROM customer WHERE c_custkey = 7")
def resume_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.concat("c_name", F.lit("@example.com")).alias("email"), F.col("c_name").alias("name"))
    return listings.lookup(rows, "key", "7", ("email", "name"))


@query(f"{_JOBS} SELECT job_id, job_title, company, status FROM jobs WHERE job_id = '42'")
def job_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.lookup(derived.jobs(spark, sf_dir, description=False), "job_id", "42", ("job_id", "job_title", "company", "status"))


_TRIM_SQL = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_WORDS_SQL = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(rf"""WITH w AS (SELECT doc_id, text, {_WORDS_SQL.format("text")} AS ws FROM documents)
 SELECT doc_id, CASE WHEN len(ws) > 20 THEN regexp_replace(array_to_string(ws[1:20], ' '), '[,;]+$', '') || '.' ELSE {_TRIM_SQL.format("text")} END AS bullet FROM w""")
def bullet_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", text.trim_bullet(F.col("text")).alias("bullet"))


@query(r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(\p{L}+|[^\p{L}]+)'), lambda x: CASE WHEN x[1] = 'ß' THEN 'Ss' ELSE upper(x[1]) END || lower(x[2:])), '') AS title FROM documents""")
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", text.title_case(F.col("text")).alias("title"))


@query(rf"SELECT doc_id, lower({_TRIM_SQL.format('text')}) AS norm FROM documents")
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", text.normalise(F.col("text")).alias("norm"))


_RAW_SQL = """CASE o_orderkey % 8 WHEN 0 THEN CAST(o_orderkey % 130 AS VARCHAR) WHEN 1 THEN ' ' || CAST(o_orderkey % 101 AS VARCHAR) || chr(10) WHEN 2 THEN '-1'
 WHEN 3 THEN CAST(o_orderkey % 90 AS VARCHAR) || '.5' WHEN 4 THEN 'Score: 85' WHEN 5 THEN '' WHEN 6 THEN NULL ELSE '+85' END"""


@query(f"WITH r AS (SELECT o_orderkey, {_RAW_SQL} AS s FROM orders) SELECT o_orderkey, CASE WHEN regexp_full_match(trim(replace(s, chr(10), '')), '[+-]?[0-9]+') AND TRY_CAST(trim(replace(s, chr(10), '')) AS INTEGER) BETWEEN 0 AND 100 THEN TRY_CAST(trim(replace(s, chr(10), '')) AS SMALLINT) END AS score FROM r")
def score_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(_RAW_SQL.replace("VARCHAR", "STRING").replace("chr(10)", "'\\n'"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.parse_score(raw).alias("score"))


@query(rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: {_TRIM_SQL.format("regexp_replace(" + _TRIM_SQL.format("s") + ", '^[•-]+', '')")}), lambda s: s <> '') AS ls FROM documents WHERE contains(text, chr(10)))
 SELECT doc_id, CAST(len(ls) AS BIGINT) AS n, array_to_string(ls, chr(10)) AS bullets FROM l""")
def bullet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir).where(F.contains("text", F.lit("\n"))).select("doc_id", text.split_bullets(F.col("text")).alias("b"))
    return rows.select("doc_id", F.size("b").cast("long").alias("n"), F.array_join("b", "\n").alias("bullets"))


def _replaced(text: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        text = f"replace({text}, {old}, {new})"
    return text


def _bullets_sql(column: str) -> str:
    """The bullets of a text as a list: lines, or sentences whose abbreviations' blanks are marked while it is cut."""
    marked = _replaced(_TRIM_SQL.format(column), [(f"'{a} '", f"'{a}' || chr(1)") for a in text.ABBREVIATIONS])
    lines = f"list_filter(list_transform(string_split({column}, chr(10)), lambda s: {_TRIM_SQL.format('regexp_replace(' + _TRIM_SQL.format('s') + ", '^[•-]+', '')")}), lambda s: s <> '')"
    shown = _TRIM_SQL.format("replace(s, chr(1), ' ')")
    ends = f"CASE WHEN regexp_matches({shown}, '[.!?]$') THEN {shown} ELSE {shown} || '.' END"
    sentences = f"list_transform(list_filter(string_split({marked}, '. '), lambda s: {shown} <> ''), lambda s: {ends})"
    return f"CASE WHEN contains({column}, chr(10)) THEN {lines} ELSE {sentences} END"


@query(f"WITH b AS (SELECT doc_id, {_bullets_sql('text')} AS bs FROM documents) SELECT doc_id, CAST(len(bs) AS BIGINT) AS n, array_to_string(bs, chr(10)) AS bullets FROM b")
def bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines or sentences of all texts."""
    rows = _texts(spark, sf_dir).select("doc_id", text.split_bullets(F.col("text")).alias("b"))
    return rows.select("doc_id", F.size("b").cast("long").alias("n"), F.array_join("b", "\n").alias("bullets"))


#: Sentences with each abbreviation, made of words of the events.
_SPOKEN_SQL = "'Met ' || event_type || ' e.g. Dr. No. Saw i.e. one. It was in the U.S. then vs. now! Ask Mrs. Lee etc. ' || props || '. Done? Yes. Ph.D. of St. X'"


@query(f"WITH b AS (SELECT event_id, {_bullets_sql('s')} AS bs FROM (SELECT event_id, {_SPOKEN_SQL} AS s FROM events)) SELECT event_id, CAST(len(bs) AS BIGINT) AS n, array_to_string(bs, chr(10)) AS bullets FROM b")
def bullet_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", text.split_bullets(F.expr(_SPOKEN_SQL)).alias("b"))
    return rows.select("event_id", F.size("b").cast("long").alias("n"), F.array_join("b", "\n").alias("bullets"))


@query(r"""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Here: ```json' || chr(10) || props || chr(10) || '``` done' WHEN event_id % 3 = 1 THEN 'loose ' || props || ' end' ELSE props END AS t, props FROM events)
 SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM e""")
def json_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    loose = F.when(key % 3 == 0, F.concat(F.lit("Here: ```json\n"), "props", F.lit("\n``` done"))).when(key % 3 == 1, F.concat(F.lit("loose "), "props", F.lit(" end"))).otherwise(F.col("props"))
    parsed = F.from_json(text.json_candidate(loose), "k long")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"))


@query("""SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 4 < 3 THEN 'a}"b' END AS note FROM events""")
def json_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested objects, fenced or loose, with brackets in strings, before loose brackets, or never closed."""
    key, join = F.col("event_id") % 4, F.concat
    nested = join(F.lit('{"in": {"deep": ['), "props", F.lit(r', {"x": []}], "note": "a}\"b"}}'))
    made = F.when(key == 0, join(F.lit("First {not this\n```json\n"), nested, F.lit("\n``` or [that]"))).when(key == 1, join(F.lit("so "), nested, F.lit(" and {"))).when(key == 2, join(F.lit('he said "no" [ or '), nested)).otherwise('{"in": [')
    parsed = F.from_json(text.json_candidate(made), "`in` struct<deep: array<struct<k: long>>, note: string>")
    return table(spark, sf_dir, "events").select("event_id", parsed["in"]["deep"][0]["k"].alias("k"), parsed["in"]["note"].alias("note"))


@query(f"""{_JOBS}, w AS (SELECT job_id, description, list_distinct(list_filter(string_split_regex(lower(job_title || ' ' || description), '\\s+'), lambda w: w <> '')) AS ws FROM jobs)
 SELECT job_id, CASE WHEN description IS NOT NULL AND description <> '' THEN CAST(len(list_filter(ws, lambda w: list_contains(['the', 'and', 'with', 'of', 'und', 'der', 'la', 'de'], w))) * 100 // len(ws) AS SMALLINT) END AS resume_score FROM w""")
def overlap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    resume = F.lit("The and WITH of und der la de")
    return resumes.score_jobs(derived.jobs(spark, sf_dir).select("job_id", "job_title", "description"), resume, plugins.overlap_score)


@query("SELECT c_mktsegment AS segment, (i - 1) // 3 AS seq, (i - 1) % 3 AS col, '• ' || n AS text FROM (SELECT c_mktsegment, n_name AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n_name) AS i FROM (SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey))")
def skill_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    skills = names.groupBy("c_mktsegment").agg(F.array_sort(F.collect_set("n_name")).alias("skills"))
    return resumes.layout_rows(skills.select(F.col("c_mktsegment").alias("id"), _resume("skills"))).where("section = 'skills'").select(F.col("id").alias("segment"), F.col("seq").cast("long"), F.col("col").cast("long"), "text")


def _resume(*given: str) -> Column:
    """A résumé with the given columns; its other parts are null."""
    return F.struct(*[(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in RESUME.fields]).alias("resume")


def _documents_as_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("Person "), "doc_id").alias("name"), F.concat(F.lit("p"), "doc_id", F.lit("@example.com")).alias("email"), F.col("text").alias("summary"),
        F.split("text", " ").alias("skills"), F.array(F.struct(F.col("source").alias("job_title"), F.col("lang").alias("company"), F.lit(None).cast("string").alias("location"), F.lit("2020").alias("start_date"), F.lit(None).cast("string").alias("end_date"), F.col("text").alias("description"))).alias("experience"),
    )
    return rows.select("id", _resume("name", "email", "summary", "skills", "experience"))


_CUT_BULLETS_SQL = f"array_to_string(list_transform({_bullets_sql('text')}[1:4], lambda b: '• ' || " + rf"""CASE WHEN len({_WORDS_SQL.format("b")}) > 20 THEN regexp_replace(array_to_string({_WORDS_SQL.format("b")}[1:20], ' '), '[,;]+$', '') || '.' ELSE {_TRIM_SQL.format("b")} END), chr(10))"""


@query(rf"""WITH w AS (SELECT doc_id, text, {_WORDS_SQL.format("text")} AS ws FROM documents)
 SELECT doc_id AS id, CASE WHEN len(ws) > 60 THEN regexp_replace(array_to_string(ws[1:60], ' '), '[,;]+$', '') || '...' ELSE text END AS summary, array_to_string(string_split(text, ' ')[1:12], '|') AS skills,
 CASE WHEN text <> '' THEN {_CUT_BULLETS_SQL} ELSE text END AS description FROM w""")
def resume_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _documents_as_resumes(spark, sf_dir).select("id", resumes.fit_budget(F.col("resume")).alias("r"))
    return cut.select("id", "r.summary", F.array_join("r.skills", "|").alias("skills"), F.element_at("r.experience", 1)["description"].alias("description"))


_SECTION_END = "|| chr(10) || chr(10) || '---' || chr(10)"


@query(rf"""SELECT doc_id AS id, 'Name: Person ' || doc_id || chr(10) || 'Email: p' || doc_id || '@example.com' {_SECTION_END}
 || CASE WHEN text <> '' THEN chr(10) || 'Summary:' || chr(10) || text {_SECTION_END} ELSE '' END || chr(10) || 'Skills:' || chr(10) || array_to_string(string_split(text, ' '), ', ') {_SECTION_END}
 || chr(10) || 'Experience:' || chr(10) || chr(10) || '* ' || source || ' at ' || lang || chr(10) || '  Dates: 2020 - Present'
 || CASE WHEN text <> '' THEN chr(10) || '  Description:' || array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda s: {_TRIM_SQL.format("s")}), lambda s: s <> ''), lambda s: chr(10) || '    - ' || s), '') ELSE '' END {_SECTION_END} AS text FROM documents""")
def resume_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_as_resumes(spark, sf_dir).select("id", resumes.as_text(F.col("resume")).alias("text"))


@query(f"""WITH e AS (SELECT doc_id, text, [source, '2020 - Present', lang] || CASE WHEN text <> '' THEN list_transform({_bullets_sql("text")}, lambda b: '• ' || b) ELSE [] END AS xs, string_split(text, ' ') AS ss FROM documents),
 x AS (SELECT doc_id, unnest(xs) AS text, unnest(range(len(xs))) AS i FROM e), k AS (SELECT doc_id, unnest(ss) AS text, unnest(range(len(ss))) AS i FROM e)
 SELECT doc_id AS id, CAST(0 AS INTEGER) AS "order", 'head' AS section, CAST(0 AS INTEGER) AS seq, CAST(0 AS INTEGER) AS col, 'Person ' || doc_id AS text FROM documents UNION ALL SELECT doc_id, 0, 'head', 1, 0, 'p' || doc_id || '@example.com' FROM documents
 UNION ALL SELECT doc_id, 1, 'summary', 0, 0, text FROM documents WHERE text <> '' UNION ALL SELECT doc_id, 3, 'experience', CAST(i AS INTEGER), 0, text FROM x
 UNION ALL SELECT doc_id, 2, 'skills', CAST(i // 3 AS INTEGER), CAST(i % 3 AS INTEGER), '• ' || text FROM k""")
def resume_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resumes.layout_rows(_documents_as_resumes(spark, sf_dir))


@query(r"SELECT page_id, replace(url, 'http', 'x:jobPosting:y:') AS urn, string_split(replace(url, 'http', 'x:jobPosting:y:'), ':')[4] AS job_id FROM pages")
def posting_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    urn = F.replace("url", F.lit("http"), F.lit("x:jobPosting:y:"))
    return table(spark, sf_dir, "pages").select("page_id", urn.alias("urn"), text.posting_number(urn).alias("job_id"))


@query()
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text_of(F.col("html")).alias("text"))


#: Pages and their texts: {0} is an order's status, {1} its key.
_AUTHORED = [("<html><head><style>p{{}}</style><script>var x = '<p>';</script></head><body><div><h1>{0} &amp; co</h1>  <p>Part\n {1}</p>tail<br/>", "{0} & co\nPart {1}\ntail\n"), ("<ul><li>one {1}</li><li></li></ul><b>bold</b> <i>{0}</i></div></body>", "one {1}\nbold {0}"), ("<div>" * 1500 + "deep {0}", "deep {0}")]


def _authored(which: int, column: int) -> str:
    """SQL of a page (0) or its text (1), made of orders, that both engines can read."""
    made = _AUTHORED[which][column].format("\0", "\1")
    parts = []
    for piece in re.split("([\0\1\n])", made):
        if piece:
            parts.append({"\0": "o_orderstatus", "\1": "CAST(o_orderkey AS VARCHAR(20))", "\n": "chr(10)"}.get(piece) or "'" + piece.replace("'", "''") + "'")
    return " || ".join(parts).replace("{{}}", "{}")


def _authored_sql(column: int) -> str:
    return f"CASE WHEN o_orderkey % 100 = 7 THEN {_authored(2, column)} ELSE {_authored(0, column)} || {_authored(1, column)} END"


@query(f"SELECT o_orderkey, {_authored_sql(1)} AS text FROM orders")
def authored_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of written pages: blocks, line breaks, scripts, entities and deep nesting."""
    return table(spark, sf_dir, "orders").select("o_orderkey", text_of(F.expr(_authored_sql(0))).alias("text"))


_OPTIONS = [None, "true", "false", "null_value", "maybe"]
_OPTION_SQL = {None: "true", "true": "is_interested IS TRUE", "false": "is_interested IS FALSE", "null_value": "is_interested IS NULL", "maybe": "false"}
_OPTIONS_SQL = " UNION ALL ".join(
    f"(SELECT '{o}' AS option, job_id, row_number() OVER (ORDER BY {_TOP_ORDER}, job_id) AS rn FROM {_TOP} AND resume_score BETWEEN 20 AND 95 AND {w} AND (job_title ILIKE '%g_z%' OR company ILIKE '%g_z%') QUALIFY rn <= 15)" for o, w in _OPTION_SQL.items()
)


@query(f"{_BOTH} {_OPTIONS_SQL}")
def top_scored_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a search with a wild card, for every choice of interest."""
    resumes_ = derived.customized_resumes(spark, sf_dir)
    pages = [listings.top_scored_jobs(_slim(spark, sf_dir), resumes_, 1, 15, least=20, most=95, interested=o, search="g_z").select(F.lit(str(o)).alias("option"), "job_id", "rn") for o in _OPTIONS]
    return reduce(DataFrame.union, pages)


@query(f"{_JOBS} SELECT CAST(5 AS BIGINT) AS size, job_id, row_number() OVER (ORDER BY scraped_at ASC NULLS LAST, job_id) AS rn FROM jobs WHERE is_active AND resume_score IS NULL QUALIFY rn <= 5")
def limit_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work lists of five, none and less than none: only the first has rows."""
    pages = [listings.jobs_to_score(_slim(spark, sf_dir), n).select(F.lit(n).cast("long").alias("size"), "job_id", "rn") for n in (5, 0, -3)]
    return reduce(DataFrame.union, pages)


@query(f"{_JOBS} SELECT option, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT {o} AS option FROM jobs WHERE {w}" for o, w in (("'any'", "true"), ("'empty'", "job_title IS NOT NULL OR company IS NOT NULL"), ("'percent'", "job_title ILIKE '%o%t%' OR company ILIKE '%o%t%'"), ("'under'", "job_title ILIKE '%g_ar%' OR company ILIKE '%g_ar%'"))) + ") GROUP BY option")
def search_wild_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _slim(spark, sf_dir).select("job_title", "company")
    asked = {"any": None, "empty": "", "percent": "o%t", "under": "g_ar"}
    marks = F.array_compact(F.array(*[F.when(text.search_matches(q, F.col("job_title"), F.col("company")), o) for o, q in asked.items()]))
    return rows.select(F.explode(marks).alias("option")).groupBy("option").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS id, c_name AS name, lower(c_name) || '@example.com' AS email, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) END AS phone, 'Nation ' || c_nationkey AS location, c_mktsegment AS summary,
 array_to_string(string_split(c_mktsegment, 'I'), '|') AS skills, CAST(NULL AS VARCHAR) AS education, CASE WHEN c_custkey % 2 = 0 THEN 'en|de' END AS languages, CAST(NULL AS TIMESTAMP) AS created_at, TIMESTAMP '1998-01-01 00:00:00' AS parsed_at
 FROM customer WHERE lower(c_name) || '@example.com' = (SELECT lower(c_name) || '@example.com' FROM customer WHERE c_custkey = 12)""")
def resume_by_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns; those of nested parts as text."""
    found = listings.resume_by_email(derived.resumes(spark, sf_dir), _EMAIL)
    return found.select("id", "name", "email", "phone", "location", "summary", F.array_join("skills", "|").alias("skills"), F.to_json("education").alias("education"), F.array_join("languages", "|").alias("languages"), "created_at", "parsed_at")


_EMAIL = "customer#000000012@example.com"


@query("""SELECT c_name AS name, lower(c_name) || '@example.com' AS email, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) END AS phone, 'Nation ' || c_nationkey AS location, c_mktsegment AS summary,
 array_to_string(string_split(c_mktsegment, 'I'), '|') AS skills, CAST(NULL AS VARCHAR) AS education, CAST(NULL AS VARCHAR) AS experience, CAST(NULL AS VARCHAR) AS projects, CAST(NULL AS VARCHAR) AS certifications,
 CASE WHEN c_custkey % 2 = 0 THEN 'en|de' END AS languages, CAST(NULL AS VARCHAR) AS links FROM customer WHERE c_custkey = 12""")
def resume_fields_by_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve parts; nested ones as text."""
    found = listings.resume_by_email(derived.resumes(spark, sf_dir), _EMAIL, listings.RESUME_PARTS)
    flat = {"skills": F.array_join("skills", "|"), "languages": F.array_join("languages", "|")}
    return found.select(*[flat.get(c, F.to_json(c) if c in ("education", "experience", "projects", "certifications", "links") else F.col(c)).alias(c) for c in found.columns])


def _search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured search pages: a search for each customer, four pages of an order key each; some broken, some in a ring, some not linked."""
    key = F.col("c_custkey")
    url = lambda n: F.concat(F.lit("http://x/"), key.cast("string"), F.lit("?page="), n.cast("string"))
    rows = table(spark, sf_dir, "customer").select(key, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("page"))
    following = F.when((key % 7 == 3) & (F.col("page") == 1), None).when((key % 7 == 4) & (F.col("page") == 2), url(F.lit(0))).when(F.col("page") < 3, url(F.col("page") + 1))
    item = F.struct(F.concat_ws("-", F.lit("new"), key.cast("string"), F.col("page").cast("string")).alias("uuid"), F.concat(F.lit("Job "), (key % 10).cast("string")).alias("title"), F.struct(F.concat(F.lit("Firm "), (key % 40).cast("string")).alias("name")).alias("postedCompany"))
    body = F.to_json(F.struct(F.array(item, item).alias("results"), F.lit(8).alias("total"), F.struct(F.struct(following.alias("href")).alias("next")).alias("_links")))
    body = F.when((key % 7 == 5) & (F.col("page") == 2), "{broken").otherwise(body)
    return rows.select(key.cast("string").alias("search"), url(F.col("page")).alias("url"), (F.col("page") == 0).alias("first"), body.alias("body"))


_FOLLOWED_SQL = "followed AS (SELECT c_custkey, p, 'new-' || c_custkey || '-' || p AS job_id, 'Firm ' || (c_custkey % 40) AS company, 'Job ' || (c_custkey % 10) AS job_title FROM customer, (SELECT unnest(range(4)) AS p) WHERE p <= CASE c_custkey % 7 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 3 END)"


@query(f"WITH {_FOLLOWED_SQL} SELECT CAST(c_custkey AS VARCHAR) AS search, CAST(p AS BIGINT) AS hop, job_id, company, job_title, CAST(2 AS BIGINT) AS n FROM followed")
def followed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of JSON search pages by their next links; each stands twice on its page."""
    items = captured.follow_pages(_search_pages(spark, sf_dir))
    item = F.col("item")
    rows = items.select("search", F.col("hop").cast("long"), item["uuid"].alias("job_id"), captured.company_name(item).alias("company"), item["title"].alias("job_title"))
    return rows.groupBy("search", "hop", "job_id", "company", "job_title").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type || '|u' || user_id WHEN 2 THEN '' END AS ids FROM events")
def skill_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of suggested skills, in answers where some skills have none."""
    key, join = F.col("event_id") % 4, F.concat
    one = join(F.lit('{"skills": [{"uuid": "'), "event_type", F.lit('"}'))
    body = F.when(key == 0, join(one, F.lit(', {"skill": "x"}]}'))).when(key == 1, join(one, F.lit(', {"uuid": "u'), F.col("user_id").cast("string"), F.lit('"}]}'))).when(key == 2, '{"skills": []}').otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(captured.skill_ids(F.from_json(body, captured.ITEM)), "|").alias("ids"))


@query(rf"SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 10 = 0 THEN '' ELSE {_TRIM_SQL.format('text')} END AS text FROM documents")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of stored documents, a page for each line; some can't be read."""
    content = F.when(F.col("doc_id") % 10 == 0, F.unhex(F.lit("FF00"))).otherwise(F.col("text").cast("binary"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return captured.document_texts(files, lambda raw: raw.decode().split("\n"))


@query("SELECT * FROM (VALUES ('analyse_limit', 200), ('check_limit', 50), ('deletion_days', 60), ('expiry_days', 30), ('generate_limit', 2), ('keyword_batch', 10), ('recheck_days', 3), ('score_limit', 10), ('write_chunk', 500)) t(name, value)")
def settings_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operating limits; ``sf_dir`` doesn't matter."""
    return spark.createDataFrame([(f.name, getattr(SETTINGS, f.name)) for f in fields(SETTINGS) if f.name != "as_of"], "name string, value int")


_DIGEST_SQL = """sha256('{"name":"' || c_name || '","email":"' || c_mktsegment || '@x","resume_link":"l' || c_custkey || '"}')"""


@query(f"""SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id, c_name AS name, c_mktsegment || '@x' AS email, CAST(NULL AS VARCHAR) AS summary,
 'l' || c_custkey AS resume_link, {_NOW} AS created_at, {_NOW} AS last_updated FROM (SELECT *, {_DIGEST_SQL} AS h FROM customer)""")
def custom_resumes_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tailored résumés added to an empty store, twice: the second run adds nothing."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.concat("c_mktsegment", F.lit("@x")).alias("email"), F.concat(F.lit("l"), F.col("c_custkey").cast("string")).alias("resume_link"))
    once = merge.insert_custom_resumes(spark.createDataFrame([], CUSTOM_RESUMES), rows, SETTINGS.as_of)
    return merge.insert_custom_resumes(once, rows, SETTINGS.as_of).select("id", "name", "email", "summary", "resume_link", "created_at", "last_updated")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS job_id, 's3://bucket/cv/personalized_' || o_orderkey || '.pdf' AS address FROM orders")
def document_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(key.alias("job_id"), merge.file_address("s3://bucket/cv/", key).alias("address"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0 THEN '.' || strftime(ts, '%f') ELSE '' END || '+00:00' AS rendered FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) ELSE ts END AS ts FROM events)")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("event_id") % 3 == 0, F.date_trunc("second", F.col("ts").cast("timestamp"))).otherwise(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", text.iso_utc(at).alias("rendered"))


@query("SELECT doc_id, substr(text, 1, 70) AS short, substr(text, 1, 500) AS longer FROM documents")
def shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", text.shorten(F.col("text"), 70).alias("short"), text.shorten(F.col("text"), 500).alias("longer"))


@query("SELECT p_partkey, replace(p_name, ' ', '%2B') || '%2B%26%2B' || replace(p_brand, '#', '%23') AS query FROM part")
def query_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.query_string(F.concat("p_name", F.lit(" & "), "p_brand")).alias("query"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS name, CASE WHEN c_custkey % 3 < 2 THEN c_mktsegment || '|x' END AS skills, CASE WHEN c_custkey % 3 = 1 THEN 'BSc' END AS degree FROM customer")
def parsed_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Résumés parsed from texts, some of which lack an email."""
    key = F.col("c_custkey") % 3
    given = F.struct(F.col("c_name").alias("name"), F.when(key < 2, "a@x").alias("email"), F.array("c_mktsegment", F.lit("x")).alias("skills"), F.when(key == 1, F.array(F.struct(F.lit("BSc").alias("degree")))).alias("education"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", plugins.json_resume(F.to_json(given)).alias("r"))
    return rows.select("c_custkey", "r.name", F.array_join("r.skills", "|").alias("skills"), F.col("r.education")[0]["degree"].alias("degree"))


_EXTRA = "zyzzyva"


@query(rf"""WITH w AS (SELECT doc_id, text, {_WORDS_SQL.format("text")} AS ws, string_split(text, ' ') AS ss, text <> '' AND doc_id % 4 = 1 AS bad1, source <> '' AND doc_id % 4 = 2 AS bad2, doc_id % 6 = 3 AS bad4 FROM documents),
 v AS (SELECT *, CASE WHEN bad1 THEN 'summary' WHEN bad2 THEN 'experience' WHEN bad4 THEN 'skills' END AS failed FROM w)
 SELECT CAST(doc_id AS VARCHAR) AS job_id, failed IS NULL AS valid, failed, CASE WHEN failed IS NULL THEN CASE WHEN len(ws) > 60 THEN regexp_replace(array_to_string(ws[1:60], ' '), '[,;]+$', '') || '...' ELSE text END END AS summary,
 CASE WHEN failed IS NULL THEN array_to_string(list_reverse(ss)[1:12], '|') END AS skills, CASE WHEN failed IS NULL THEN CASE WHEN text <> '' THEN {_CUT_BULLETS_SQL} ELSE text END END AS description FROM v""")
def tailored_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four sections edited and checked; a section that gains a word stops its job."""
    rows = _documents_as_resumes(spark, sf_dir).select(F.col("id").cast("string").alias("job_id"), "id", "resume", F.lit("").alias("description"))
    more = lambda s, _: F.when(F.col("id") % 4 == 1, F.concat(s, F.lit(f" {_EXTRA}"))).otherwise(s)
    edits = {
        "summary": more, "experience": lambda s, _: F.transform(s, lambda e: e.withField("job_title", F.when(F.col("id") % 4 == 2, F.concat(e["job_title"], F.lit(f" {_EXTRA}"))).otherwise(e["job_title"]))),
        "projects": plugins.keep_section, "skills": lambda s, _: F.when(F.col("id") % 6 == 3, F.array_append(s, F.lit(_EXTRA))).otherwise(F.reverse(s)),
    }
    out = resumes.tailor(rows, F.col("resume"), edits, plugins.same_words)
    return out.select("job_id", "valid", "failed", "resume.summary", F.array_join("resume.skills", "|").alias("skills"), F.element_at("resume.experience", 1)["description"].alias("description"))


_INGESTED = "job_id, company, job_title, level, location, description, status, is_active, scraped_at, resume_score_stage, provider"
_STORED_SQL_JOBS = f"stored AS (SELECT {_INGESTED} FROM jobs WHERE {_NUMBER} % 4 < 3)"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.jobs(spark, sf_dir).where(F.col("job_id").cast("long") % 4 < 3).select(*_INGESTED.split(", "))


@query(f"""{_JOBS}, {_STORED_SQL_JOBS} SELECT * FROM stored UNION ALL
 SELECT CAST(o_orderkey AS VARCHAR), 'Acme', o_orderpriority, NULL, NULL, 'Do ' || o_orderstatus, 'new', true, {_NOW}, 'initial', 'linkedin' FROM orders WHERE o_orderkey % 4 = 3 AND o_orderkey % 5 < 4 AND o_orderkey % 6 <> 1""")
def ingested_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From HTML search pages to saved postings; some have no details, some no description."""
    key, join = F.col("o_orderkey"), F.concat
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 4 >= 2")
    search = orders.select(join(F.lit('<li><div class="base-card" data-entity-urn="urn:li:jobPosting:'), key.cast("string"), F.lit('"></div></li>')).alias("html"))
    body = F.when(key % 6 == 1, "").otherwise(join(F.lit("Do "), "o_orderstatus"))
    detail = join(F.lit('<a class="topcard__org-name-link">Acme</a><h1 class="top-card-layout__title">'), "o_orderpriority", F.lit('</h1><div class="show-more-less-html__markup">'), body, F.lit("</div>"))
    details = orders.where(key % 5 < 4).select(key.cast("string").alias("job_id"), detail.alias("html"))
    return flows.ingest_html(search, details, _stored(spark, sf_dir), SETTINGS.as_of)


@query(f"""{_JOBS}, {_STORED_SQL_JOBS}, {_FOLLOWED_SQL}, fresh AS (SELECT * FROM followed WHERE NOT (c_custkey % 40 < 10))
 SELECT * FROM stored UNION ALL SELECT CAST(c_custkey AS VARCHAR) || '-old', 'Firm ' || (c_custkey % 40), 'job ' || (c_custkey % 10) || ' ', NULL, NULL, NULL, 'new', true, {_NOW}, 'initial', NULL FROM customer WHERE c_custkey % 40 < 10
 UNION ALL SELECT job_id, company, job_title, 'Not applicable', 'Singapore', 'Do ' || job_id, 'new', true, {_NOW}, 'initial', 'careers_future' FROM fresh WHERE p <> 1""")
def ingested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From JSON search pages to saved postings; some are stored under another id, some have no description."""
    key = F.col("c_custkey")
    old = table(spark, sf_dir, "customer").where(key % 40 < 10).select(F.concat(key.cast("string"), F.lit("-old")).alias("job_id"), F.concat(F.lit("Firm "), (key % 40).cast("string")).alias("company"), F.concat(F.lit("job "), (key % 10).cast("string"), F.lit(" ")).alias("job_title"))
    state = merge.upsert_jobs(_stored(spark, sf_dir), old, SETTINGS.as_of)
    pages = _search_pages(spark, sf_dir)
    number = F.regexp_extract("url", "page=([0-9]+)", 1)
    item = F.struct(F.concat_ws("-", F.lit("new"), "search", number).alias("uuid"), F.concat(F.lit("Job "), (F.col("search").cast("long") % 10).cast("string")).alias("title"), F.struct(F.concat(F.lit("Firm "), (F.col("search").cast("long") % 40).cast("string")).alias("name")).alias("postedCompany"), F.when(number != "1", F.concat(F.lit("<p>Do new-"), "search", F.lit("-"), number, F.lit("</p>"))).alias("description"))
    return flows.ingest_json(pages, pages.select(F.to_json(item).alias("body")), state, SETTINGS.as_of)


_ROUND = 40
_ROUND_STATE = "job_id, job_title, is_active, job_state, status, resume_score, resume_score_stage, is_interested, customized_resume_id, company, level, scraped_at"
_SHARE_SQL = "CASE WHEN description IS NOT NULL AND description <> '' THEN CAST(len(list_filter(ws, lambda w: list_contains({}, w))) * 100 // len(ws) AS SMALLINT) END"
_WORK_SQL = "list_distinct(list_filter(string_split_regex(lower(job_title || ' ' || description), '\\s+'), lambda w: w <> ''))"


@query(f"""{_JOBS}, work AS (SELECT job_id, description, {_WORK_SQL} AS ws, row_number() OVER (ORDER BY scraped_at ASC NULLS LAST, job_id) AS rn FROM jobs WHERE is_active AND resume_score IS NULL QUALIFY rn <= {_ROUND}),
 scored AS (SELECT job_id, {_SHARE_SQL.format("['the', 'and', 'of', 'la', 'de', 'und']")} AS s FROM work)
 SELECT job_id, coalesce(s, resume_score) AS resume_score, CASE WHEN s IS NOT NULL THEN 'initial' ELSE resume_score_stage END AS resume_score_stage FROM jobs LEFT JOIN scored USING (job_id)""")
def scored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = derived.jobs(spark, sf_dir).select("job_id", "description")
    out = flows.score_round(_slim(spark, sf_dir).select(*_ROUND_STATE.split(", ")), texts, F.lit("The and OF la de und"), plugins.overlap_score, _ROUND)
    return out.select("job_id", "resume_score", "resume_score_stage")


@query(f"""{_BOTH}, work AS (SELECT job_id, description, cr.id AS rid, {_WORK_SQL} AS ws, row_number() OVER (ORDER BY resume_score DESC NULLS FIRST, job_id) AS rn FROM {_RESCORE_FROM} QUALIFY rn <= {_ROUND}),
 scored AS (SELECT job_id, {_SHARE_SQL.format("list_distinct(list_filter(string_split_regex(lower(d.text), '\\s+'), lambda x: x <> ''))")} AS s FROM work JOIN documents d ON rid = CAST(d.doc_id AS VARCHAR) WHERE d.text <> '')
 SELECT job_id, coalesce(s, resume_score) AS resume_score, CASE WHEN s IS NOT NULL THEN 'custom' ELSE resume_score_stage END AS resume_score_stage FROM jobs LEFT JOIN scored USING (job_id)""")
def rescored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by the tailored résumé's own text: here the document with its number."""
    texts = derived.jobs(spark, sf_dir).select("job_id", "description")
    own = derived.customized_resumes(spark, sf_dir).join(_texts(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text"), "id")
    out = flows.rescore_round(_slim(spark, sf_dir).select(*_ROUND_STATE.split(", ")), own, texts, plugins.overlap_score, _ROUND)
    return out.select("job_id", "resume_score", "resume_score_stage")
