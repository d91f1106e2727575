"""Schemas of the stored tables and of nested résumé parts."""

from __future__ import annotations

from pyspark.sql import types as T

S, B, TS = T.StringType(), T.BooleanType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType] | str) -> T.StructType:
    return T.StructType([T.StructField(*((f, S) if isinstance(f, str) else f)) for f in fields])


EDUCATION = _struct("degree", "field_of_study", "institution", "start_year", "end_year")
EXPERIENCE = _struct("job_title", "company", "location", "start_date", "end_date", "description")
PROJECT = _struct("name", "description", ("technologies", T.ArrayType(S)))
CERTIFICATION = _struct("name", "issuer", "year")
LINKS = _struct("linkedin", "github", "portfolio")
KEYWORDS = T.ArrayType(_struct("keyword", "category"))
VALIDATION = _struct(("is_valid", B), "reason")

_PERSON = ["name", "email", "phone", "location", "summary"]
_PARTS = [
    ("skills", T.ArrayType(S)),
    ("education", T.ArrayType(EDUCATION)),
    ("experience", T.ArrayType(EXPERIENCE)),
    ("projects", T.ArrayType(PROJECT)),
    ("certifications", T.ArrayType(CERTIFICATION)),
    ("languages", T.ArrayType(S)),
    ("links", LINKS),
]
#: A parsed résumé, also the schema for decoding one from JSON.
RESUME = _struct(*_PERSON, *_PARTS)
#: Answers that personalise one section, by section.
SECTIONS = {"summary": _struct("summary"), "skills": _struct(("skills", T.ArrayType(S))), "experience": _struct(("experience", EXPERIENCE)), "project": _struct(("project", PROJECT))}

JOBS = _struct(
    "job_id", "company", "job_title", "level", "location", "description", "status", ("is_active", B), ("application_date", TS), ("resume_score", T.ShortType()),
    "notes", ("scraped_at", TS), ("last_checked", TS), "job_state", "resume_score_stage", ("is_interested", B), "customized_resume_id", "provider", ("posted_at", TS),
    ("insights_analyzed_at", TS),
)
#: Values of columns that an insert doesn't name; the two clock columns take the time of the write.
JOB_DEFAULTS = {"status": "new", "is_active": True, "job_state": "new", "resume_score_stage": "initial"}
JOB_CLOCK_DEFAULTS = ("scraped_at", "last_checked")
CUSTOM_RESUMES = _struct("id", *_PERSON, *_PARTS, ("created_at", TS), ("last_updated", TS), "resume_link")
RESUMES = _struct(("id", T.LongType()), *_PERSON, *_PARTS, ("created_at", TS), ("parsed_at", TS))
KEYWORD_INSIGHTS = _struct("keyword", "category", ("count", T.LongType()), ("last_updated", TS))
PAGES = _struct("job_id", ("http_status", T.IntegerType()), "body", "error")

_NAMED = _struct("name")
#: An item of the JSON search, and a page of it.
ITEM = _struct(
    "uuid", "title", "description", ("hiringCompany", _NAMED), ("postedCompany", _NAMED), ("positionLevels", T.ArrayType(_struct("position"))),
    ("metadata", _struct("createdAt")), ("skills", T.ArrayType(_struct("uuid"))),
)
SEARCH_PAGE = _struct(("results", T.ArrayType(ITEM)), ("total", T.LongType()), ("_links", _struct(("next", _struct("href")))))
