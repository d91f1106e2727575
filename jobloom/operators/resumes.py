"""Résumés: content budget, plain text, layout rows, and the tailoring and scoring steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PROJECTS, ROLES, SKILLS, budget_bullets, parse_score, split_bullets, strip, trim_summary
from .plugins import Scorer, SectionCheck, SectionEditor, all_valid


def fit_budget(resume: Column) -> Column:
    """A résumé cut to two pages: summary, skills, roles, projects and their bullets."""
    experience = F.transform(F.slice(resume["experience"], 1, ROLES), lambda e: e.withField("description", budget_bullets(e["description"])))
    projects = F.transform(F.slice(resume["projects"], 1, PROJECTS), lambda p: p.withField("description", budget_bullets(p["description"])))
    return resume.withField("summary", trim_summary(resume["summary"])).withField("skills", F.slice(resume["skills"], 1, SKILLS)).withField("experience", experience).withField("projects", projects)


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _or(text: Column, other: str) -> Column:
    return F.coalesce(text, F.lit(other))


def _section(name: str, body: Column, there: Column) -> Column:
    return F.when(there, F.concat(F.lit(f"{name}:\n"), body, F.lit("\n\n---\n")))


def _some(items: Column) -> Column:
    return F.coalesce(F.size(items) > 0, F.lit(False))


def as_text(resume: Column) -> Column:
    """Sections of plain text; empty ones are left out."""
    r = resume
    links = F.concat_ws(", ", *[F.concat(F.lit(f"{n}: "), _filled(r["links"][n])) for n in ("linkedin", "github", "portfolio")])
    basic = F.concat_ws(
        "\n", F.concat(F.lit("Name: "), _or(r["name"], "N/A")), F.concat(F.lit("Email: "), _or(r["email"], "N/A")), F.concat(F.lit("Phone: "), _filled(r["phone"])),
        F.concat(F.lit("Location: "), _filled(r["location"])), F.concat(F.lit("Links: "), _filled(links)), F.lit("\n---\n"),
    )

    def role(e: Column) -> Column:
        lines = F.filter(F.transform(F.split(e["description"], "\n"), strip), lambda s: s != "")
        body = F.array_join(F.transform(lines, lambda s: F.concat(F.lit("\n    - "), s)), "")
        return F.concat_ws(
            "\n", F.concat(F.lit("\n* "), _or(e["job_title"], "N/A"), F.lit(" at "), _or(e["company"], "N/A")), F.concat(F.lit("  Location: "), _filled(e["location"])),
            F.concat(F.lit("  Dates: "), _or(e["start_date"], "?"), F.lit(" - "), _or(e["end_date"], "Present")), F.when(_filled(e["description"]).isNotNull(), F.concat(F.lit("  Description:"), body)),
        )

    def degree(e: Column) -> Column:
        head = F.concat(F.lit("\n* "), _or(e["degree"], "N/A"), F.coalesce(F.concat(F.lit(", "), _filled(e["field_of_study"])), F.lit("")), F.lit(" from "), _or(e["institution"], "N/A"))
        return F.concat(head, F.lit("\n  Years: "), _or(e["start_year"], "?"), F.lit(" - "), _or(e["end_year"], "Present"))

    def project(p: Column) -> Column:
        techs = F.when(_some(p["technologies"]), F.concat(F.lit("  Technologies: "), F.array_join(p["technologies"], ", ")))
        return F.concat_ws("\n", F.concat(F.lit("\n* "), _or(p["name"], "N/A")), F.concat(F.lit("  Description: "), _filled(p["description"])), techs)

    def certificate(c: Column) -> Column:
        issuer, year = F.concat(F.lit(" ("), _filled(c["issuer"]), F.lit(")")), F.concat(F.lit(" - "), _filled(c["year"]))
        return F.concat(F.lit("* "), _or(c["name"], "N/A"), F.coalesce(issuer, F.lit("")), F.coalesce(year, F.lit("")))

    def listed(items: Column, show) -> Column:  # noqa: ANN001
        return F.array_join(F.transform(items, show), "\n")

    return F.when(r.isNull(), "Resume data is not available.").otherwise(
        F.concat_ws(
            "\n", basic, _section("Summary", r["summary"], _filled(r["summary"]).isNotNull()), _section("Skills", F.array_join(r["skills"], ", "), _some(r["skills"])),
            _section("Experience", listed(r["experience"], role), _some(r["experience"])), _section("Education", listed(r["education"], degree), _some(r["education"])),
            _section("Projects", listed(r["projects"], project), _some(r["projects"])), _section("Certifications", listed(r["certifications"], certificate), _some(r["certifications"])),
            _section("Languages", F.array_join(r["languages"], ", "), _some(r["languages"])),
        )
    )


def date_range(start: Column, end: Column) -> Column:
    s, e = _filled(start), _filled(end)
    return F.coalesce(F.concat(s, F.lit(" - "), e), F.concat(s, F.lit(" - Present")), F.lit(""))


def year_range(start: Column, end: Column) -> Column:
    s, e = _filled(start), _filled(end)
    return F.coalesce(F.concat(s, F.lit(" - "), e), F.concat(F.lit("Started "), s), F.concat(F.lit("Graduated "), e), F.lit(""))


def layout_bullets(text: Column) -> Column:
    """Each bullet with one sign before it."""
    return F.transform(split_bullets(text), lambda b: F.concat(F.lit("• "), b))


def layout_rows(resumes: DataFrame) -> DataFrame:
    """(id, section, seq, col, text) of a column ``resume``, in the order of the printed sections.

    Skills stand in three columns, filled row by row; rendering is left to the caller.
    """
    r = F.col("resume")

    def rows(section: int, name: str, texts: Column, width: int = 1) -> Column:
        place = lambda t, i: F.struct(F.lit(section).alias("order"), F.lit(name).alias("section"), F.floor(i / width).cast("int").alias("seq"), (i % width).cast("int").alias("col"), t.alias("text"))
        return F.coalesce(F.transform(texts, place), F.array().cast("array<struct<order:int,section:string,seq:int,col:int,text:string>>"))

    head = F.filter(F.array(r["name"], F.concat_ws(" | ", _filled(r["email"]), _filled(r["phone"]), _filled(r["location"]))), lambda t: t != "")

    def role(e: Column) -> Column:
        place = F.when(_filled(e["company"]).isNotNull(), F.concat_ws(" | ", e["company"], _filled(e["location"]))).otherwise("")
        return F.concat(F.array(e["job_title"], date_range(e["start_date"], e["end_date"]), place), F.coalesce(layout_bullets(_filled(e["description"])), F.array().cast("array<string>")))

    def degree(e: Column) -> Column:
        title = F.concat(e["degree"], F.coalesce(F.concat(F.lit(", "), _filled(e["field_of_study"])), F.lit("")))
        return F.array(title, year_range(e["start_year"], e["end_year"]), e["institution"])

    def project(p: Column) -> Column:
        return F.concat(F.array(p["name"], F.array_join(F.coalesce(p["technologies"], F.array().cast("array<string>")), ", ")), F.coalesce(layout_bullets(_filled(p["description"])), F.array().cast("array<string>")))

    every = F.concat(
        rows(0, "head", head), rows(1, "summary", F.filter(F.array(r["summary"]), lambda t: t != "")), rows(2, "skills", F.transform(r["skills"], lambda s: F.concat(F.lit("• "), s)), 3),
        rows(3, "experience", F.flatten(F.transform(r["experience"], role))), rows(4, "education", F.flatten(F.transform(r["education"], degree))),
        rows(5, "projects", F.flatten(F.transform(r["projects"], project))),
        rows(6, "certifications", F.transform(r["certifications"], lambda c: F.concat_ws(" - ", c["name"], _filled(c["issuer"]), _filled(c["year"])))), rows(7, "languages", F.filter(F.array(F.array_join(r["languages"], ", ")), lambda t: t != "")),
    )
    return resumes.select("id", F.inline(every))


def score_jobs(jobs: DataFrame, resume_text: Column, scorer: Scorer) -> DataFrame:
    """(job_id, resume_score): whole numbers from 0 to 100, null if the scorer failed."""
    return jobs.select("job_id", parse_score(scorer(resume_text, F.col("job_title"), F.col("description")).cast("string")).alias("resume_score"))


#: Sections that are tailored, in their order, and how their text reads.
TAILORED = ("summary", "experience", "projects", "skills")


def section_text(name: str, section: Column) -> Column:
    """The words of a section, for its check."""
    if name == "summary":
        return section
    if name == "skills":
        return F.array_join(section, " ")
    parts = ("job_title", "company", "description") if name == "experience" else ("name", "description")
    return F.array_join(F.transform(section, lambda e: F.concat_ws(" ", *[e[p] for p in parts])), " ")


def tailor(jobs: DataFrame, resume: Column, edits: dict[str, SectionEditor], check: SectionCheck) -> DataFrame:
    """(job_id, resume, valid, failed): the résumé with its edited sections under the budget.

    The sections are edited and checked in the order of ``TAILORED``; an empty section, or one without an
    editor, stays. The first that fails its check stops the job: it has no résumé, and ``failed`` names it.
    """
    edited, passed, failed = resume, [], F.lit(None).cast("string")
    for name in TAILORED:
        if name in edits:
            old = resume[name]
            there = F.coalesce(section_text(name, old) != "", F.lit(False)) if name == "summary" else _some(old)
            new = F.when(there, edits[name](old, F.col("description"))).otherwise(old)
            passed.append(F.when(there, check(section_text(name, new), section_text(name, old))).otherwise(F.struct(F.lit(True).alias("is_valid"), F.lit("").alias("reason"))))
            failed = F.coalesce(failed, F.when(~passed[-1]["is_valid"], name))
            edited = edited.withField(name, new)
    valid = all_valid(F.array(*passed)) if passed else F.lit(True)
    return jobs.select("job_id", F.when(valid, fit_budget(edited)).alias("resume"), valid.alias("valid"), failed.alias("failed"))
