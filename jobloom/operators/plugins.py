"""Interfaces for steps that call outside services, with deterministic stand-ins.

A stand-in makes the surrounding relational steps testable; it doesn't imitate a service's quality.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import words
from ..schema import KEYWORDS, RESUME


class TextTransform(Protocol):
    """Text to Markdown; empty stays empty, a failure is null."""

    def __call__(self, text: Column) -> Column: ...


class Scorer(Protocol):
    """Fit of a résumé text to a posting, 0 to 100; null without a description or on failure."""

    def __call__(self, resume: Column, title: Column, description: Column) -> Column: ...


class KeywordTagger(Protocol):
    """Array of (keyword, category) in a description; a failure is null, nothing found an empty array."""

    def __call__(self, description: Column) -> Column: ...


class ResumeParser(Protocol):
    """Résumé text to the structure of ``schema.RESUME``."""

    def __call__(self, text: Column) -> Column: ...


class SectionEditor(Protocol):
    """A section rewritten for a posting; on any failure the section as it was."""

    def __call__(self, section: Column, description: Column) -> Column: ...


class SectionCheck(Protocol):
    """struct<is_valid, reason> of an edited section against the original; a failure is not valid."""

    def __call__(self, edited: Column, original: Column) -> Column: ...


def plain_markdown(text: Column) -> Column:
    """Lines without white space at their ends, and no more than one empty line in a row."""
    lines = F.regexp_replace(text, r"[ \t]+(?=\n|$)", "")
    return F.regexp_replace(lines, r"\n{3,}", "\n\n")


def overlap_score(resume: Column, title: Column, description: Column) -> Column:
    """Share of the posting's distinct words that the résumé has, in percent."""
    wanted = F.array_distinct(words(F.lower(F.concat_ws(" ", title, description))))
    had = F.array_intersect(wanted, words(F.lower(resume)))
    score = F.floor(F.size(had) * 100 / F.nullif(F.size(wanted), F.lit(0)))
    return F.when(description.isNotNull() & (description != ""), score.cast("short"))


def dictionary_tagger(terms: dict[str, str]) -> KeywordTagger:
    """Finds known terms, whole words in either case, longest first; ``terms`` maps term to category."""
    by_name = {t.lower(): (t, c) for t, c in terms.items()}
    names = sorted(by_name, key=lambda t: (-len(t), t))
    pattern = r"(?iuU)(?<!\w)(" + "|".join(rf"\Q{t}\E" for t in names) + r")(?!\w)"

    def tag(description: Column) -> Column:
        if not names:
            return F.when(description.isNotNull(), F.array().cast(KEYWORDS))
        known = F.create_map(*[x for t, (name, category) in by_name.items() for x in (F.lit(t), F.struct(F.lit(name).alias("keyword"), F.lit(category).alias("category")))])
        return F.transform(F.regexp_extract_all(description, F.lit(pattern), 1), lambda m: F.element_at(known, F.lower(m)))

    return tag


def json_resume(text: Column) -> Column:
    """Decodes a résumé that is already JSON; null if it isn't or lacks a name or an email."""
    parsed = F.from_json(text, RESUME, {"mode": "PERMISSIVE"})
    return F.when(parsed["name"].isNotNull() & parsed["email"].isNotNull(), parsed)


def keep_section(section: Column, description: Column) -> Column:
    return section


def same_words(edited: Column, original: Column) -> Column:
    """Valid if no word was added."""
    added = F.array_except(words(F.lower(edited)), words(F.lower(original)))
    valid = F.coalesce(F.size(added) == 0, F.lit(False))
    return F.struct(valid.alias("is_valid"), F.when(~valid, F.concat(F.lit("added: "), F.array_join(added, " "))).otherwise(F.lit("")).alias("reason"))


def all_valid(checks: Column) -> Column:
    """Whether every section of a job passed; one failure stops the whole job."""
    return F.forall(checks, lambda c: c["is_valid"])
