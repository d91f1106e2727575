"""Text functions that reproduce the string semantics of the stored rules, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations whose full stop doesn't end a sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "vs.", "Mr.", "Mrs.", "Ms.", "Dr.", "St.", "Ph.D.", "U.S.", "U.K.")
#: The content budget of a two-page résumé.
SUMMARY_WORDS, SKILLS, ROLES, BULLETS, BULLET_WORDS, PROJECTS = 60, 12, 5, 4, 20, 2


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalise(text: Column) -> Column:
    return F.lower(strip(text))


def title_case(text: Column) -> Column:
    """Each run of letters starts with a capital and goes on in lower case; ``initcap`` only looks at blanks."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 0)
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def parse_score(text: Column) -> Column:
    """A whole number from 0 to 100, else null."""
    value = strip(text).try_cast("int")
    return F.when(value.between(0, 100), value.cast("short"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _cap(text: Column, most: int, end: str, whole: Column) -> Column:
    short = F.regexp_replace(F.array_join(F.slice(words(text), 1, most), " "), "[,;]+$", "")
    return F.when(F.size(words(text)) > most, F.concat(short, F.lit(end))).otherwise(whole)


def trim_bullet(text: Column) -> Column:
    """At most 20 words; a cut bullet loses commas and semicolons at its end and gets a full stop."""
    return _cap(text, BULLET_WORDS, ".", strip(text))


def trim_summary(text: Column) -> Column:
    return _cap(text, SUMMARY_WORDS, "...", text)


#: A full stop and a blank, unless an abbreviation ends there.
_SENTENCE_END = "(?<!" + "|".join(re.escape(a[:-1]) for a in ABBREVIATIONS) + r")\. "


def split_bullets(text: Column) -> Column:
    """Lines without their bullet signs, or, for a single line, sentences that end in a full stop."""
    lines = F.transform(F.split(text, "\n"), lambda s: strip(F.regexp_replace(strip(s), "^[•-]+", "")))

    def sentence(s: Column) -> Column:
        return F.when(strip(s).rlike("[.!?]$"), strip(s)).otherwise(F.concat(strip(s), F.lit(".")))

    sentences = F.transform(F.filter(F.split(strip(text), _SENTENCE_END), lambda s: strip(s) != ""), sentence)
    return F.when(F.contains(text, F.lit("\n")), F.filter(lines, lambda s: s != "")).otherwise(sentences)


def budget_bullets(text: Column) -> Column:
    """A description as at most four trimmed bullets, one a line; null or empty stays."""
    kept = F.transform(F.slice(split_bullets(text), 1, BULLETS), lambda b: F.concat(F.lit("• "), trim_bullet(b)))
    return F.when(text != "", F.array_join(kept, "\n")).otherwise(text)


_FENCE = re.compile(r"```(?:json)?(.*?)```", re.DOTALL)
_MARK = re.compile(r'["\[\]{}]')
_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)


def first_balanced(text: str) -> str | None:
    """The first JSON-like array or object whose brackets match, in one pass; brackets in strings don't count."""
    open_at: list[tuple[str, int]] = []
    found: tuple[int, int] | None = None
    at = 0
    while mark := _MARK.search(text, at):
        at = mark.end()
        sign = mark[0]
        if sign == '"':
            quoted = _QUOTED.match(text, mark.start()) if open_at else None
            at = quoted.end() if quoted else at
        elif sign in "[{":
            open_at.append((sign, mark.start()))
        elif open_at and open_at[-1][0] + sign in ("[]", "{}"):
            start = open_at.pop()[1]
            # a span that starts before the one found holds it, or the one found stands in an open bracket
            found = (start, at) if found is None or start < found[0] else found
            if not open_at:
                return text[found[0] : found[1]]
        else:
            open_at.clear()
            if found:
                break
    return text[found[0] : found[1]] if found else None


def json_candidate(text: Column) -> Column:
    """The first JSON array or object of a fenced block, else of the whole text, else the stripped text."""

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            return next((x for part in (*_FENCE.findall(t), t) if (x := first_balanced(part))), t.strip())

        return texts.map(one)

    return found(text)


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text holds one of the phrases, upper or lower case; false for null."""
    low = F.lower(text)
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(low, F.lit(p.lower())) for p in phrases]), F.lit(False))


def search_matches(query: str | None, *columns: Column) -> Column:
    """ILIKE '%query%' on any column; ``%`` and ``_`` in the query act as wild cards, no query matches all."""
    if query is None:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [c.ilike(f"%{query}%") for c in columns])


def iso_utc(time: Column) -> Column:
    """ISO 8601 in UTC, with microseconds only where there are any; the session's time zone must be UTC."""
    whole, small = "yyyy-MM-dd'T'HH:mm:ss", F.date_format(time, "SSSSSS")
    return F.concat(F.date_format(time, whole), F.when(small != "000000", F.concat(F.lit("."), small)).otherwise(""), F.lit("+00:00"))


def shorten(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def query_string(text: Column) -> Column:
    """URL-encoded, with blanks as an encoded plus sign."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%2B"))


def posting_number(urn: Column) -> Column:
    """Fourth part of a URN that names a posting, else null."""
    return F.when(F.contains(urn, F.lit("jobPosting:")), F.try_element_at(F.split(urn, ":"), F.lit(4)))
