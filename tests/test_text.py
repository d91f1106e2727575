"""Column functions against plain Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from jobloom.functions import text

SAMPLES = [
    "", "  ", "a", "  Mixed\tCASE \n", "sap s/4hana", "bachelor's degree", "  python ", "ÉCOLE élan", "straße ßa", " nbsp　", "one two, three; ", "x" * 50,
    " ".join(f"w{i}" for i in range(20)), " ".join(f"w{i}" for i in range(21)), " ".join(["w"] * 19 + ["end,", "more"]), " ".join(["w"] * 19 + ["end.", "more"]),
]


def _apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.v for r in rows.select("i", f(F.col("s")).alias("v")).orderBy("i").collect()]


def _trim(s):
    w = s.split()
    return s.strip() if len(w) <= 20 else " ".join(w[:20]).rstrip(",;") + "."


@pytest.mark.parametrize(("f", "python"), [(text.strip, str.strip), (text.normalise, lambda s: s.strip().lower()), (text.title_case, str.title), (text.trim_bullet, _trim), (lambda c: F.array_join(text.words(c), "|"), lambda s: "|".join(s.split()))])
def test_like_python(spark, f, python):
    assert _apply(spark, f, SAMPLES) == [python(s) for s in SAMPLES]
    assert _apply(spark, f, [None]) == [None]


def test_scores(spark):
    given = ["85", " 85\n", "+85", "101", "-1", "85.", "85.5", "Score: 85", "", None, "0", "100"]
    assert _apply(spark, text.parse_score, given) == [85, 85, 85, None, None, None, None, None, None, None, 0, 100]


def test_bullets(spark):
    given = ["• one\n- two\n\n  •- three ", "Led e.g. Mrs. Smith. Built it! Done. ", "Saw Mr. X", "only one", "", None]
    want = [["one", "two", "three"], ["Led e.g. Mrs. Smith.", "Built it! Done."], ["Saw Mr. X."], ["only one."], [], None]
    assert _apply(spark, text.split_bullets, given) == want


def test_json_candidate(spark):
    given = ['x ```json\n{"a": 1}\n``` y', 'so {"a": 2} there', "[1, 2]", " none "]
    assert _apply(spark, text.json_candidate, given) == ['{"a": 1}', '{"a": 2}', "[1, 2]", "none"]


def test_nested_json(spark):
    given = ['x {"a": {"b": 1}} y', 'no { x {"a": [1, {"b": "}"}]} z', 'a ] b [1, [2]] c', '```\n[{"a": "]"}]\n``` {"z": 1}', 'he said "no { and {"a": 1}', "{" * 5000, "", None, '{"a": "\\"}"}', "{]{}"]
    want = ['{"a": {"b": 1}}', '{"a": [1, {"b": "}"}]}', "[1, [2]]", '[{"a": "]"}]', '{"a": 1}', "{" * 5000, "", None, '{"a": "\\"}"}', "{}"]
    assert _apply(spark, text.json_candidate, given) == want


def test_bullets_of_private_characters(spark):
    """No character of a text stands for an abbreviation."""
    given = ["a \ue000 b. c \ue00b d. Mr. X"]
    assert _apply(spark, text.split_bullets, given) == [["a \ue000 b.", "c \ue00b d.", "Mr. X."]]


def test_times(spark):
    from datetime import datetime

    rows = spark.createDataFrame([(datetime(2024, 1, 2, 3, 4, 5),), (datetime(2024, 1, 2, 3, 4, 5, 60),)], "t timestamp")
    assert [r.v for r in rows.select(text.iso_utc(F.col("t")).alias("v")).collect()] == ["2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.000060+00:00"]


def test_search_wild_cards(spark):
    rows = spark.createDataFrame([("abc", None), (None, "Axc"), ("zzz", "yyy"), (None, None)], "t string, c string")
    hits = lambda q: rows.where(text.search_matches(q, F.col("t"), F.col("c"))).count()
    assert (hits("a_c"), hits("%"), hits(""), hits(None), hits("ABC")) == (2, 3, 3, 4, 1)


def test_posting_number_and_query(spark):
    assert _apply(spark, text.posting_number, ["urn:li:jobPosting:42", "jobPosting:1", "urn:li:other:1", None]) == ["42", None, None, None]
    assert _apply(spark, text.query_string, ["data engineer"]) == ["data%2Bengineer"]


def test_properties_of_bullets_on_random_text(spark):
    import random

    rng = random.Random(3)
    given = ["".join(rng.choice("ab .,;\n•-!?") for _ in range(rng.randrange(60))) for _ in range(200)]
    for s, bullets in zip(given, _apply(spark, text.split_bullets, given), strict=True):
        assert all(b.strip() == b and b for b in bullets)
        if "\n" not in s:
            assert all(re.search("[.!?]$", b) for b in bullets)
