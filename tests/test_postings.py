"""Listings, novelty, merges and lifecycle on hand-made rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobloom.config import Settings
from jobloom.operators import insights, lifecycle, listings, merge, novelty, plugins
from jobloom.schema import CUSTOM_RESUMES, JOBS, KEYWORD_INSIGHTS, RESUMES

NOW = datetime(2024, 6, 1)
SETTINGS = Settings(as_of=NOW)
OLD = NOW - timedelta(days=90)


def jobs(spark, *rows):
    base = {"company": "Acme", "job_title": "Engineer", "status": "new", "is_active": True, "job_state": "new", "resume_score_stage": "initial", "provider": "linkedin", "scraped_at": OLD, "last_checked": OLD, "description": "d"}
    return spark.createDataFrame([[{**base, **r}.get(f.name) for f in JOBS.fields] for r in rows], JOBS)


def ids(df):
    return [r.job_id for r in df.orderBy(*(["rn"] if "rn" in df.columns else ["job_id"])).collect()]


def test_null_placement_and_ties(spark):
    rows = jobs(spark, {"job_id": "b", "application_date": NOW, "status": "applied"}, {"job_id": "a", "application_date": NOW, "status": "applied"}, {"job_id": "c", "status": "applied"}, {"job_id": "o", "status": "offer", "application_date": OLD}, {"job_id": "x", "status": "offered"})
    assert ids(listings.applied_jobs(rows, 1, 10)) == ["o", "c", "a", "b"]
    assert ids(listings.applied_jobs(rows, 1, 10, offer="offered")) == ["x", "c", "a", "b"]
    assert ids(listings.applied_jobs(rows, 1, 10, sort_by="application_date", sort_order="asc")) == ["o", "a", "b", "c"]
    assert ids(listings.applied_jobs(rows, 2, 2)) == ["a", "b"]
    assert ids(listings.applied_jobs(rows, 1, 0)) == [] == ids(listings.applied_jobs(rows, 9, 10))


def test_pages_partition_the_order(spark):
    rows = jobs(spark, *[{"job_id": f"{i:02}", "resume_score": i % 4 * 30} for i in range(23)])
    pages = [ids(listings.jobs_for_generation(rows, n, 5)) for n in (1, 2, 3, 4)]
    whole = ids(listings.jobs_for_generation(rows, 1, 100))
    assert sum(pages, []) == whole and len(set(whole)) == len(whole) == 11


def test_scores_and_interest(spark):
    rows = jobs(spark, *[{"job_id": f"{s}{i}", "resume_score": s, "is_interested": i, "customized_resume_id": "r"} for s in (None, 49, 50, 100) for i in (True, None, False)])
    resumes = spark.createDataFrame([("r", "l")], "id string, resume_link string")
    assert ids(listings.top_scored_jobs(rows, resumes, 1, 9)) == ["100True", "50True", "100None", "50None", "100False", "50False"]
    assert ids(listings.top_scored_jobs(rows, resumes, 1, 9, interested="null_value")) == ["100None", "50None"]
    assert ids(listings.top_scored_jobs(rows, resumes, 1, 9, interested="maybe")) == []
    assert "100False" not in ids(listings.jobs_for_rescore(rows, resumes, 99))
    assert ids(listings.jobs_for_rescore(rows, resumes, 1)) in (["NoneNone"], ["NoneTrue"])


def test_expiry(spark):
    at = NOW - timedelta(days=30)
    rows = jobs(spark, {"job_id": "due"}, {"job_id": "edge", "scraped_at": at}, {"job_id": "null", "status": None}, {"job_id": "applied", "status": "applied"}, {"job_id": "offered", "status": "offered"}, {"job_id": "never", "scraped_at": None})
    out = lifecycle.expire(rows, SETTINGS)
    assert ids(out.where("job_state = 'expired'")) == ["due", "offered"] == ids(out.where("not is_active"))
    assert lifecycle.expire(out, SETTINGS).exceptAll(out).count() == 0
    assert ids(lifecycle.purge(out, SETTINGS)) == ["applied", "edge", "never", "null"]


def test_checks(spark):
    rows = jobs(spark, *[{"job_id": str(i)} for i in range(6)])
    pages = spark.createDataFrame([("0", 404, None), ("1", 500, "job is closed"), ("2", 200, "x NO LONGER Accepting applications"), ("3", 200, "open"), ("4", None, None)], "job_id string, http_status int, body string")
    out = lifecycle.apply_checks(rows, pages, SETTINGS)
    assert ids(out.where("job_state = 'removed' and not is_active")) == ["0", "2"]
    assert ids(out.where(F.col("last_checked") == F.lit(NOW))) == ["0", "1", "2", "3"]
    assert {r.outcome: r.n for r in lifecycle.check_tallies(pages).collect()} == {"inactive": 2, "active": 2, "failed": 1}
    assert lifecycle.maintain(rows, pages, SETTINGS).count() == 0


def test_novelty(spark):
    stored = jobs(spark, {"job_id": "1", "company": "  ACME ", "job_title": "Dev"}, {"job_id": "2", "company": "   "}, {"job_id": "3", "company": None})
    fetched = spark.createDataFrame([("1", "x", "y"), ("4", "acme", " DEV"), ("5", "", "Engineer"), ("6", None, "Dev"), ("7", "new", "dev"), ("7", "new", "dev"), (None, "n", "n")], "job_id string, company string, job_title string")
    assert ids(novelty.new_by_id(fetched, stored)) == ["4", "5", "6", "7"]
    assert ids(novelty.new_by_id_and_key(fetched, stored)) == ["5", "6", "7"]
    assert novelty.skipped(fetched, stored).first().asDict() == {"by_id": 1, "by_key": 1, "kept": 3}
    assert ids(novelty.with_description(jobs(spark, {"job_id": "a", "description": " \n "}, {"job_id": "b", "description": None}, {"job_id": "c"}))) == ["c"]


def test_upsert(spark):
    state = jobs(spark, {"job_id": "1", "notes": "keep", "level": "mid"})
    new = spark.createDataFrame([("1", None), ("2", "top"), (None, "x"), ("2", "top")], "job_id string, level string")
    out = merge.upsert_jobs(state, new, NOW)
    assert [(r.job_id, r.level, r.notes, r.status, r.scraped_at) for r in out.orderBy("job_id").collect()] == [("1", None, "keep", "new", OLD), ("2", "top", None, "new", NOW)]
    assert merge.upsert_jobs(out, new, NOW).exceptAll(out).count() == 0
    assert out.schema.names == JOBS.names


def test_upsert_takes_the_latest_and_fullest_of_repeated_keys(spark):
    state = spark.createDataFrame([], "k string, a string, b string, at timestamp")
    rows = [("x", None, None, OLD), ("x", "a", None, OLD), ("x", "a", "b", OLD), ("y", "full", "full", OLD), ("y", None, "new", NOW), ("z", "full", "full", None), ("z", None, None, OLD)]
    changes = spark.createDataFrame(rows, state.schema)
    got = {r.k: (r.a, r.b) for r in merge.upsert(state, changes, ["k"], latest="at").collect()}
    assert got == {"x": ("a", "b"), "y": (None, "new"), "z": (None, None)}
    assert {r.k: (r.a, r.b) for r in merge.upsert(state, changes.drop("at"), ["k"]).collect()} == {"x": ("a", "b"), "y": ("full", "full"), "z": ("full", "full")}


def test_resumes(spark):
    state = spark.createDataFrame([], RESUMES)
    new = spark.createDataFrame([("a@x", "A"), ("", "B"), (None, "C"), ("a@x", "Z")], "email string, name string")
    out = merge.upsert_resume(state, new, NOW)
    assert [(r.email, r.name, r.parsed_at) for r in out.collect()] == [("a@x", "A", NOW)]
    rows = spark.createDataFrame([("A", "a@x", "l")], "name string, email string, resume_link string")
    custom = merge.insert_custom_resumes(spark.createDataFrame([], CUSTOM_RESUMES), rows, NOW)
    assert custom.count() == 1 == merge.insert_custom_resumes(custom, rows, NOW).count()
    with pytest.raises(Exception, match="needs a link"):
        merge.insert_custom_resumes(custom, rows.withColumn("resume_link", F.lit(None).cast("string")).withColumn("name", F.lit("N")), NOW).collect()


def test_updates(spark):
    state = jobs(spark, {"job_id": "1", "resume_score": 10, "customized_resume_id": "gone"}, {"job_id": "2", "customized_resume_id": "r"})
    scores = spark.createDataFrame([("1", 0), ("2", None), ("9", 5)], "job_id string, resume_score int")
    out = merge.update_scores(state, scores, "custom")
    assert [(r.job_id, r.resume_score, r.resume_score_stage) for r in out.orderBy("job_id").collect()] == [("1", 0, "custom"), ("2", None, "initial")]
    with pytest.raises(ValueError, match="stage"):
        merge.update_scores(state, scores, "final")
    there = spark.createDataFrame([("r",), ("r",)], "id string")
    assert [r.customized_resume_id for r in merge.release_orphans(state, there).orderBy("job_id").collect()] == [None, "r"]
    touched = merge.touch(state, state.where("job_id = '1'"), "job_id", "last_checked", NOW)
    assert [r.last_checked for r in touched.orderBy("job_id").collect()] == [NOW, OLD]


def test_versions(spark, tmp_path):
    store = merge.VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        store.read()
    for n in range(1, 6):
        state = spark.range(n) if n == 1 else store.read().union(spark.range(1))
        assert store.write(state) == n
    assert store.read().count() == 5
    # a writer that read the same version but came later fails, and the version in force stays
    slow, before = merge.VersionedTable(spark, str(tmp_path / "t")), store.read().count()
    slow.version = lambda: 4
    with pytest.raises(Exception, match="xist"):
        slow.write(spark.range(99))
    assert store.version() == 5 and store.read().count() == before and len(list((tmp_path / "t").glob("data-*"))) == 2
    (tmp_path / "t" / "_current-6").touch()  # a pointer still being written
    assert store.read().count() == before
    assert merge.put_file(spark, str(tmp_path), "7", b"%PDF").endswith("personalized_7.pdf")
    assert (tmp_path / "personalized_7.pdf").read_bytes() == b"%PDF"


def test_keywords(spark):
    rows = jobs(spark, {"job_id": "1", "description": "Python and SQL, PYTHON; s/4hana"}, {"job_id": "2", "description": ""}, {"job_id": "3", "description": None})
    found = insights.mentions(rows, plugins.dictionary_tagger({"python": "Skill ", "sql": "skill", "s/4hana": "tool"}))
    counts = {(r.keyword, r.category): r["count"] for r in insights.count_keywords(found).collect()}
    assert counts == {("Python", "skill"): 2, ("Sql", "skill"): 1, ("S/4Hana", "tool"): 1}
    old = spark.createDataFrame([("Python", "skill", 5, OLD), ("Go", "skill", 1, OLD)], KEYWORD_INSIGHTS)
    merged = {r.keyword: (r["count"], r.last_updated) for r in insights.add_counts(old, insights.count_keywords(found), NOW).collect()}
    assert merged == {"Python": (7, NOW), "Go": (1, OLD), "Sql": (1, NOW), "S/4Hana": (1, NOW)}
    state = insights.add_mentions(found.limit(0), found, rows.limit(0))
    assert insights.add_mentions(state, found, rows).count() == found.count() == 4
    assert ids(insights.mark_analysed(rows, rows.where("job_id = '2'"), NOW).where("insights_analyzed_at is not null")) == ["2"]


def test_prompts(spark):
    rows = jobs(spark, *[{"job_id": str(i), "job_title": None if i == 1 else "T", "description": f"d{i}"} for i in range(3)])
    out = insights.batch_prompts(insights.number_batches(rows, "job_id", 2, 9)).orderBy("batch").collect()
    assert [r.prompt for r in out] == ["\n\n--- JOB 1: T ---\nd0\n\n--- JOB 2: Unknown ---\nd1", "\n\n--- JOB 1: T ---\nd2"]
