"""Captured pages, résumés and the streaming extensions."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from jobloom.functions import html
from jobloom.operators import plugins, resumes
from jobloom.operators.merge import VersionedTable
from jobloom.schema import JOBS, RESUME
from jobloom.sources import captured, derived
from jobloom.streaming.ingest import ingest, windowed_counts

DETAIL = """<div class="top-card-layout__card x"><a href=#><img alt=" Acme Inc "></a></div><div class="top-card-layout__entity-info"><a> Data <b>Engineer</b> </a></div>
<h1 class="top-card-layout__title">Other</h1><a class="topcard__org-name-link">Linked</a><div class="topcard__flavor-row"><span class="topcard__flavor">Row town</span></div>
<span class="topcard__flavor topcard__flavor--bullet">Berlin</span><ul class="description__job-criteria-list"><li><h3 class="description__job-criteria-subheader">Type</h3></li>
<li><h3 class="description__job-criteria-subheader"> Seniority level </h3><span class="description__job-criteria-text"> Mid </span></li></ul>
<div class="show-more-less-html__markup">One<br>Two &amp; <p> three </p><script>no</script></div>"""


def test_detail_fields_and_fallbacks():
    assert html.posting_fields(DETAIL) == {"company": "Acme Inc", "job_title": "Data Engineer", "level": "Mid", "location": "Berlin", "description": "One\nTwo &\nthree"}
    no_image = html.posting_fields(DETAIL.replace("<img alt=\" Acme Inc \">", ""))
    assert no_image["company"] == "Linked"
    assert html.posting_fields(DETAIL.replace("topcard__org-name-link", "q").replace("<img alt=\" Acme Inc \">", ""))["company"] == "Row town"
    assert html.posting_fields(DETAIL.replace("top-card-layout__entity-info", "q"))["job_title"] == "Other"
    assert html.posting_fields(DETAIL.replace(" topcard__flavor--bullet", ""))["location"] == "Row town"
    assert set(html.posting_fields(None).values()) == {None} == set(html.posting_fields("<p").values())
    assert html.plain_text("<p>a  b</p>c<br/>d<style>x</style>") == "a b\nc\nd"


def test_deep_pages():
    deep = "<div>" * 20_000 + "a<p>b</p>" + "</div>" * 20_000 + "c"
    assert html.plain_text(deep) == "a\nb\nc" and html.plain_text("<b>x</b>y <i>z</i>") == "xy z" and html.plain_text(None) is None


def test_next_links(spark):
    """Pages are read in the order of their links, up to a broken, missing or repeated one."""
    page = lambda ids, following: json.dumps({"results": [{"uuid": i} for i in ids], "total": 9, "_links": {"next": {"href": following}} if following else {}})
    rows = [("a", "1", True, page("x", "2")), ("a", "2", False, page("yz", None)), ("a", "9", False, page("q", None)), ("b", "1", True, page("x", "2")), ("b", "2", False, "{broken"), ("c", "1", True, page("x", "2")), ("c", "2", False, page("y", "1")), ("d", "1", True, page("x", "5")), ("e", "1", True, "oops"), ("f", "1", False, page("x", None)), (None, "1", True, page("x", None)), ("g", "1", True, None)]
    out = captured.follow_pages(spark.createDataFrame(rows, "search string, url string, first boolean, body string")).collect()
    assert sorted((r.search, r.hop, r.item.uuid) for r in out) == [("a", 0, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", 0, "x"), ("c", 0, "x"), ("c", 1, "y"), ("d", 0, "x")]


def test_search_pages(spark):
    card = '<li><div class="base-card y" data-entity-urn="{}"></div></li>'
    pages = ["".join(card.format(u) for u in ("urn:li:jobPosting:1", "urn:li:jobPosting:2", "urn:li:jobPosting:1", "jobPosting:9", "urn:li:x:3")), "<p>none</p>", None]
    rows = spark.createDataFrame([(p,) for p in pages], "html string")
    assert sorted(r.job_id for r in captured.search_ids(rows).collect()) == ["1", "2"]
    detail = captured.html_postings(spark.createDataFrame([("1", DETAIL)], "job_id string, html string")).first()
    assert (detail.job_id, detail.company, detail.provider, detail.description) == ("1", "Acme Inc", "linkedin", "One\nTwo &\nthree")


def test_json_board(spark, tmp_path):
    items = [{"uuid": "a", "title": "T", "hiringCompany": {"name": "H"}, "postedCompany": {"name": "P"}}, {"uuid": "b", "hiringCompany": {"name": ""}, "postedCompany": {"name": "P"}}, {"title": "no id"}]
    (tmp_path / "1.json").write_text(json.dumps({"results": items, "total": 3, "_links": {"next": {"href": "x"}}}))
    (tmp_path / "2.json").write_text("{broken")
    found = captured.search_items(spark, str(tmp_path)).orderBy("company").collect()
    assert [(r.job_id, r.company) for r in found] == [(None, None), ("a", "H"), ("b", "P")]
    details = [{"uuid": "a", "title": "T", "description": "<p>x</p>", "positionLevels": [{"position": "Senior"}], "metadata": {"createdAt": "2024-01-02T03:04:05Z"}}, {"uuid": "b", "positionLevels": [], "metadata": {"createdAt": ""}}, {"uuid": "c"}]
    rows = spark.createDataFrame([(json.dumps(d),) for d in details], "body string")
    out = {r.job_id: (r.level, r.description, r.posted_at) for r in captured.json_postings(rows).collect()}
    assert out == {"a": ("Senior", "x", datetime(2024, 1, 2, 3, 4, 5)), "b": ("Not applicable", None, None), "c": ("Not applicable", None, None)}
    item = spark.createDataFrame([(json.dumps({"skills": [{"uuid": "1"}, {}, {"uuid": "2"}]}),)], "body string").select(F.from_json("body", captured.ITEM).alias("i"))
    assert item.select(captured.skill_ids(F.col("i")).alias("s")).first().s == ["1", "2"]


def test_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two ")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def extract(content: bytes) -> list[str]:
        if content == b"bad":
            raise ValueError
        return content.decode().split("|")

    rows = captured.documents(spark, str(tmp_path), extract)
    assert sorted(r.text for r in rows.collect()) == ["", "one\ntwo"]


def _resume(spark, **given):
    return spark.read.schema(RESUME).json(spark.sparkContext.parallelize([json.dumps(given)])).select(F.struct(*RESUME.names).alias("resume"))


def test_resume_text_and_budget(spark):
    given = {
        "name": "A", "email": "a@x", "links": {"github": "g", "linkedin": ""}, "summary": " ".join(["w"] * 70), "skills": [str(i) for i in range(14)],
        "experience": [{"job_title": "Dev", "company": "C", "start_date": "2020", "description": "• a\n- b\nc\nd\ne"}] * 6, "projects": [{"name": "P", "description": "x. y", "technologies": ["t"]}] * 3,
        "education": [{"degree": "BSc", "field_of_study": "Math", "institution": "U", "end_year": "2019"}], "certifications": [{"name": "K", "issuer": "I"}], "languages": [],
    }
    rows = _resume(spark, **given)
    text = rows.select(resumes.as_text(F.col("resume")).alias("t")).first().t
    assert text.startswith("Name: A\nEmail: a@x\nLinks: github: g\n\n---\n\nSummary:\nw w")
    assert "\n* Dev at C\n  Dates: 2020 - Present\n  Description:\n    - • a\n    - - b" in text and "* BSc, Math from U\n  Years: ? - 2019" in text and "* K (I)" in text and "Languages" not in text
    cut = rows.select(resumes.fit_budget(F.col("resume")).alias("r")).first().r
    assert (len(cut.summary.split()), len(cut.skills), len(cut.experience), len(cut.projects)) == (60, 12, 5, 2)
    assert cut.summary.endswith("w...") and cut.experience[0].description == "• a\n• b\n• c\n• d" and cut.projects[0].description == "• x.\n• y."
    grid = resumes.layout_rows(rows.withColumn("id", F.lit(1))).where("section = 'skills'").orderBy("seq", "col").collect()
    assert [(r.seq, r.col) for r in grid[:4]] == [(0, 0), (0, 1), (0, 2), (1, 0)] and grid[13].text == "• 13"
    empty = _resume(spark, name="A", email="e")
    assert empty.select(resumes.as_text(F.col("resume")).alias("t")).first().t == "Name: A\nEmail: e\n\n---\n"


def test_tailoring(spark):
    jobs = spark.createDataFrame([("1", "t", "d"), ("2", "t", None)], "job_id string, job_title string, description string")
    scored = {r.job_id: r.resume_score for r in resumes.score_jobs(jobs, F.lit("T d x"), plugins.overlap_score).collect()}
    assert scored == {"1": 100, "2": None}
    rows = jobs.crossJoin(F.broadcast(_resume(spark, name="A", email="e", summary="s")))
    keep = dict.fromkeys(resumes.TAILORED, plugins.keep_section)
    kept = resumes.tailor(rows, F.col("resume"), keep, plugins.same_words)
    assert kept.where("valid and failed is null and resume.summary = 's'").count() == 2
    longer = lambda s, d: F.concat_ws(" ", s, d)
    added = resumes.tailor(rows, F.col("resume"), {**keep, "summary": longer}, plugins.same_words)
    assert [(r.valid, r.failed, r.resume is None) for r in added.orderBy("job_id").collect()] == [(False, "summary", True), (True, None, False)]
    # empty sections aren't edited, the first failure names the job's end, and sections come in their order
    full = _resume(spark, name="A", email="e", summary="", skills=["b", "a"], experience=[{"job_title": "Dev", "company": "C", "description": "x"}], projects=[])
    edits = {"summary": lambda s, d: F.lit("new words"), "projects": lambda s, d: F.lit(None).cast("array<struct<name:string,description:string,technologies:array<string>>>"), "skills": lambda s, d: F.array_sort(s)}
    fine = resumes.tailor(full.select(F.lit("1").alias("job_id"), F.lit("d").alias("description"), "resume"), F.col("resume"), edits, plugins.same_words).first()
    assert fine.valid and fine.resume.summary == "" and fine.resume.skills == ["a", "b"]
    bad = {"experience": lambda s, d: F.transform(s, lambda e: e.withField("company", F.lit("Other"))), "skills": lambda s, d: F.array(F.lit("z"))}
    assert resumes.tailor(full.select(F.lit("1").alias("job_id"), F.lit("d").alias("description"), "resume"), F.col("resume"), bad, plugins.same_words).first().failed == "experience"
    parsed = spark.createDataFrame([('{"name": "A", "email": "e"}',), ("{}",), ("x",)], "t string").select(plugins.json_resume(F.col("t")).alias("r"))
    assert [r.r is not None for r in parsed.collect()] == [True, False, False]


def test_layout_without_a_company(spark):
    rows = _resume(spark, name="A", email="e", experience=[{"job_title": "Dev", "location": "Town"}, {"job_title": "Dev", "company": "C", "location": "Town"}]).withColumn("id", F.lit(1))
    got = [r.text for r in resumes.layout_rows(rows).where("section = 'experience'").orderBy("seq").collect()]
    assert got == ["Dev", "", "", "Dev", "", "C | Town"]


def test_stream(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "jobs"))
    store.write(spark.createDataFrame([], JOBS))
    source = tmp_path / "in"
    batch = spark.createDataFrame([("1", "A", "T", "d"), ("2", "a", "t", "d"), ("3", "B", "T", " ")], "job_id string, company string, job_title string, description string")
    for _ in range(2):
        batch.write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    ingest(stream, store, str(tmp_path / "check"), lambda: datetime(2024, 1, 1)).trigger(availableNow=True).start().awaitTermination()
    kept = [r.job_id for r in store.read().collect()]
    assert 1 <= len(kept) == len(set(kept)) and set(kept) <= {"1", "2"}
    events = spark.createDataFrame([(datetime(2024, 1, 1, 1), "a"), (datetime(2024, 1, 1, 23), "a"), (datetime(2024, 1, 2), "b")], "ts timestamp, k string")
    assert sorted((r.k, r.n) for r in windowed_counts(events, "ts", ["k"]).collect()) == [("a", 2), ("b", 1)]


def test_resumes_are_all_documents(spark):
    """No id is left out of the relation that postings refer to."""
    sf = "/root/testdata/sf0.01"
    rows = derived.customized_resumes(spark, sf)
    documents = derived.table(spark, sf, "documents")
    assert rows.count() == documents.count() > 200 and rows.where("cast(id as long) >= 200 and resume_link is not null").count() > 0
