from __future__ import annotations

import os
import random
from collections import Counter

import brute
import duckdb
import pytest

import corpus_pipeline
from jobloom.llm import queries
from jobloom.llm.toxicity_fm import score_toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "mixing":
            assert out.columns == corpus_pipeline.COLUMNS
            assert stage(spark, docs.limit(0), SF).count() == 0
            docs = spark.createDataFrame(out.collect(), docs.schema)
            kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[0] > kept[-1] > 100
    assert corpus_pipeline.run(spark, SF).count() == corpus_pipeline.mixing(spark, docs, SF).count()


def test_stages_by_brute_force(spark):
    """Each stage on hostile rows and on all that the one before kept: copies, passages, nulls, long and repeated texts."""
    rng = random.Random(3)
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS).collect()]
    passage = " ".join(f"p{i}" for i in range(70))
    words = lambda n: " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))
    given += [(10_000 + i, f"{words(30)} {passage} {words(20)}", "en", "src1", 9) for i in range(4)] + [(10_010, passage, "en", "src2", 9)]
    base = words(200).split()
    given += [(10_020 + i, " ".join(base[:190] + words(i).split()), "de", "src3", 9) for i in range(0, 9, 2)] + [(10_030, "a  b", "fr", None, 9), (10_031, "A b", None, "odd", 9)]
    given += [(10_040, None, "en", "src1", None), (10_041, "", "en", "src1", 0), (10_042, " \n ", "en", "src1", 3), (None, words(30), "en", "src1", 1), (10_043, words(60_000), "es", "src9", 1)]
    given += [given[0], given[0]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "clash", 7) for r in given], f"{schema}, score string, rest int")
    clean = corpus_pipeline.toxicity(spark, docs, SF).collect()
    scored = {(r.doc_id, r.text): r.predicted for r in score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert Counter(tuple(r) for r in clean) == Counter(r for r in given if not scored[r[0], r[1]]) and 0 < len(clean) < len(given)
    before = spark.createDataFrame(clean, schema)

    texts = {r.doc_id: r.text for r in clean if r.doc_id is not None}
    groups = brute.near_duplicates(texts, 5, 80)
    want = [tuple(r) for r in clean if r.doc_id is None or groups[r.doc_id][1] == r.doc_id]
    got = corpus_pipeline.near_dedup(spark, before, SF).collect()
    assert Counter(map(tuple, got)) == Counter(want) and len(want) < len(clean)
    before = spark.createDataFrame(got, schema)

    cut = brute.substring_dedup({r.doc_id: r.text for r in got if r.doc_id is not None}, 50)
    after = corpus_pipeline.passages(spark, before, SF).collect()
    for r in got:
        n, gone, kept = cut.get(r.doc_id, (0, 0, None))
        mine = [x for x in after if x.doc_id == r.doc_id]
        if gone and gone == n:
            assert not mine
        else:
            assert mine and all((x.text or "").split() == kept if kept is not None else x.text == r.text for x in mine)
            assert all(x.n_chars == (len(x.text) if gone else r.n_chars) for x in mine)
    assert sum(g for _, g, _ in cut.values()) >= 4 * 70
    before = spark.createDataFrame(after, schema)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = brute.contamination({i: r.text for i, r in enumerate(after)}, items, 13)
    left = corpus_pipeline.decontaminate(spark, before, SF).collect()
    assert Counter(map(tuple, left)) == Counter(tuple(r) for i, r in enumerate(after) if not hit[i][3]) and len(left) < len(after)
    mixed = corpus_pipeline.mixing(spark, spark.createDataFrame(left, schema), SF).collect()
    tokens = sum(len((r.text or "").split()) for r in left)
    assert 0 < sum(r.n_tokens for r in mixed) <= tokens * 60 // 100 and {r.epoch for r in mixed} <= {0, 1, 2} and all(r.n_tokens == len((r.text or "").split()) for r in mixed)


def test_mixing_against_sql(spark, tmp_path):
    """The last stage's rows are those of its SQL."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(f"WITH {queries.mix_sql('documents')} SELECT doc_id, domain, lang, source, n_tokens, epoch FROM picked").fetchall()
    got = corpus_pipeline.mixing(spark, docs, SF).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_pipeline_leaves_only_its_result(spark):
    """Tables that the stages' operators wrote are gone; the result can still be read."""
    root = spark.conf.get("spark.checkpoint.dir") + f"/jobloom-{spark.sparkContext.applicationId}"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    out = corpus_pipeline.run(spark, SF)
    new = {name.rpartition("-")[0] for name in set(os.listdir(root)) - before}
    assert new == {"mixing"} and out.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    rows = queries.QUERIES[name](spark, SF)
    assert sorted(rows.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in rows.select(want.columns).collect()))) == sorted(map(str, want.fetchall()))
