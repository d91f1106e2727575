"""Every registered query of the postings against its SQL, on small tables."""

from __future__ import annotations

import duckdb
import pytest

from jobloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Without rows on tables of any size, as README says.
EMPTY = {"top_scored_search"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    want = duck.sql(ORACLES[name])
    rows = QUERIES[name](spark, SF)
    assert sorted(rows.columns) == sorted(want.columns)
    got = sorted(str(tuple(r)) for r in rows.select(*[f"`{c}`" for c in want.columns]).collect())
    assert got == sorted(map(str, want.fetchall()))
    assert got or name in EMPTY


def test_only_page_text_has_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"page_text"} and set(ORACLES) <= set(QUERIES)
