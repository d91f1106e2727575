"""Captured responses of the two job boards, and documents, as DataFrames. Nothing here goes to the network."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import fields_of, text_of, urns_of
from ..functions.text import posting_number
from ..operators.plugins import TextTransform, plain_markdown
from ..schema import ITEM, SEARCH_PAGE


def search_ids(pages: DataFrame) -> DataFrame:
    """(job_id): distinct postings on captured HTML search pages (html)."""
    urns = pages.select(F.explode(urns_of(F.col("html"))).alias("urn"))
    return urns.select(posting_number(F.col("urn")).alias("job_id")).where("job_id is not null").distinct()


def html_postings(pages: DataFrame, markdown: TextTransform = plain_markdown) -> DataFrame:
    """Records of captured detail pages (job_id, html)."""
    rows = pages.select("job_id", fields_of(F.col("html")).alias("f")).select("job_id", "f.*")
    return rows.withColumn("description", markdown(F.col("description"))).withColumn("provider", F.lit("linkedin"))


def company_name(item: Column) -> Column:
    """The hiring company, else the posting one; an empty name counts as none."""
    return F.coalesce(F.nullif(item["hiringCompany"]["name"], F.lit("")), F.nullif(item["postedCompany"]["name"], F.lit("")))


def skill_ids(item: Column) -> Column:
    return F.filter(F.transform(item["skills"], lambda s: s["uuid"]), lambda u: u.isNotNull())


def search_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of captured JSON search pages. A page that isn't JSON gives no items; the other pages stay."""
    pages = spark.read.schema(SEARCH_PAGE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return item_records(pages.select(F.explode("results").alias("item")))


def follow_pages(pages: DataFrame) -> DataFrame:
    """(search, hop, item): items of captured search pages, by following each search's next links.

    ``pages`` are (search, url, first, body). Reading starts at the page marked ``first`` (of several, the
    one with the smallest url) and ends where there is no next link, where the next page wasn't captured or was read
    before, or at a page that isn't JSON; the pages read until then stay. A search's pages meet in one row.
    """
    body = F.from_json("body", SEARCH_PAGE)
    one = pages.where("search is not null and url is not null").groupBy("search", "url").agg(F.max("first").alias("first"), F.min("body").alias("body"))
    page = F.struct(body["_links"]["next"]["href"].alias("next"), body["results"].alias("results"), (body["results"].isNotNull() | body["total"].isNotNull()).alias("fine"))
    known = one.groupBy("search").agg(F.map_from_entries(F.collect_list(F.struct("url", page.alias("page")))).alias("pages"), F.min(F.when(F.col("first"), F.col("url"))).alias("at"))
    start = F.struct(F.col("at"), F.array().cast("array<string>").alias("read"))

    def step(state: Column, _: Column) -> Column:
        page = F.col("pages")[state["at"]]
        go = F.coalesce(page["fine"] & ~F.array_contains(state["read"], state["at"]), F.lit(False))
        return F.when(go, F.struct(page["next"].alias("at"), F.array_append(state["read"], state["at"]).alias("read"))).otherwise(state)

    order = F.aggregate(F.sequence(F.lit(1), F.size("pages")), start, step, lambda state: state["read"])
    read = known.select("search", "pages", F.posexplode(order).alias("hop", "url"))
    return read.select("search", "hop", F.explode(F.col("pages")[F.col("url")]["results"]).alias("item"))


def item_records(items: DataFrame) -> DataFrame:
    """(job_id, company, job_title) of a column ``item``, for the search for new ones."""
    item = F.col("item")
    return items.select(item["uuid"].alias("job_id"), company_name(item).alias("company"), item["title"].alias("job_title"))


def json_postings(details: DataFrame, markdown: TextTransform = plain_markdown) -> DataFrame:
    """Records of captured JSON details (body). A missing level is 'Not applicable', a missing time is null."""
    item = F.from_json("body", ITEM)
    rows = details.select(item.alias("item")).where("item is not null")
    item = F.col("item")
    text = text_of(item["description"])
    return rows.select(
        item["uuid"].alias("job_id"),
        company_name(item).alias("company"),
        item["title"].alias("job_title"),
        F.lit("Singapore").alias("location"),
        F.coalesce(F.try_element_at(item["positionLevels"], F.lit(1))["position"], F.lit("Not applicable")).alias("level"),
        F.lit("careers_future").alias("provider"),
        markdown(F.nullif(text, F.lit(""))).alias("description"),
        item["metadata"]["createdAt"].try_cast("timestamp").alias("posted_at"),
    )


def document_texts(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, text) of (path, content): a file's pages joined by line ends and stripped; one that can't be read gives ''."""

    @F.pandas_udf("string")
    def text(contents: pd.Series) -> pd.Series:
        def one(content: bytes | None) -> str:
            try:
                return "\n".join(p or "" for p in extract(content or b"")).strip()
            except ValueError:
                return ""

        return contents.map(one)

    return files.select("path", text("content").alias("text"))


def documents(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, text) of all documents below a folder."""
    return document_texts(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path), extract)
