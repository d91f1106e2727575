"""The stored relations, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RESUMES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str, description: bool = True) -> DataFrame:
    """Postings: an order with its customer's nation and a part; ``description`` is the document of its key."""
    key = F.col("o_orderkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    date = F.col("o_orderdate").cast("timestamp")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", date.alias("o_orderdate"), "o_orderpriority")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(part, F.col("p_partkey") == key % 200)
    if description:
        documents = table(spark, sf_dir, "documents").select("doc_id", "text")
        rows = rows.join(documents, key == F.col("doc_id"), "left")
    odd = F.when(key % 17 == 0, None).when(key % 19 == 0, "  ").when(key % 10 >= 7, F.concat(F.lit("  "), F.upper("n_name"), F.lit(" "))).otherwise(F.col("n_name"))
    status = F.when(key % 8 == 0, "applied").when(key % 8 == 1, "interviewing").when(key % 8 == 2, "offer").when(key % 8 == 3, None).otherwise("new")
    return rows.select(
        key.cast("string").alias("job_id"),
        odd.alias("company"),
        F.col("p_name").alias("job_title"),
        F.when(key % 9 != 0, F.col("o_orderpriority")).alias("level"),
        F.col("n_name").alias("location"),
        *([F.col("text").alias("description")] if description else []),
        status.alias("status"),
        (key % 5 != 0).alias("is_active"),
        F.when((key % 8).isin(0, 1), F.col("o_orderdate")).alias("application_date"),
        F.when(key % 7 != 0, ((key * 37) % 101).cast("short")).alias("resume_score"),
        F.when(key % 23 == 0, "check").alias("notes"),
        F.col("o_orderdate").alias("scraped_at"),
        F.when(key % 29 != 0, F.col("o_orderdate") + F.expr("interval 2 days")).alias("last_checked"),
        F.when(key % 11 == 0, "expired").when(key % 13 == 0, "removed").otherwise("new").alias("job_state"),
        F.when(key % 4 == 0, "custom").otherwise("initial").alias("resume_score_stage"),
        F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("is_interested"),
        F.when(key % 2 == 0, (key % 200).cast("string")).alias("customized_resume_id"),
        F.when(key % 10 < 7, "linkedin").otherwise("careers_future").alias("provider"),
        F.when(key % 10 >= 7, F.col("o_orderdate") - F.expr("interval 1 day")).alias("posted_at"),
        F.when(key % 6 == 0, F.col("o_orderdate") + F.expr("interval 1 day")).alias("insights_analyzed_at"),
    )


def described(page: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds ``description`` to a page of postings: texts are read but not shuffled.

    The page, whose length is limited, is fetched first, so that its ranking isn't done for either side.
    """
    page = spark.createDataFrame(page.toArrow(), page.schema)
    key = F.col("doc_id").cast("string")
    texts = table(spark, sf_dir, "documents").select(key.alias("_key"), F.col("text").alias("description"))
    texts = texts.join(F.broadcast(page.select(F.col("job_id").alias("_key"))), "_key", "left_semi")
    return page.join(texts, F.col("job_id") == F.col("_key"), "left").drop("_key")


def with_text_flag(jobs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds ``has_description``; only ids of documents are shuffled."""
    there = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("_key"))
    return jobs.join(there, F.col("job_id") == F.col("_key"), "left").withColumn("has_description", F.col("_key").isNotNull()).drop("_key")


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored résumés: a customer each, with an email in lower case; parts that a fixture lacks are null."""
    key = F.col("c_custkey")
    given = {
        "id": key, "name": F.col("c_name"), "email": F.concat(F.lower("c_name"), F.lit("@example.com")), "phone": F.when(key % 3 == 0, key.cast("string")), "location": F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")),
        "summary": F.col("c_mktsegment"), "skills": F.split("c_mktsegment", "I"), "languages": F.when(key % 2 == 0, F.array(F.lit("en"), F.lit("de"))), "parsed_at": F.lit("1998-01-01 00:00:00").cast("timestamp"),
    }
    return table(spark, sf_dir, "customer").select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RESUMES.fields])


def customized_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    link = F.when(key % 10 != 0, F.concat(F.lit("resume_"), key.cast("string"), F.lit(".pdf")))
    return table(spark, sf_dir, "documents").select(key.cast("string").alias("id"), link.alias("resume_link"))


#: The same relations for DuckDB.
JOBS_SQL = """jobs AS (
 SELECT CAST(o.o_orderkey AS VARCHAR) AS job_id,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL WHEN o.o_orderkey % 19 = 0 THEN '  '
       WHEN o.o_orderkey % 10 >= 7 THEN '  ' || upper(n.n_name) || ' ' ELSE n.n_name END AS company,
  p.p_name AS job_title, CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE o.o_orderpriority END AS level,
  n.n_name AS location, d.text AS description,
  CASE o.o_orderkey % 8 WHEN 0 THEN 'applied' WHEN 1 THEN 'interviewing' WHEN 2 THEN 'offer' WHEN 3 THEN NULL ELSE 'new' END AS status,
  o.o_orderkey % 5 <> 0 AS is_active,
  CASE WHEN o.o_orderkey % 8 IN (0, 1) THEN o.o_orderdate END AS application_date,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST((o.o_orderkey * 37) % 101 AS SMALLINT) END AS resume_score,
  CASE WHEN o.o_orderkey % 23 = 0 THEN 'check' END AS notes, o.o_orderdate AS scraped_at,
  CASE WHEN o.o_orderkey % 29 = 0 THEN NULL ELSE o.o_orderdate + INTERVAL 2 DAY END AS last_checked,
  CASE WHEN o.o_orderkey % 11 = 0 THEN 'expired' WHEN o.o_orderkey % 13 = 0 THEN 'removed' ELSE 'new' END AS job_state,
  CASE WHEN o.o_orderkey % 4 = 0 THEN 'custom' ELSE 'initial' END AS resume_score_stage,
  CASE o.o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS is_interested,
  CASE WHEN o.o_orderkey % 2 = 0 THEN CAST(o.o_orderkey % 200 AS VARCHAR) END AS customized_resume_id,
  CASE WHEN o.o_orderkey % 10 < 7 THEN 'linkedin' ELSE 'careers_future' END AS provider,
  CASE WHEN o.o_orderkey % 10 >= 7 THEN o.o_orderdate - INTERVAL 1 DAY END AS posted_at,
  CASE WHEN o.o_orderkey % 6 = 0 THEN o.o_orderdate + INTERVAL 1 DAY END AS insights_analyzed_at
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
 JOIN part p ON p.p_partkey = o.o_orderkey % 200 LEFT JOIN documents d ON d.doc_id = o.o_orderkey)"""
RESUMES_SQL = """customized_resumes AS (
 SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 'resume_' || CAST(doc_id AS VARCHAR) || '.pdf' END AS resume_link
 FROM documents WHERE doc_id < 200)"""
