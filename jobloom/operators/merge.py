"""Writes as pure functions (state, changes) -> new state, and a versioned store for the result.

Parquet has no row updates, so a merge computes the whole next state; the store writes it beside the
current version and then moves a pointer, and readers never see a half-written table.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import JOB_CLOCK_DEFAULTS, JOB_DEFAULTS


def upsert(state: DataFrame, changes: DataFrame, key: Sequence[str], defaults: dict[str, Column] | None = None, stamp: dict[str, Column] | None = None, latest: str | None = None) -> DataFrame:
    """Updates rows by key and inserts the others.

    A column that ``changes`` lacks keeps its value in an updated row and takes its default in a new one; a
    column that is there is written, null included. ``stamp`` columns are written to touched rows alone.
    Rows with a null key are dropped from ``changes``. Of repeated keys one row is taken: the latest by the
    time column ``latest``, if given, then the one with most columns filled, then the smallest in all
    columns, so that a rerun gives the same state.
    """
    key = list(key)
    defaults, stamp = defaults or {}, stamp or {}
    given = [c for c in changes.columns if c not in key]
    changes = changes.dropna(subset=key)
    empty = reduce(add, [F.col(f"`{c}`").isNull().cast("int") for c in given], F.lit(0))
    age = -F.unix_micros(F.col(latest).cast("timestamp")) if latest else F.lit(0).cast("long")
    # nulls come first in a struct's order: an unknown time counts as the oldest
    best = F.min(F.struct(F.coalesce(age, F.lit(2**63 - 1)).alias("age"), empty.alias("empty"), F.struct(F.lit(1).alias("_there"), *given).alias("row")))
    changes = changes.groupBy(*key).agg(best.alias("_best")).select(*key, F.col("_best.row").alias("_new"))
    joined = state.withColumn("_old", F.lit(1)).join(changes, key, "full_outer")
    touched, old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    out = []
    for field in state.schema.fields:
        c = field.name
        value = F.col(c)
        if c in given:
            value = F.when(touched, F.col(f"_new.{c}")).otherwise(value)
        elif c not in key and c in defaults:
            value = F.when(old, value).otherwise(defaults[c])
        if c in stamp:
            value = F.when(touched, stamp[c]).otherwise(value)
        out.append(value.cast(field.dataType).alias(c))
    return joined.select(*out)


def upsert_jobs(state: DataFrame, changes: DataFrame, at: datetime) -> DataFrame:
    """Saves fetched postings by ``job_id``; ids are stored as text."""
    clock = F.lit(at).cast("timestamp")
    defaults = {c: F.lit(v) for c, v in JOB_DEFAULTS.items()} | dict.fromkeys(JOB_CLOCK_DEFAULTS, clock)
    return upsert(state, changes.withColumn("job_id", F.col("job_id").cast("string")), ["job_id"], defaults)


def upsert_resume(state: DataFrame, changes: DataFrame, at: datetime) -> DataFrame:
    """Saves parsed résumés by email; rows without one are refused."""
    clock = F.lit(at).cast("timestamp")
    return upsert(state, changes.where("email <> ''"), ["email"], {"created_at": clock}, {"parsed_at": clock})


def update_scores(state: DataFrame, scores: DataFrame, stage: str) -> DataFrame:
    """Writes (job_id, resume_score) and the stage to postings that exist; null scores change nothing."""
    if stage not in ("initial", "custom"):
        raise ValueError(f"no such score stage: {stage}")
    known = scores.where("resume_score is not null").groupBy("job_id").agg(F.min("resume_score").cast("short").alias("_score"))
    out = state.join(known, "job_id", "left").withColumn("resume_score", F.coalesce("_score", "resume_score"))
    return out.withColumn("resume_score_stage", F.when(F.col("_score").isNotNull(), stage).otherwise(F.col("resume_score_stage"))).select(*state.columns)


def link_resumes(state: DataFrame, links: DataFrame) -> DataFrame:
    """Writes (job_id, customized_resume_id) to postings that exist; the status stays."""
    new = links.groupBy("job_id").agg(F.min("customized_resume_id").alias("_link"))
    return state.join(new, "job_id", "left").withColumn("customized_resume_id", F.coalesce("_link", "customized_resume_id")).select(*state.columns)


def insert_custom_resumes(state: DataFrame, rows: DataFrame, at: datetime) -> DataFrame:
    """Adds tailored résumés. Columns not given are null; the id is derived from the row, so a rerun gives the same.

    A row without a link is an error.
    """
    clock = F.lit(at).cast("timestamp")
    digest = F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    link = F.when(F.col("resume_link").isNotNull(), F.col("resume_link")).otherwise(F.raise_error(F.lit("a tailored résumé needs a link")))
    new = rows.withColumns({"id": F.concat_ws("-", *parts), "created_at": clock, "last_updated": clock, "resume_link": link})
    new = new.join(state.select("id"), "id", "left_anti")
    return state.unionByName(new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in state.schema.fields if f.name in new.columns]), allowMissingColumns=True)


def touch(state: DataFrame, changed: DataFrame, key: str, column: str, at: datetime) -> DataFrame:
    """Stamps the rows whose key is among the changed, as a trigger on update does."""
    flag = changed.select(key).distinct().withColumn("_hit", F.lit(True))
    return state.join(flag, key, "left").withColumn(column, F.when(F.col("_hit"), F.lit(at).cast("timestamp")).otherwise(F.col(column))).select(*state.columns)


def release_orphans(jobs: DataFrame, resumes: DataFrame) -> DataFrame:
    """Postings whose tailored résumé was deleted lose the reference to it."""
    there = resumes.select(F.col("id").alias("_id")).distinct()
    return jobs.join(there, F.col("customized_resume_id") == F.col("_id"), "left").withColumn("customized_resume_id", F.col("_id")).select(*jobs.columns)


class VersionedTable:
    """Versions of a table under one folder; the pointer ``_current-N`` of the greatest N names the folder in force.

    Each write has a folder of its own, and a pointer is created only if it isn't there, so of two writers
    that start from one version the slower fails and leaves the other's data as they are.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._jvm, self._root = jvm, jvm.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> dict[int, str]:
        """Version -> folder; a pointer that is still being written isn't in force."""
        out = {}
        for found in self._fs.globStatus(self._jvm.Path(self._root, "_current-*")) or []:
            if found.getLen():
                stream = self._fs.open(found.getPath())
                try:
                    out[int(str(found.getPath().getName()).rpartition("-")[2])] = bytes(stream.readAllBytes()).decode()
                finally:
                    stream.close()
        return out

    def version(self) -> int:
        return max(self._pointers(), default=0)

    def read(self) -> DataFrame:
        pointers = self._pointers()
        if not pointers:
            raise FileNotFoundError(f"no version of {self.path}")
        return self.spark.read.parquet(f"{self.path}/{pointers[max(pointers)]}")

    def write(self, state: DataFrame, keep: int = 2) -> int:
        """Writes the next version, then the pointer; deletes versions older than the last ``keep``."""
        new, folder = self.version() + 1, f"data-{uuid.uuid4().hex}"
        state.write.parquet(f"{self.path}/{folder}")
        try:
            pointer = self._fs.create(self._jvm.Path(self._root, f"_current-{new}"), False)
        except Exception:
            self._fs.delete(self._jvm.Path(self._root, folder), True)
            raise
        try:
            pointer.write(bytearray(folder.encode()))
        finally:
            pointer.close()
        for old, place in self._pointers().items():
            if old <= new - keep:
                self._fs.delete(self._jvm.Path(self._root, f"_current-{old}"), False)
                self._fs.delete(self._jvm.Path(self._root, place), True)
        return new


def file_address(folder: str, job_id: Column) -> Column:
    """Where a posting's document is stored: one place each, so that a new one replaces the old."""
    return F.concat(F.lit(f"{folder.rstrip('/')}/personalized_"), job_id, F.lit(".pdf"))


def put_file(spark: SparkSession, folder: str, job_id: str, content: bytes) -> str:
    """Stores a posting's document, over an earlier one, and returns its address."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/personalized_{job_id}.pdf")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path.toString()
