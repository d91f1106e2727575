"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch, which the JVM holds outside its heap and a worker beside what it makes of it.
_BYTES, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python by bytes, where the session doesn't: texts may be long."""
    if spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, str(_BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where that is unset in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="jobloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_collector: ContextVar[list[Scratch] | None] = ContextVar("collector", default=None)
#: With this, an execution's shuffle files go as soon as it ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written intermediate tables of one operator run.

    A kept table cuts lineage: an executor lost later costs a reread of the shared folder, not a
    recomputation, and the shuffle files of the job that wrote it go at once. ``forget`` deletes tables
    that nothing reads any more, ``collected`` those of all operators run inside it; the rest go when the
    session's JVM ends. A killed driver leaves the folder ``jobloom-<application id>`` to be deleted.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        small_batches(spark)
        self._base = f"{scratch_root(spark)}/jobloom-{spark.sparkContext.applicationId}"
        self._paths: list[tuple[DataFrame, str]] = []
        found = _collector.get()
        if found is not None:
            found.append(self)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self._base}/{label}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        hadoop = self._hadoop(path)
        hadoop[0].deleteOnExit(hadoop[1])
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths.append((out, path))
        return out

    def forget(self, *tables: DataFrame) -> None:
        for df in tables:
            for kept, path in list(self._paths):
                if kept is df:
                    fs, where = self._hadoop(path)
                    fs.delete(where, True)
                    self._paths.remove((kept, path))

    def forget_all(self) -> None:
        self.forget(*[df for df, _ in self._paths])

    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where


@contextmanager
def collected() -> Iterator[None]:
    """Deletes, at its end, the tables of all operators that ran inside: for callers that have written the result."""
    found: list[Scratch] = []
    token = _collector.set(found)
    try:
        yield
    finally:
        _collector.reset(token)
        for scratch in found:
            scratch.forget_all()
