"""Session set-up shared by queries, tests and the benchmark."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="jobloom-")) / f"{here.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for source in sorted(here.rglob("*.py")):
                z.write(source, source.relative_to(here.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark


def local_session(cpus: int | str = 8, **settings: str) -> SparkSession:
    """A local session with the settings the library expects: UTC, adaptive execution, few partitions."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("jobloom")
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **settings,
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)
