"""Extensions: incremental ingest and keyword counts over event time. The stored rules know neither."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.merge import VersionedTable, upsert_jobs
from ..operators.novelty import new_by_id_and_key, with_description


def ingest(postings: DataFrame, store: VersionedTable, checkpoint: str, now: Callable[[], datetime]) -> DataStreamWriter:
    """Merges a stream of fetched postings into the stored ones, a version for each micro-batch.

    A batch that is repeated after a failure finds its rows stored and adds nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        state = store.read()
        store.write(upsert_jobs(state, with_description(new_by_id_and_key(batch, state)), now()))

    return postings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts by key over tumbling windows; rows later than ``late`` are dropped in a stream."""
    counts = events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), *keys, "n")
