"""The batch operators on streams.

Pairs arrive as a stream and are judged in micro-batches by the same function
that the batch job runs.  A batch's rows are written below its own number, so a
batch that is run again after a failure replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_batches(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start ``operator`` on every micro-batch, its rows written to ``out``/batch=N."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def first_seen_pairs(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Each unordered pair once within the watermark."""
    keyed = stream.withColumns({"lo": F.least("entry_a", "entry_b"), "hi": F.greatest("entry_a", "entry_b")})
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["lo", "hi"])


def verdict_counts(stream: DataFrame, time: str, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Verdicts by window of event time."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), "verdict").agg(F.count("*").alias("n"))
