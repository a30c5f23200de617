"""Incremental measurement with Structured Streaming.

New token files are summarised as they arrive. A trajectory is written once: each micro-batch
appends the trajectories that the result does not hold yet, so a batch that is run again after
a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from parallax.sources.writers import append_new


def summarise_stream(spark: SparkSession, source: str, schema: StructType, summarise: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, keys: Sequence[str] = ("trajectory_id",), files_per_batch: int | None = None) -> StreamingQuery:
    """Summarise all token files that are there and not done yet, then stop.

    A file holds whole trajectories; `summarise` maps their tokens to one row per key.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def batch(tokens: DataFrame, _: int) -> None:
        append_new(summarise(tokens), target, keys)

    return reader.parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_means(tokens: DataFrame, time: str, window: str, late: str, group: Sequence[str], value: str) -> DataFrame:
    """Event-time windows of a token stream: count and mean per group, with rows later than `late` dropped."""
    from pyspark.sql import functions as F

    watched = tokens.withWatermark(time, late) if tokens.isStreaming else tokens
    out = watched.groupBy(F.window(time, window), *group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias(f"mean_{value}"))
    return out.select("window.start", "window.end", *group, "n", f"mean_{value}")
