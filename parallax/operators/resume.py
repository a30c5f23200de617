"""Resumable processing: what is done, what is left, and what a broken run must redo.

Token rows of a trajectory are written before its summary row, so a summary marks the
trajectory as complete and token rows without one are left-overs of a crash.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table that may not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def completed(rows: DataFrame, key: str = "trajectory_id") -> DataFrame:
    return rows.select(key).where(F.col(key).isNotNull()).distinct()


def remaining(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return work.join(done.select(*keys), list(keys), "left_anti")


def repaired(tokens: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Token rows of complete trajectories only."""
    return tokens.join(done.select(*keys), list(keys), "left_semi")


def in_frozen_order(records: DataFrame, order: DataFrame, key: str, position: str = "ord") -> DataFrame:
    """Records sorted by their frozen positions; ids on one side only, or twice, are an error."""
    left = records.withColumn("_r", F.lit(True))
    right = order.select(F.col(key), F.col(position).alias("_ord"))
    both = left.join(right, key, "full_outer")
    fine = F.assert_true(F.col("_r").isNotNull() & F.col("_ord").isNotNull(), F.concat(F.lit("id on one side only: "), F.col(key)))
    return both.withColumn(position, F.when(fine.isNull(), F.col("_ord"))).drop("_r", "_ord").orderBy(position)


#: Ids that a frozen order may hold; they pass through the driver.
MAX_ORDER = 1_000_000


def frozen_permutation(records: DataFrame, key: str, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """(key, ord): the seeded shuffle of a run's ids, the same in every run and on every cluster.

    Ids are shuffled from their order of `by` (default: the key) by Python's generator. A run's
    trajectories are few; for more ids than MAX_ORDER order by a hash of (seed, id) instead.
    """
    ids = [r[0] for r in records.orderBy(*(by or [key])).select(key).limit(MAX_ORDER + 1).collect()]
    if len(ids) > MAX_ORDER:
        raise ValueError(f"more than {MAX_ORDER} ids for a frozen order")
    random.Random(seed).shuffle(ids)
    return records.sparkSession.createDataFrame(list(enumerate(ids)), f"ord long, `{key}` {records.schema[key].dataType.simpleString()}").select(key, "ord")
