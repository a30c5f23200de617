"""Trajectories to paired contrasts: variant means, deltas between conditions, family means.

Contrast definitions are rows of a small table, so any number of contrasts is one plan. Rows
with a null key are left out and null metrics are skipped, never turned into NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.schemas import CONTRASTS


def condition_means(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric per key."""
    known = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return known.groupBy(*keys).agg(*(F.avg(F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double"))).alias(m) for m in metrics))


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def wide(means: DataFrame, keys: Sequence[str], condition: str, levels: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per key with columns `{metric}_{level}`; a cell that occurs twice is an error."""
    c = F.col(condition)
    cells = [F.max(F.when(c == level, F.col(m))).alias(f"{m}_{level}") for m in metrics for level in levels]
    worst = F.greatest(*(F.count(F.when(c == level, 1)) for level in levels)) if len(levels) > 1 else F.count(F.when(c == levels[0], 1))
    out = means.groupBy(*keys).agg(*cells, worst.alias("_worst"))
    checked = F.assert_true(F.col("_worst") <= 1, F.lit("a cell of the pivot occurs more than once"))
    # the assertion yields null; it takes part in a column so that it is not pruned
    first = f"{metrics[0]}_{levels[0]}"
    return out.withColumn(first, F.when(checked.isNull(), F.col(first))).drop("_worst")


def deltas_wide(table: DataFrame, metrics: Sequence[str], left: str, right: str) -> DataFrame:
    """Add `delta_{metric}` = left - right."""
    return table.withColumns({f"delta_{m}": F.col(f"{m}_{left}") - F.col(f"{m}_{right}") for m in metrics})


def definitions(spark: SparkSession, contrasts: Sequence[tuple[str, str, str, str]] = CONTRASTS) -> DataFrame:
    return spark.createDataFrame([tuple(c) for c in contrasts], "contrast string, left_condition string, right_condition string, alternative string")


def contrasts(means: DataFrame, defs: DataFrame, keys: Sequence[str], condition: str, metrics: Sequence[str]) -> DataFrame:
    """Long table (contrast, left, right, keys, delta_{metric}...) over all definitions.

    One shuffle for any number of contrasts: the means of a unit meet in one row, and that row is
    read once for each definition. The definitions are a handful of rows and are always sent to the
    means: the planner does not know their size, and would deal the means out by condition or
    broadcast them instead. `paired` says whether both sides are there, once each.
    """
    named = ("contrast", "left_condition", "right_condition", "alternative")
    defs = F.broadcast(defs.select(*named))
    cell = F.struct(F.col(condition).alias("_on"), *(F.col(m).alias(f"_{k}") for k, m in enumerate(metrics)))
    units = means.groupBy(*keys).agg(F.collect_list(cell).alias("_cells"))
    left = F.filter("_cells", lambda c: c["_on"] == F.col("left_condition"))
    right = F.filter("_cells", lambda c: (c["_on"] == F.col("right_condition")) & (c["_on"] != F.col("left_condition")))
    sided = units.crossJoin(defs).select(*named, *keys, left.alias("_l"), right.alias("_r")).where((F.size("_l") > 0) | (F.size("_r") > 0))
    deltas = [(F.array_max(F.col("_l")[f"_{k}"]) - F.array_max(F.col("_r")[f"_{k}"])).alias(f"delta_{m}") for k, m in enumerate(metrics)]
    return sided.select(*named, *keys, *deltas, ((F.size("_l") == 1) & (F.size("_r") == 1)).alias("paired"))


def family_means(deltas: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return deltas.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in metrics))


def family_spread(families: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    """Least, greatest and positive family deltas."""
    x = F.col(delta)
    return families.groupBy(*keys).agg(F.min(x).alias("min_family_delta"), F.max(x).alias("max_family_delta"), F.avg(x).alias("mean_family_delta"), F.count(F.when(x > 0, 1)).alias("positive_families"), F.count(F.lit(1)).alias("total_families"))


def completeness(rows: DataFrame, key: str, condition: str, levels: Sequence[str], expected: int | None = None, units: DataFrame | None = None) -> DataFrame:
    """Rows in each cell of the full grid key x level, 0 where there is none.

    units: a table of the keys that are expected; those without any row are reported too, with zeros.
    """
    if units is not None:
        listed = units.select(key).where(F.col(key).isNotNull()).distinct().withColumn(condition, F.lit(None).cast(rows.schema[condition].dataType))
        rows = rows.select(key, condition).unionByName(listed)
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.count(F.when(F.col(condition) == level, 1)).alias(f"_{k}") for k, level in enumerate(levels)))
    cells = F.explode(F.array(*(F.struct(F.lit(level).alias(condition), F.col(f"_{k}").alias("n")) for k, level in enumerate(levels))))
    out = counts.select(key, cells.alias("_c")).select(key, f"_c.{condition}", "_c.n")
    return out.withColumn("complete", F.col("n") == expected if expected is not None else F.col("n") > 0)


def relative_reduction(left: Column, right: Column) -> Column:
    """1 - mean(right) / mean(left), as an aggregate."""
    return 1 - F.avg(right) / F.nullif(F.avg(left), F.lit(0.0))


def specs(tasks: DataFrame, sides: Sequence[str] = ("nl", "python"), expected: int | None = None) -> DataFrame:
    """Tasks to trajectories: every variant of every side, `task__side__vK` with K from 1.

    With `expected`, a side with another number of variants is an error.
    """
    named = F.array(*(F.struct(F.lit(s).alias("representation"), F.col(s).alias("variants")) for s in sides))
    rows = tasks.select("id", "family", "task", F.explode(named).alias("_s")).select("id", "family", "task", "_s.representation", "_s.variants")
    if expected is not None:
        rows = rows.withColumn("variants", F.when(F.assert_true(F.size("variants") == expected, F.lit(f"a task must have {expected} variants")).isNull(), F.col("variants")))
    rows = rows.select("id", "family", "task", "representation", F.posexplode("variants").alias("_i", "reference"))
    variant = (F.col("_i") + 1).cast("int")
    return rows.select(F.concat_ws("__", "id", "representation", F.concat(F.lit("v"), variant.cast("string"))).alias("trajectory_id"), F.col("id").alias("task_id"), "family", "representation", variant.alias("variant"), F.col("task").alias("task_text"), "reference")
