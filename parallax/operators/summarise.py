"""Token rows to trajectory rows.

All ordered metrics of a trajectory come from windows over one partitioning and one sort
order, which the final aggregation reuses: one shuffle on the trajectory key in all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax.schemas import ANCHOR, BOUNDARY, FIRST_TOKEN, MAPPED, NOT_APPLICABLE, PUNCTUATION, UNMAPPED, WHITESPACE


def share(condition: Column) -> Column:
    """Share of rows on which a condition holds; null conditions are left out."""
    return F.avg(condition.cast("double"))


def drop_first(tokens: DataFrame, position: str = "reference_position") -> DataFrame:
    """The first reference token of a trajectory is measured but never analysed."""
    return tokens.where(F.col(position) > 1)


def with_position(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "reference_position") -> DataFrame:
    """Position from 1 within each group, and the position scaled to 0..1 (0 in a group of one)."""
    group = Window.partitionBy(*keys)
    at, many = F.row_number().over(group.orderBy(*order)), F.count(F.lit(1)).over(group)
    return rows.withColumns({name: at, "_many": many}).withColumn("normalized_position", F.when(F.col("_many") > 1, (F.col(name) - 1) / (F.col("_many") - 1)).otherwise(0.0)).drop("_many")


def _in_order(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def run_length(flag: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Length of the run of true flags that ends at each row."""
    ordered = _in_order(keys, order)
    at = F.row_number().over(ordered)
    # the position of the last row without the flag, found by a running maximum
    broken = F.max(F.when(~F.coalesce(flag, F.lit(False)), at)).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return at - F.coalesce(broken, F.lit(0))


def step_change(value: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """|x(i) - x(i-1)|, null on the first row."""
    return F.abs(value - F.lag(value).over(_in_order(keys, order)))


def trajectories(tokens: DataFrame, keys: Sequence[str], order: Sequence[str], entropy: str = "entropy_top20_normalized", full: str = "entropy_valid_vocab", extra: Sequence[str] = (), thresholds: Sequence[float] = (0.90, 0.99)) -> DataFrame:
    """One row per trajectory: counts, location, spread, runs and step changes.

    `tokens` are analysed tokens (see drop_first); columns named in `extra` get a mean.
    Standard deviations are those of the population.
    """
    ordered = {f"_change_{n}": step_change(F.col(c), keys, order) for n, c in (("top20", entropy), ("full", full))}
    at_least = lambda t: F.col("p1") >= t
    tag = lambda t: f"ge_{round(t * 100):03d}"
    ordered |= {f"_run_{tag(t)}": run_length(at_least(t), keys, order) for t in thresholds}
    aggs = [F.count(F.lit(1)).alias("analysis_token_count")]
    for name, column in (("top20", entropy), ("full", full)):
        x = F.col(column)
        aggs += [
            F.avg(x).alias(f"mean_entropy_{name}"), F.percentile(x, 0.5).alias(f"median_entropy_{name}"), F.stddev_pop(x).alias(f"std_entropy_{name}"), F.sum(x).alias(f"cumulative_entropy_{name}"),
            F.coalesce(F.avg(f"_change_{name}"), F.lit(0.0)).alias(f"mean_abs_entropy_change_{name}"),
        ]
    aggs += [F.avg("p1").alias("mean_p1"), F.percentile("p1", 0.5).alias("median_p1")]
    aggs += [share(at_least(t)).alias(f"fraction_p1_{tag(t)}") for t in thresholds] + [F.max(f"_run_{tag(t)}").cast("long").alias(f"longest_run_p1_{tag(t)}") for t in thresholds]
    aggs += [F.avg(c).alias(f"mean_{c}") for c in extra]
    out = tokens.withColumns(ordered).groupBy(*keys).agg(*aggs)
    return out.withColumns({"special_token_events": F.lit(0).cast("long"), "special_token_fraction": F.lit(0.0), "trajectory_valid": F.lit(True)})


def eligible(status: Column) -> Column:
    """Tokens that could belong to a step."""
    return ~status.isin(WHITESPACE, PUNCTUATION, NOT_APPLICABLE, FIRST_TOKEN)


def step_balanced(tokens: DataFrame, keys: Sequence[str], value: str, step: str = "semantic_step_id", status: str | None = "semantic_mapping_status", condition: str | None = None) -> DataFrame:
    """`step_balanced_mean`: the mean over steps of the means within a step; null without a step or for the anchor condition."""
    inside = F.col(step).isNotNull()
    if status:
        inside &= F.col(status) == MAPPED
    if condition:
        inside &= F.col(condition) != ANCHOR
    by_step = tokens.groupBy(*keys, F.when(inside, F.col(step)).alias("_step")).agg(F.avg(F.when(inside, F.col(value))).alias("_mean"))
    return by_step.groupBy(*keys).agg(F.avg("_mean").alias("step_balanced_mean"))


def mapping_fractions(tokens: DataFrame, keys: Sequence[str], status: str = "semantic_mapping_status") -> DataFrame:
    """Eligible tokens and the shares of them that are mapped, on a boundary or unmapped; 0 without any."""
    s = F.col(status)
    part = lambda kind: F.coalesce(share(F.when(eligible(s), s == kind)), F.lit(0.0))
    return tokens.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.count(F.when(eligible(s), 1)).alias("n_eligible"), part(MAPPED).alias("step_mapped_token_fraction"),
        part(BOUNDARY).alias("boundary_overlap_token_fraction"), part(UNMAPPED).alias("unmapped_token_fraction"),
    )


def coverage(tokens: DataFrame, trajectory: Sequence[str], group: Sequence[str], status: str = "semantic_mapping_status", gate: float = 0.90) -> DataFrame:
    """Mapped tokens of each group: pooled share, mean and least share of a trajectory, the share of all tokens, and both gates."""
    s = F.col(status)
    each = tokens.groupBy(*dict.fromkeys([*group, *trajectory])).agg(F.count(F.lit(1)).alias("_all"), F.count(F.when(eligible(s), 1)).alias("_eligible"), F.count(F.when(s == MAPPED, 1)).alias("_mapped"))
    ratio = F.col("_mapped") / F.nullif(F.col("_eligible"), F.lit(0))
    out = each.groupBy(*group).agg(
        F.sum("_all").alias("all_analyzed"), F.sum("_eligible").alias("eligible"), F.sum("_mapped").alias("mapped"), (F.sum("_mapped") / F.nullif(F.sum("_eligible"), F.lit(0))).alias("pooled_fraction"),
        (F.sum("_mapped") / F.sum("_all")).alias("all_analyzed_fraction"), F.min(ratio).alias("min_trajectory_fraction"), F.avg(ratio).alias("mean_trajectory_fraction"), F.count(F.when(ratio.isNull(), 1)).alias("without_eligible"),
    )
    return out.withColumns({"passes_pooled_gate": F.coalesce(F.col("pooled_fraction") >= gate, F.lit(False)), "passes_mean_gate": F.coalesce((F.col("mean_trajectory_fraction") >= gate) & (F.col("without_eligible") == 0), F.lit(False))})


def moving_rate(batches: DataFrame, keys: Sequence[str], order: Sequence[str], tokens: Column, seconds: Column, trailing: int = 10) -> DataFrame:
    """Progress of ordered batches: rate, mean of the last `trailing` rates, tokens done and remaining, seconds left."""
    ordered = _in_order(keys, order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rate = tokens / F.greatest(seconds, F.lit(1e-9))
    out = batches.withColumn("rate", rate).withColumns({
        "average_rate": F.avg("rate").over(ordered.rowsBetween(1 - trailing, Window.currentRow)), "done_tokens": F.sum(tokens).over(so_far),
        "remaining_tokens": F.coalesce(F.sum(tokens).over(ordered.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)),
    })
    return out.withColumn("eta_seconds", F.col("remaining_tokens") / F.greatest(F.col("average_rate"), F.lit(1e-9)))
