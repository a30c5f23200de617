"""Rules that turn statistics into statuses and verdicts; all are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the frozen rules. Fixed values.
ALPHA, TASKS_NEEDED, FAMILIES_NEEDED = 0.01, 70, 35
ROBUST, SENSITIVE, UNSUPPORTED, NOT_EVALUABLE = "ROBUST", "METRIC-SENSITIVE", "NOT SUPPORTED", "NOT EVALUABLE"
SMALL, DIFFERENT, EQUIVALENT, INCONCLUSIVE = "statistically_detectable_but_practically_small", "statistically_different_potentially_meaningful", "evidence_for_practical_equivalence", "inconclusive"


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def equivalent(low: Column, high: Column, margin: Column) -> Column:
    """The interval lies strictly inside +-margin."""
    return _sure((low > -margin) & (high < margin))


def four_criteria(p: Column, low: Column, positive_tasks: Column, positive_families: Column, alpha: float = ALPHA, tasks: int = TASKS_NEEDED, families: int = FAMILIES_NEEDED) -> dict[str, Column]:
    """The four frozen criteria and whether all hold."""
    each = {"p_below_alpha": _sure(p < alpha), "ci_above_zero": _sure(low > 0), "enough_tasks": _sure(positive_tasks >= tasks), "enough_families": _sure(positive_families >= families)}
    every = each["p_below_alpha"] & each["ci_above_zero"] & each["enough_tasks"] & each["enough_families"]
    return each | {"all_four_pass": every}


def decide(rows: DataFrame, alpha: float = ALPHA, tasks: int = TASKS_NEEDED, families: int = FAMILIES_NEEDED) -> DataFrame:
    """Add the outcome of each contrast.

    Needs n, mean, holm_adjusted_p, ci_low, ci_high, positive, negative, family_positive,
    family_negative, valid_vocab_mean_delta, semantic_step_mean_delta, alternative and margin.
    Directional contrasts pass on a positive mean, adjusted p, interval and sign counts, and are
    robust if both other metrics are positive. Two-sided contrasts are judged in the direction
    seen; one that is not different but equivalent is robust as well. A contrast without units,
    p or interval is not evaluable.
    """
    c = F.col
    two = c("alternative") == "two_sided"
    significant = _sure((c("holm_adjusted_p") < alpha) & ((c("ci_low") > 0) | (c("ci_high") < 0)))
    same = equivalent(c("ci_low"), c("ci_high"), c("margin"))
    up = c("mean") > 0
    signs, family_signs = F.when(up, c("positive")).otherwise(c("negative")), F.when(up, c("family_positive")).otherwise(c("family_negative"))
    nonzero = significant & _sure((signs >= tasks) & (family_signs >= families))
    directional = _sure(up & (c("holm_adjusted_p") < alpha) & (c("ci_low") > 0) & (c("positive") >= tasks) & (c("family_positive") >= families))
    agree_up = _sure((c("valid_vocab_mean_delta") > 0) & (c("semantic_step_mean_delta") > 0))
    agree = _sure((F.signum("valid_vocab_mean_delta") == F.signum("mean")) & (F.signum("semantic_step_mean_delta") == F.signum("mean")))
    out = rows.withColumns({
        "difference_significant": F.when(two, significant), "equivalent": F.when(two, same), "primary_nonzero_pass": F.when(two, nonzero), "primary_pass": F.when(~two, directional),
        "task_sign_count_in_observed_direction": F.when(two, signs), "family_sign_count_in_observed_direction": F.when(two, family_signs),
        "interpretation": F.when(two, F.when(significant & same, SMALL).when(significant, DIFFERENT).when(same, EQUIVALENT).otherwise(INCONCLUSIVE)),
        "directional_robustness_matches": F.when(two & nonzero, agree),
    })
    fine = (c("n") > 0) & c("holm_adjusted_p").isNotNull() & c("ci_low").isNotNull()
    status = F.when(~_sure(fine), NOT_EVALUABLE).when(two, F.when(nonzero, F.when(agree, ROBUST).otherwise(SENSITIVE)).when(same, ROBUST).otherwise(UNSUPPORTED))
    return out.withColumn("result_status", status.when(directional, F.when(agree_up, ROBUST).otherwise(SENSITIVE)).otherwise(UNSUPPORTED))


def across_models(decided: DataFrame, model: str = "model", contrast: str = "contrast", models: int | None = None) -> DataFrame:
    """One row per contrast over all models: statuses, replication, robustness, equivalence, heterogeneity.

    With `models`, a contrast that another number of models has reported replicates nothing.
    """
    c = F.col
    many = F.count(F.lit(1)).alias("n_models")
    direction = F.when(c("difference_significant"), F.when(c("mean") > 0, 1).otherwise(-1))
    out = decided.groupBy(contrast, "alternative").agg(
        many, F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c(model), c("result_status")))))).alias("model_statuses"),
        _sure(F.bool_and("primary_pass")).alias("_pass"), F.bool_and(c("result_status") == ROBUST).alias("_robust"), F.count(F.when(c("difference_significant"), 1)).alias("_significant"),
        F.min(direction).alias("_low"), F.max(direction).alias("_high"), _sure(F.bool_and("primary_nonzero_pass")).alias("_nonzero"), _sure(F.bool_and("equivalent")).alias("_equivalent"),
    )
    two, whole = c("alternative") == "two_sided", F.lit(True) if models is None else c("n_models") == models
    difference = whole & (c("_significant") == c("n_models")) & _sure(c("_low") == c("_high")) & c("_nonzero") & c("_robust")
    same = whole & c("_equivalent")
    return out.select(
        contrast, "n_models", "model_statuses", F.when(~two, whole & c("_pass")).alias("fully_cross_model_replicated"), F.when(~two, whole & c("_robust")).alias("fully_cross_model_robust"),
        F.when(two, difference).alias("cross_model_nonzero_difference_replicated"), F.when(two, same).alias("cross_model_practical_equivalence"), F.when(two, ~difference & ~same).alias("heterogeneous"),
    )


def margins(rows: DataFrame, registry: DataFrame, key: str, name: str = "margin") -> DataFrame:
    """Join each row's equivalence margin from the registry; a key without exactly one entry is an error."""
    entries = registry.groupBy(F.col("model_id").alias("_id")).agg(F.first("c4_equivalence_margin").alias(name), F.count(F.lit(1)).alias("_entries"))
    out = rows.join(entries, rows[key] == F.col("_id"), "left")
    fine = F.assert_true(F.coalesce(F.col("_entries") == 1, F.lit(False)), F.concat(F.lit("no single registry entry for "), F.col(key)))
    return out.withColumn(name, F.when(fine.isNull(), F.col(name))).drop("_id", "_entries")


