"""The analysis from trajectories to decisions, and the publication tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parallax import schemas
from parallax.operators import contrast, decide, gates, infer

#: Trajectory columns behind the three metrics. Fixed values.
METRIC_COLUMNS = {"h20": "mean_entropy_top20", "valid_vocab": "mean_entropy_valid_vocab", "semantic_step": "semantic_step_balanced_entropy_top20"}


def contrasts_of(trajectories: DataFrame, definitions: DataFrame | None = None, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Task and family contrasts of trajectory rows; `by` holds further keys, such as the model."""
    defs = definitions if definitions is not None else contrast.definitions(trajectories.sparkSession)
    rows = trajectories.select(*by, "task_id", "family", "condition", *(F.col(c).alias(m) for m, c in METRIC_COLUMNS.items()))
    means = contrast.condition_means(rows, [*by, "task_id", "family", "condition"], list(METRIC_COLUMNS))
    tasks = contrast.contrasts(means, defs, [*by, "task_id", "family"], "condition", list(METRIC_COLUMNS))
    families = contrast.family_means(tasks.where("paired"), [*by, "contrast", "left_condition", "right_condition", "alternative", "family"], [f"delta_{m}" for m in METRIC_COLUMNS])
    return tasks, families


def unpaired(tasks: DataFrame) -> DataFrame:
    """Units that lack one side of a contrast: the key sets of both conditions must be equal."""
    return tasks.where("not paired")


def summaries(tasks: DataFrame, families: DataFrame, margins: DataFrame | None = None, by: Sequence[str] = (), flips: int = infer.SIGN_FLIPS, boots: int = infer.BOOTSTRAPS) -> DataFrame:
    """One row per contrast with all statistics of both levels, adjusted p-values and the decision.

    margins: (by..., contrast, margin) for two-sided contrasts.
    """
    keys = [*by, "contrast"]
    paired = tasks.where("paired").withColumn("two_sided", F.col("alternative") == "two_sided")
    families = families.withColumn("two_sided", F.col("alternative") == "two_sided")

    def level(rows: DataFrame, unit: Sequence[str], prefix: str) -> DataFrame:
        described = infer.describe(rows, keys, "delta_h20")
        resampled = infer.resample(rows, keys, unit, "delta_h20", "two_sided", flips, boots).drop("n_units")
        both = described.join(resampled, keys)
        return both.select(*keys, *(F.col(c).alias(f"{prefix}{c}") for c in both.columns if c not in keys))

    head = paired.groupBy(*keys, "left_condition", "right_condition", "alternative").agg(F.avg("delta_valid_vocab").alias("valid_vocab_mean_delta"), F.avg("delta_semantic_step").alias("semantic_step_mean_delta"))
    out = head.join(level(paired, ["task_id", "family"], ""), keys).join(level(families, ["family"], "family_"), keys)
    out = infer.holm(out, list(by), "signflip_p", "contrast")
    out = out.withColumn("exact_sign_p", infer.exact_sign_p(F.col("positive"), F.col("n"), F.col("alternative") == "two_sided"))
    out = out.join(margins, keys, "left") if margins is not None else out.withColumn("margin", F.lit(None).cast("double"))
    return decide.decide(out)


def analyse(trajectories: DataFrame, n_trajectories: int, n_cells: int, margins: DataFrame | None = None, **more) -> DataFrame:
    """Gates, contrasts, inference and decision for one model's trajectories."""
    gates.enforce(gates.trajectory_gates(trajectories, n_trajectories, n_cells, covered=schemas.CONDITIONS[1:]))
    tasks, families = contrasts_of(trajectories)
    if not unpaired(tasks).isEmpty():
        raise gates.GateError("a contrast has units with one side only")
    return summaries(tasks, families, margins, **more)


def replication_analysis(deltas: DataFrame, by: Sequence[str], left: str, right: str, delta: str, flips: int = infer.SIGN_FLIPS, boots: int = infer.BOOTSTRAPS) -> DataFrame:
    """The two-condition analysis: statistics of task deltas, family spread, relative reduction and the four criteria.

    deltas: (by..., task_id, family, left, right, delta).
    """
    described = infer.describe(deltas, by, delta)
    resampled = infer.resample(deltas, by, ["task_id", "family"], delta, None, flips, boots).drop("n_units")
    spread = contrast.family_spread(contrast.family_means(deltas, [*by, "family"], [delta]), by, delta)
    levels = deltas.groupBy(*by).agg(F.avg(left).alias("mean_left"), F.avg(right).alias("mean_right"), contrast.relative_reduction(F.col(left), F.col(right)).alias("relative_reduction"))
    out = described.join(resampled, by).join(spread, by).join(levels, by)
    rules = decide.four_criteria(F.col("signflip_p"), F.col("ci_low"), F.col("positive"), F.col("positive_families"))
    return out.withColumns(rules)


def replication_table(analysed: DataFrame) -> DataFrame:
    """Table 1: one row per model."""
    return analysed.select("model_slug", F.col("mean").alias("mean_delta_nl_minus_python"), F.col("ci_low").alias("ci99_low"), F.col("ci_high").alias("ci99_high"), F.col("positive").alias("positive_tasks"), F.col("n").alias("total_tasks"), "cohens_dz")


def intervention_table(decided: DataFrame) -> DataFrame:
    """Table 2: one row per model and contrast; margins only where the contrast is two-sided."""
    two = F.col("alternative") == "two_sided"
    return decided.select(
        "model_slug", "contrast", "left_condition", "right_condition", F.col("mean").alias("mean_delta"), F.col("ci_low").alias("ci99_low"), F.col("ci_high").alias("ci99_high"), F.col("positive").alias("positive_tasks"),
        F.col("n").alias("total_tasks"), "result_status", "valid_vocab_mean_delta", F.col("semantic_step_mean_delta").alias("semantic_step_balanced_mean_delta"), F.when(two, F.col("margin")).alias("equivalence_margin"), F.when(two, F.col("equivalent")).alias("equivalent"),
    )


def condition_table(trajectories: DataFrame) -> DataFrame:
    """Table 3: the mean of each model and condition, with the condition's place in the fixed order."""
    order = F.array(*(F.lit(c) for c in schemas.CONDITIONS))
    out = trajectories.groupBy("model_slug", "condition").agg(F.avg("mean_entropy_top20").alias("mean_entropy_top20"))
    return out.withColumn("place", F.array_position(order, F.col("condition")).cast("int"))


def family_table(replicated: DataFrame, decided: DataFrame) -> DataFrame:
    """Table 4: families of the two-condition studies and of each contrast."""
    none = F.lit(None).cast("double")
    first = replicated.select("model_slug", F.lit("NL-Python").alias("contrast"), "positive_families", "total_families", "mean_family_delta", "min_family_delta", "max_family_delta")
    second = decided.select("model_slug", "contrast", F.col("family_positive").alias("positive_families"), F.col("family_n").alias("total_families"), F.col("family_mean").alias("mean_family_delta"), none.alias("min_family_delta"), none.alias("max_family_delta"))
    return first.unionByName(second)


def profile_rows(trajectories: DataFrame) -> DataFrame:
    """Plot-ready rows: each model's line over the conditions, with the step from the condition before and how many trajectories a point has."""
    order = F.array(*(F.lit(c) for c in schemas.CONDITIONS))
    points = trajectories.groupBy("model_slug", "condition").agg(F.avg("mean_entropy_top20").alias("y"), F.count("mean_entropy_top20").alias("n"))
    points = points.withColumn("x", F.array_position(order, F.col("condition")).cast("int"))
    # a model has as many points as there are conditions
    return points.withColumn("step", F.col("y") - F.lag("y").over(Window.partitionBy("model_slug").orderBy("x")))


def forest_rows(decided: DataFrame) -> DataFrame:
    """Plot-ready rows: point, interval and place of each contrast."""
    place = F.row_number().over(Window.partitionBy("contrast").orderBy("model_slug"))
    return decided.select("model_slug", "contrast", F.col("mean").alias("x"), F.col("ci_low").alias("x_low"), F.col("ci_high").alias("x_high"), place.alias("place"))


def equivalence_rows(decided: DataFrame) -> DataFrame:
    """Plot-ready rows: interval and margins of each two-sided contrast."""
    return decided.where("alternative = 'two_sided'").select("model_slug", "contrast", "ci_low", "ci_high", (-F.col("margin")).alias("margin_low"), F.col("margin").alias("margin_high"), "equivalent")
