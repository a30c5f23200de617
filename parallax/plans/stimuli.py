"""Validation of rendered stimuli: one report of checks over programs and renderings."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax import schemas
from parallax.operators import contrast, gates, spans, summarise
from parallax.operators.programs import frames, rename
from parallax.sources import manifest, readers

CELLS = len(schemas.CONDITIONS)


def corpus_report(spark: SparkSession, path: str, sha256: str, tasks: int, families: int, per_family: int = 2, variants: int = 3) -> DataFrame:
    """The gates of a frozen task corpus: its hash, its counts, and that every program parses. `path` is one local JSON document."""
    rows = readers.tasks(spark, path)
    found = manifest.sha256_file(Path(path))
    report = gates.check_rows(spark, [("corpus_sha256", sha256, found, sha256 == found)]).unionByName(gates.corpus_gates(rows, tasks, families, per_family, variants))
    sources = rows.select("id", F.explode("python").alias("source"))
    return report.unionByName(_count("programs_not_parseable", frames.rejected(sources, "id", "source")))


def _count(check: str, rows: DataFrame) -> DataFrame:
    """A check that a table of failures is empty."""
    return gates.expectations(rows, {check: (F.count(F.lit(1)), 0)})


def changed_anchors(tasks: DataFrame, rendered: DataFrame) -> DataFrame:
    """Renderings of the two frozen conditions that differ from the task's own text."""
    own = contrast.specs(tasks).select(F.col("task_id").alias("_t"), F.col("variant").alias("_v"), F.when(F.col("representation") == "nl", schemas.ANCHOR).otherwise("python_canonical").alias("_c"), "reference")
    frozen = rendered.where(F.col("condition").isin(schemas.ANCHOR, "python_canonical"))
    both = frozen.join(own, (F.col("task_id") == F.col("_t")) & (F.col("variant") == F.col("_v")) & (F.col("condition") == F.col("_c")), "left")
    return both.where(~F.col("reference_text").eqNullSafe(F.col("reference"))).select("trajectory_id")


def without_interface(rendered: DataFrame, programs: DataFrame) -> DataFrame:
    """Structured renderings whose first line does not name the program's function."""
    first = F.substring_index("reference_text", "\n", 1)
    rows = rendered.where(F.col("condition").isin("procedural_prose", "controlled_nl", "pseudocode")).join(programs.select("program_id", "function_name"), "program_id")
    return rows.where(~first.contains(F.col("function_name"))).select("trajectory_id")


def not_equivalent(rendered: DataFrame) -> DataFrame:
    """Opaque programs that differ from their originals by more than names."""

    def work(row: dict) -> Iterator[dict]:
        if not rename.same_up_to_names(row["source_python"], row["reference_text"], {x["original"]: x["opaque"] for x in row["mapping"]}):
            yield {"trajectory_id": row["trajectory_id"]}

    rows = rendered.where(F.col("condition") == "python_opaque").select("trajectory_id", "source_python", "reference_text", F.col("opacity.mapping").alias("mapping"))
    return frames.each_row(rows, "trajectory_id string", work)


def step_coverage(rendered: DataFrame, pattern: str = spans.PIECES) -> DataFrame:
    """Coverage of each derived condition by steps, under the built-in tokenizer."""
    rows = rendered.where(F.col("condition") != schemas.ANCHOR)
    tokens = spans.tokenize(rows, ["trajectory_id", "condition"], "reference_text", pattern)
    mapped = spans.map_steps(tokens.join(rows.select("trajectory_id", F.col("semantic_step_spans").alias("spans")), "trajectory_id"), position="pos")
    return summarise.coverage(mapped.where("pos > 1"), ["trajectory_id"], ["condition"])


def report(tasks: DataFrame, programs: DataFrame, rendered: DataFrame, variants: int = 3, allow_execution: bool = False, coverage: bool = True) -> DataFrame:
    """(check, expected, actual, passed) over all checks; execution only for trusted corpora."""
    each = rendered.select("trajectory_id", F.length("reference_text").alias("_n"), F.explode("semantic_step_spans").alias("_s")).select("trajectory_id", "_n", "_s.*")
    cells = rendered.groupBy("task_id", "condition").agg(F.count(F.lit(1)).alias("n"))
    checks = [
        _count("repeated_trajectories", contrast.duplicates(rendered, ["trajectory_id"])),
        _count("cells_of_other_size", cells.where(F.col("n") != variants)),
        _count("tasks_without_all_conditions", cells.groupBy("task_id").count().where(F.col("count") != CELLS)),
        _count("changed_anchors", changed_anchors(tasks, rendered)),
        _count("lines_without_interface", without_interface(rendered, programs)),
        _count("span_errors", spans.span_errors(each, ["trajectory_id"], "_n")),
        _count("not_alpha_equivalent", not_equivalent(rendered)),
    ]
    if coverage:
        checks.append(_count("conditions_below_coverage", step_coverage(rendered).where("not passes_pooled_gate")))
    if allow_execution:
        checks.append(_count("failed_programs", frames.differential_runs(rendered, allow_execution=True).where("not passed")))
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def audit_rows(rendered: DataFrame, tasks: list[str]) -> DataFrame:
    """The records that a person looks through, for a chosen set of tasks."""
    return rendered.where(F.col("task_id").isin(tasks)).select(
        "task_id", "family", "variant", "condition", "task_text", "reference_text", "source_python", F.to_json("opacity.mapping").alias("opaque_mapping"),
        F.size("semantic_step_spans").alias("semantic_step_count"), F.lit("pending_human_review").alias("validation_flags"),
    )
