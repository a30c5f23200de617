"""Queries over the fixed corpus of small programs, and their recorded answers.

Most answers in `recorded.json` were not made by this engine: step spans come from the lines of a
text, renamed texts from a replacement of words, histograms, steps and constructs from a plain walk
of the syntax tree, resampling from a direct run of the generator over the SQL engine's deltas.
The prose, controlled and pseudocode texts are an exception: this engine wrote them, and a reading
against the wording rules found them right, so they guard against changes and are no independent proof.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax import schemas
from parallax.operators.programs import frames, ir
from parallax.plans import stimuli
from parallax.plans.queries import CORPUS, _programs, query

RECORDED: dict[str, dict[str, list]] = json.loads((Path(__file__).parent / "recorded.json").read_text(encoding="utf-8"))
#: Texts that are no programs, one for each reason.
BROKEN = (
    ("two_functions", "def a(x):\n    return x\ndef b(x):\n    return x\n"),
    ("decorated", "@d\ndef a(x):\n    return x\n"),
    ("default", "def a(x=1):\n    return x\n"),
    ("star", "def a(*x):\n    return x\n"),
    ("comprehension", "def a(x):\n    return [y for y in x]\n"),
    ("lambda_and_try", "def a(x):\n    try:\n        return lambda: x\n    except Error:\n        pass\n"),
    ("assertion", "def a(x):\n    assert x\n"),
    ("fine", "def a(x):\n    return x\n"),
)
SAMPLE, SAMPLE_SEED = 2, 20260716


def _tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, family, f"Write {name}.", [f"{name} in words"], [source]) for name, family, source in CORPUS], schemas.TASK)


@query
def program_steps(spark: SparkSession, d: str) -> DataFrame:
    return frames.steps(_programs(spark)).select("program_id", "semantic_step_id", "kind", "path_key", "trace_node_id")


@query
def program_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.render_programs(_programs(spark)).select("trajectory_id", F.explode("semantic_step_spans").alias("_s"))
    return rows.select("trajectory_id", "_s.semantic_step_id", "_s.start_char", "_s.end_char")


@query
def trace_spans(spark: SparkSession, d: str) -> DataFrame:
    """Trace nodes that do not have the span of the step that owns them; there is none."""
    rendered = frames.render_programs(_programs(spark)).where(F.size("trace_spans") > 0)
    owners = _programs(spark).select("program_id", F.explode("trace_nodes").alias("_n")).select("program_id", "_n.trace_node_id", F.col("_n.owner_semantic_step_id").alias("semantic_step_id"))
    nodes = rendered.select("trajectory_id", "program_id", F.explode("trace_spans").alias("_t")).select("trajectory_id", "program_id", "_t.*").join(owners, ["program_id", "trace_node_id"], "left")
    steps = rendered.select("trajectory_id", F.explode("semantic_step_spans").alias("_s")).select("trajectory_id", "_s.semantic_step_id", F.col("_s.start_char").alias("a"), F.col("_s.end_char").alias("b"))
    wrong = ~(F.col("start_char").eqNullSafe(F.col("a")) & F.col("end_char").eqNullSafe(F.col("b")))
    return nodes.join(steps, ["trajectory_id", "semantic_step_id"], "left").groupBy("program_id").agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(wrong, 1)).alias("wrong"))


@query
def renaming_table(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.rename_programs(_programs(spark), "program_id", "source_python")
    return rows.select("program_id", F.posexplode("mapping").alias("place", "_m")).select("program_id", "place", "_m.original", "_m.opaque")


@query
def program_constructs(spark: SparkSession, d: str) -> DataFrame:
    return frames.constructs(_programs(spark)).select("task_id", F.array_join("constructs", ",").alias("constructs"))


@query
def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    """Tasks for a person to look through: a seeded sample that shows every construct of the corpus."""
    by_task = {r.task_id: set(r.constructs) for r in frames.constructs(_programs(spark)).limit(1000).collect()}
    chosen = ir.audit_sample(by_task, set().union(*by_task.values()), SAMPLE, SAMPLE_SEED)
    return spark.createDataFrame(list(enumerate(chosen)), "place int, task_id string")


@query
def audit_records(spark: SparkSession, d: str) -> DataFrame:
    rows = stimuli.audit_rows(frames.render_programs(_programs(spark)), [name for name, *_ in CORPUS])
    return rows.groupBy("task_id", "validation_flags").agg(F.count(F.lit(1)).alias("records"), F.sum("semantic_step_count").alias("steps"), F.count("opaque_mapping").alias("mappings"))


@query
def differential_programs(spark: SparkSession, d: str) -> DataFrame:
    """The corpus is part of this engine, so it may be executed."""
    runs = frames.differential_runs(frames.render_programs(_programs(spark)), allow_execution=True, budget=180.0)
    return runs.select("program_id", "passed", "case_count")


@query
def rejected_programs(spark: SparkSession, d: str) -> DataFrame:
    return frames.rejected(spark.createDataFrame(list(BROKEN), "key string, source string"), "key", "source")


@query
def tree_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Trees written as plain data and read back, against the parsed text."""

    def work(row: dict) -> Iterator[dict]:
        back = ir.load(json.loads(row["ast"]))
        yield {"program_id": row["program_id"], "same": ast.dump(back, include_attributes=True) == ast.dump(ast.parse(row["source_python"]).body[0], include_attributes=True)}

    return frames.each_row(_programs(spark).select("program_id", "source_python", "ast"), "program_id string, same boolean", work)


@query
def stimuli_report(spark: SparkSession, d: str) -> DataFrame:
    programs = _programs(spark)
    return stimuli.report(_tasks(spark), programs, frames.render_programs(programs), variants=1, allow_execution=True, coverage=False)


def literal(value: Any) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else repr(value)


def values(columns: str, types: list[str], rows: list[list]) -> str:
    """A relation of literal rows."""
    names = columns.split(", ")
    body = ", ".join(f"({', '.join(map(literal, r))})" for r in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in zip(names, types, strict=True))} FROM (VALUES {body}) r({', '.join(names)})"


def recorded(name: str, columns: str) -> str:
    return values(columns, **RECORDED[name])


def _sized(name: str, columns: str, rounded: tuple[str, ...]) -> str:
    """Recorded rows of the scale that the line items have."""
    out = ", ".join(f"round({c}, 6) + 0.0 AS {c}" if c in rounded else c for c in columns.split(", ")[1:])
    return f"SELECT {out} FROM ({recorded(name, columns)}) WHERE rows_seen = (SELECT count(*) FROM lineitem)"


_DOUBLES = ("signflip_p", "ci_low", "ci_high", "wilcoxon_p", "t_test_p")
_RESAMPLED = "rows_seen, contrast, n_units, extreme_resamples, n_resamples, " + ", ".join(_DOUBLES)
_CHECKS = ("repeated_trajectories", "cells_of_other_size", "tasks_without_all_conditions", "changed_anchors", "lines_without_interface", "span_errors", "not_alpha_equivalent", "failed_programs")
_PROBLEMS = [
    ["two_functions", "expected one top-level function"], ["decorated", "decorators are not supported"], ["default", "default values are not supported"], ["star", "only positional parameters are supported"],
    ["comprehension", "forbidden syntax: ListComp"], ["lambda_and_try", "forbidden syntax: Try; forbidden syntax: Lambda"], ["assertion", "unsupported statement: Assert"],
]

SQL = {
    "render_programs": recorded("render_programs", "trajectory_id, condition, reference_text, n_steps, n_nodes"),
    "rename_programs": recorded("rename_programs", "program_id, source, globals"),
    "construct_histogram": recorded("construct_histogram", "node_type, n"),
    "program_steps": recorded("program_steps", "program_id, semantic_step_id, kind, path_key, trace_node_id"),
    "program_spans": recorded("program_spans", "trajectory_id, semantic_step_id, start_char, end_char"),
    "trace_spans": f"WITH r AS ({recorded('render_programs', 'trajectory_id, condition, reference_text, n_steps, n_nodes')}) SELECT split_part(trajectory_id, '__', 1) || '__v1' AS program_id, sum(n_nodes)::BIGINT AS nodes, 0::BIGINT AS wrong FROM r GROUP BY 1",
    "renaming_table": recorded("renaming_table", "program_id, place, original, opaque"),
    "program_constructs": recorded("program_constructs", "task_id, constructs"),
    "audit_sample": recorded("audit_sample", "place, task_id"),
    "audit_records": f"WITH r AS ({recorded('render_programs', 'trajectory_id, condition, reference_text, n_steps, n_nodes')}) SELECT split_part(trajectory_id, '__', 1) AS task_id, 'pending_human_review' AS validation_flags, count(*) AS records, sum(n_steps)::BIGINT AS steps, 1::BIGINT AS mappings FROM r GROUP BY 1",
    "differential_programs": recorded("differential_programs", "program_id, passed, case_count"),
    "rejected_programs": values("key, problem", ["VARCHAR", "VARCHAR"], _PROBLEMS),
    "tree_round_trip": values("program_id, same", ["VARCHAR", "BOOLEAN"], [[f"{name}__v1", True] for name, *_ in CORPUS]),
    "stimuli_report": values('"check", expected, actual, passed', ["VARCHAR"] * 3 + ["BOOLEAN"], [[c, "0", "0", True] for c in _CHECKS]),
    "seeded_order": f"WITH n AS (SELECT count(*) AS suppliers FROM supplier), r AS ({recorded('seeded_order', 'suppliers, ord, s_suppkey')}) SELECT s_suppkey, ord FROM r JOIN n USING (suppliers)",
    "resample_numpy": _sized("resample_numpy", _RESAMPLED, _DOUBLES),
    "cluster_bootstrap": _sized("cluster_bootstrap", _RESAMPLED, _DOUBLES),
}
