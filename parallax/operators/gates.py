"""Integrity gates: expectations as rows, reconciliation, audits.

A gate is first a table (check, expected, actual, passed); `enforce` turns failures into an
exception where a run must stop.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def expectations(rows: DataFrame, checks: Mapping[str, tuple[Column, Any]]) -> DataFrame:
    """One row per check, from one pass over `rows`; checks: name to (aggregate, expected value)."""
    single = rows.agg(*(value.alias(f"_{k}") for k, (value, _) in enumerate(checks.values())))
    entries = [
        F.struct(F.lit(name).alias("check"), F.lit(expected).cast("string").alias("expected"), F.col(f"_{k}").cast("string").alias("actual"), F.coalesce(F.col(f"_{k}") == F.lit(expected), F.lit(False)).alias("passed"))
        for k, (name, (_, expected)) in enumerate(checks.items())
    ]
    return single.select(F.explode(F.array(*entries)).alias("_c")).select("_c.*")


class GateError(RuntimeError):
    """A gate did not hold."""


def enforce(report: DataFrame, limit: int = 20) -> None:
    """Raise if a check failed; names the first few."""
    failed: list[Row] = report.where("not passed").limit(limit).collect()
    if failed:
        raise GateError("; ".join(f"{r.check}: expected {r.expected}, found {r.actual}" for r in failed))


def trajectory_gates(rows: DataFrame, trajectories: int, cells: int, variants: int = 3, covered: Sequence[str] = (), gate: float = 0.90) -> DataFrame:
    """Count, identity, validity, completeness and coverage of trajectory rows before analysis."""
    # both levels are aggregations; the second one reads one row per cell
    report = expectations(rows, {"trajectories": (F.count(F.lit(1)), trajectories), "distinct_ids": (F.count_distinct("trajectory_id"), trajectories), "all_valid": (F.coalesce(F.bool_and("trajectory_valid"), F.lit(False)), True)})
    cell = rows.groupBy("task_id", "condition").agg(F.count(F.lit(1)).alias("n"))
    report = report.unionByName(expectations(cell, {"cells": (F.count(F.lit(1)), cells), "cells_of_other_size": (F.count(F.when(F.col("n") != variants, 1)), 0)}))
    if covered:
        x = F.col("step_mapped_token_fraction")
        report = report.unionByName(expectations(rows, {f"coverage_{c}": (F.coalesce((F.avg(F.when(F.col("condition") == c, x)) >= gate) & (F.count(F.when((F.col("condition") == c) & x.isNull(), 1)) == 0), F.lit(False)), True) for c in covered}))
    return report


def corpus_gates(tasks: DataFrame, tasks_expected: int, families_expected: int, per_family: int = 2, variants: int = 3) -> DataFrame:
    """Counts, per-family size, and distinct variants of a task corpus."""
    distinct = lambda c: F.size(F.array_distinct(c)) == variants
    report = expectations(tasks, {
        "tasks": (F.count(F.lit(1)), tasks_expected), "task_ids": (F.count_distinct("id"), tasks_expected), "families": (F.count_distinct("family"), families_expected),
        "tasks_without_distinct_nl": (F.count(F.when(~F.coalesce(distinct("nl"), F.lit(False)), 1)), 0), "tasks_without_distinct_python": (F.count(F.when(~F.coalesce(distinct("python"), F.lit(False)), 1)), 0),
        "trajectories": (F.coalesce(F.sum(F.size("nl") + F.size("python")), F.lit(0)), tasks_expected * variants * 2),
    })
    sizes = tasks.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    return report.unionByName(expectations(sizes, {"families_of_other_size": (F.count(F.when(F.col("n") != per_family, 1)), 0)}))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only (keys, side); empty if both sets are equal."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Manifest against files, both (path, size_bytes, sha256): one row per path with its status.

    missing, unlisted, size_mismatch, hash_mismatch or ok.
    """
    e = expected.select(F.col("path"), F.col("size_bytes").alias("expected_size"), F.col("sha256").alias("expected_sha256"), F.lit(True).alias("_listed"))
    a = actual.select(F.col("path"), F.col("size_bytes").alias("actual_size"), F.col("sha256").alias("actual_sha256"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "missing").when(F.col("_listed").isNull(), "unlisted").when(~F.col("expected_size").eqNullSafe(F.col("actual_size")), "size_mismatch").when(~F.col("expected_sha256").eqNullSafe(F.col("actual_sha256")), "hash_mismatch").otherwise("ok")
    return e.join(a, "path", "full_outer").select("path", "expected_size", "actual_size", status.alias("status"))


def number_audit(expected: DataFrame, actual: DataFrame, keys: Sequence[str], value: str = "value", tolerance: float = 1e-12) -> DataFrame:
    """Each expected number with the one found and whether they agree within an absolute tolerance."""
    found = actual.select(*keys, F.col(value).alias("actual"))
    out = expected.select(*keys, F.col(value).alias("expected")).join(found, list(keys), "left")
    return out.withColumn("passed", F.coalesce(F.abs(F.col("expected") - F.col("actual")) <= tolerance, F.lit(False)))


def pattern_hits(rows: DataFrame, keys: Sequence[str], text: str, patterns: Mapping[str, str]) -> DataFrame:
    """(keys, pattern) of each named regex that a text holds."""
    names = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.lit(n)) for n, p in patterns.items())))
    return rows.select(*keys, F.explode(names).alias("pattern"))


def canonical_json(value: Any) -> str:
    """Sorted keys, no blanks, no ASCII escapes."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def canonical_row(rows: DataFrame, columns: Sequence[str]) -> Column:
    """canonical_json() of some columns of each row; nulls are written."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns) if c in rows.columns)), {"ignoreNullFields": "false"})


def json_sha256(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def content_sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def immutable(stored: Mapping[str, Any], now: Mapping[str, Any], keys: Sequence[str]) -> list[str]:
    """Keys of a resumed run's configuration that differ from the stored one."""
    return [k for k in keys if stored.get(k) != now.get(k)]


def require_confirmed(confirmed: bool, validated_sha256: str | None, current_sha256: str) -> None:
    """A real run needs an explicit confirmation and stimuli that are unchanged since validation."""
    if not confirmed:
        raise GateError("a real run must be confirmed")
    if validated_sha256 != current_sha256:
        raise GateError("the stimuli have changed since they were validated")


def check_rows(spark: SparkSession, rows: Sequence[tuple[str, str, str, bool]]) -> DataFrame:
    return spark.createDataFrame(list(rows), "check string, expected string, actual string, passed boolean")
