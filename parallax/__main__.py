"""Command line of the analysis: python -m parallax COMMAND --help."""

from __future__ import annotations

import argparse
import json
import platform
import sys
import time
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax import schemas
from parallax.functions import distribution
from parallax.operators import contrast, decide, gates, resume, spans, summarise
from parallax.operators.programs import frames
from parallax.plans import publish
from parallax.sources import manifest, readers, writers

#: Keys of a run's configuration that must not change when the run goes on.
FROZEN = ("scores", "top_k", "valid_vocab", "first_position", "stimuli_sha256")


def session() -> SparkSession:
    return SparkSession.builder.appName("parallax").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def environment(spark: SparkSession) -> dict[str, Any]:
    """What a run ran on."""
    context = spark.sparkContext
    return {
        "spark": spark.version, "python": platform.python_version(), "java": context._jvm.System.getProperty("java.version"), "platform": platform.platform(), "master": context.master,
        "parallelism": context.defaultParallelism, "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")), "executor_memory": context.getConf().get("spark.executor.memory", None),
    }


def measure(spark: SparkSession, a: argparse.Namespace) -> None:
    """Measure score vectors and summarise trajectories; goes on where a broken run stopped.

    A real run has to be confirmed, and its stimuli must be those that were validated.
    """
    gates.require_confirmed(a.confirm_real_run, "", "")
    validated = json.loads(Path(a.validation).read_text())
    if not validated.get("passed"):
        raise gates.GateError("the validation report does not pass")
    stimuli = manifest.store_sha256(spark, a.stimuli)
    gates.require_confirmed(True, validated.get("stimuli_sha256"), stimuli)
    out = Path(a.results_dir)
    config = {"scores": a.scores, "top_k": a.top_k, "valid_vocab": a.valid_vocab, "first_position": 1, "stimuli_sha256": stimuli}
    if (out / "config.json").exists():
        if changed := gates.immutable(json.loads((out / "config.json").read_text()), config, FROZEN):
            raise gates.GateError(f"the stored run has other settings: {', '.join(changed)}")
    else:
        writers.write_json(out / "config.json", config | {"started_at": datetime.now(UTC).isoformat(), "environment": environment(spark)})
    work = spark.read.parquet(a.scores)
    target = f"{a.results_dir}/trajectories.parquet"
    there = spark.read.parquet(target) if Path(target).exists() else spark.createDataFrame([], "trajectory_id string")
    ids = resume.remaining(resume.completed(work), resume.completed(there), ["trajectory_id"])
    if a.limit:
        ids = ids.orderBy("trajectory_id").limit(a.limit)
    work = work.join(ids, "trajectory_id", "left_semi")
    run = distribution.measure_wide if a.wide else distribution.measure
    tokens = run(work, k=a.top_k, vocab=a.valid_vocab).withColumnsRenamed({"entropy_top": "entropy_top20_normalized", "entropy": "entropy_valid_vocab"})
    begun = time.monotonic()
    writers.append_new(tokens, f"{a.results_dir}/tokens.parquet", ["trajectory_id", "reference_position"])
    done = spark.read.parquet(f"{a.results_dir}/tokens.parquet").join(ids, "trajectory_id", "left_semi")
    keys = ["trajectory_id", *(c for c in ("task_id", "family", "condition", "variant") if c in done.columns)]
    writers.append_new(summarise.trajectories(summarise.drop_first(done), keys, ["reference_position"], extra=("top_mass", "reference_surprisal")), target, ["trajectory_id"])
    print(progress(resume.completed(spark.read.parquet(target)).count(), resume.completed(spark.read.parquet(a.scores)).count(), done.count(), time.monotonic() - begun))


def progress(finished: int, total: int, tokens: int, seconds: float) -> str:
    """One line on how far a run is: trajectories, rate, and the time that the rest takes at this rate."""
    left = (total - finished) * seconds / max(1, finished)
    return f"{finished} of {total} trajectories, {tokens} tokens in {seconds:.0f} s ({tokens / max(seconds, 1e-9):.0f} a second), about {left:.0f} s left"


def _trajectories(spark: SparkSession, folder: str) -> DataFrame:
    path = Path(folder)
    if (path / "trajectories.parquet").exists():
        return spark.read.parquet(str(path / "trajectories.parquet"))
    return readers.csv_table(spark, str(path / "trajectories.csv"), schemas.TRAJECTORY)


def analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    """Gates, contrasts, inference and decisions of one model."""
    rows = _trajectories(spark, a.results_dir)
    margin = readers.entry_of(readers.registry(spark, a.registry), a.model_slug)["c4_equivalence_margin"] if a.registry else None
    two = [c[0] for c in schemas.CONTRASTS if c[3] == "two_sided"]
    margins = spark.createDataFrame([(c, margin) for c in two], "contrast string, margin double")
    counts = rows.agg(F.count(F.lit(1)), F.count_distinct("task_id", "condition")).first()
    found = publish.analyse(rows, a.trajectories or counts[0], a.cells or counts[1], margins, flips=a.sign_flips, boots=a.bootstraps)
    tasks, families = publish.contrasts_of(rows)
    writers.write_csv(tasks.drop("paired", "alternative"), f"{a.results_dir}/task_contrasts", ["contrast", "left_condition", "right_condition", "task_id", "family", "delta_h20", "delta_valid_vocab", "delta_semantic_step"], ["contrast", "task_id"])
    writers.write_csv(families.drop("alternative"), f"{a.results_dir}/family_contrasts", [f.name for f in schemas.FAMILY_CONTRAST], ["contrast", "family"])
    writers.write_json(Path(a.results_dir) / "analysis_summary.json", {"model_slug": a.model_slug, "contrasts": {r.contrast: r.asDict() for r in found.orderBy("contrast").collect()}})


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    """Verdicts over the analysed models below a folder."""
    rows = [c | {"model": p.parent.name} for p in sorted(Path(a.results_root).glob("*/analysis_summary.json")) for c in json.loads(p.read_text())["contrasts"].values()]
    names = ("model", "contrast", "alternative", "mean", "result_status", "primary_pass", "difference_significant", "primary_nonzero_pass", "equivalent")
    kinds = "model string, contrast string, alternative string, mean double, result_status string, primary_pass boolean, difference_significant boolean, primary_nonzero_pass boolean, equivalent boolean"
    frame = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], kinds)
    found = decide.across_models(frame, models=a.models).orderBy("contrast").collect()
    writers.write_json(Path(a.results_root).parent / "analysis/cross_model_summary.json", {"contrasts": {r.contrast: r.asDict() for r in found}})


def build_ir(spark: SparkSession, a: argparse.Namespace) -> None:
    """Tasks to indexed programs."""
    if a.expected_sha256 and manifest.sha256_file(Path(a.tasks)) != a.expected_sha256:
        raise gates.GateError("the task corpus has changed")
    tasks = readers.tasks(spark, a.tasks)
    contrast.specs(tasks, expected=a.variants).count()
    frames.build(tasks).write.mode("overwrite").parquet(a.output)
    programs = spark.read.schema(schemas.PROGRAM).parquet(a.output)
    counts = {r.node_type: r.n for r in frames.construct_histogram(programs).orderBy("node_type").collect()}
    head = {"tasks_sha256": manifest.sha256_file(Path(a.tasks)), "program_count": programs.count(), "construct_counts": counts, "content_sha256": frames.content_sha256(programs)}
    # the time is no part of what is hashed
    writers.write_json(f"{a.output.rstrip('/')}.json", head | {"generated_at_utc": datetime.now(UTC).isoformat()})


def render(spark: SparkSession, a: argparse.Namespace) -> None:
    """Programs to renderings in all conditions."""
    frames.render_programs(spark.read.schema(schemas.PROGRAM).parquet(a.ir)).write.mode("overwrite").parquet(a.output)


def validate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Span and execution checks of renderings; fails if any does not hold."""
    rows = spark.read.schema(schemas.RENDERED).parquet(a.rendered)
    each = rows.select("trajectory_id", F.length("reference_text").alias("n"), F.explode("semantic_step_spans").alias("s")).select("trajectory_id", "n", "s.*")
    checks = [("span_errors", "0", spans.span_errors(each, ["trajectory_id"], "n").count())]
    cells = contrast.duplicates(rows, ["trajectory_id"]).count()
    checks.append(("repeated_trajectories", "0", cells))
    if not a.skip_execution:
        checks.append(("failed_programs", "0", frames.differential_runs(rows, allow_execution=True).where("not passed").count()))
    report = gates.check_rows(spark, [(n, e, str(v), str(v) == e) for n, e, v in checks])
    found = [r.asDict() for r in report.collect()]
    writers.write_json(a.output, {"passed": all(c["passed"] for c in found), "stimuli_sha256": manifest.store_sha256(spark, a.rendered), "checks": found})
    gates.enforce(report)


def publish_tables(spark: SparkSession, a: argparse.Namespace) -> None:
    """Condition means of every model below a folder."""
    frames_ = [_trajectories(spark, str(p)).select("condition", "mean_entropy_top20").withColumn("model_slug", F.lit(p.name)) for p in sorted(Path(a.results_root).iterdir()) if p.is_dir()]
    rows = frames_[0]
    for more in frames_[1:]:
        rows = rows.unionByName(more)
    writers.write_csv(publish.condition_table(rows), f"{a.output}/condition_means", ["model_slug", "condition", "mean_entropy_top20"], ["model_slug", "place"], allow_empty=False)


def write_manifest(spark: SparkSession, a: argparse.Namespace) -> None:
    """Path, size and hash of every file of a release."""
    name = Path(a.output).name
    writers.write_json(a.output, manifest.document(manifest.of_folder(spark, a.root, [name]), schema_version=1, generated_at_utc=datetime.now(UTC).isoformat()))


def release_check(spark: SparkSession, a: argparse.Namespace) -> None:
    """A release folder against its manifest; fails if anything differs."""
    files = json.loads(Path(a.manifest).read_text())["files"]
    expected = spark.createDataFrame([(f["path"], f["size_bytes"], f["sha256"]) for f in files], schemas.MANIFEST)
    evidence = (a.evidence, a.artifacts) if a.evidence else None
    failures = manifest.validate(spark, a.root, expected, [Path(a.manifest).name], evidence=evidence).orderBy("path", "failure").collect()
    for r in failures:
        print(f"{r.failure}: {r.path}")
    if failures:
        raise gates.GateError(f"{len(failures)} failures")


def audit(spark: SparkSession, a: argparse.Namespace) -> None:
    """Published numbers, texts and hashes against the files of a release; fails if any differs.

    The list of expectations is one document: numbers {file: {dotted key: value}}, texts {file:
    [strings that it must hold]}, hashes {file: SHA-256}.
    """
    root, wanted = Path(a.root), json.loads(Path(a.expected).read_text(encoding="utf-8"))

    def number(file: str, key: str) -> float | None:
        found: Any = json.loads((root / file).read_text(encoding="utf-8"))
        for part in key.split("."):
            found = found.get(part) if isinstance(found, dict) else found[int(part)] if isinstance(found, list) and part.isdigit() and int(part) < len(found) else None
        return float(found) if isinstance(found, int | float) else None

    names = [(f, k, float(v)) for f, keys in wanted.get("numbers", {}).items() for k, v in keys.items()]
    expected = spark.createDataFrame(names, "file string, key string, value double")
    actual = spark.createDataFrame([(f, k, number(f, k)) for f, k, _ in names], "file string, key string, value double")
    rows = [(f"{r.file} {r.key}", str(r.expected), str(r.actual), r.passed) for r in gates.number_audit(expected, actual, ["file", "key"], tolerance=a.tolerance).collect()]
    for file, strings in wanted.get("texts", {}).items():
        text = (root / file).read_text(encoding="utf-8")
        rows += [(f"{file} holds", s, "yes" if s in text else "no", s in text) for s in strings]
    for file, digest in wanted.get("hashes", {}).items():
        found = manifest.sha256_file(root / file)
        rows.append((f"{file} hash", digest, found, digest == found))
    gates.enforce(gates.check_rows(spark, rows))
    print(f"{len(rows)} expectations hold")


def release(spark: SparkSession, a: argparse.Namespace) -> None:
    """Tables, audit, manifest and release check, one after the other; stops at the first that fails."""
    steps = (
        (publish_tables, {"results_root": a.results_root, "output": f"{a.root}/tables"}), (audit, {"root": a.root, "expected": a.expected, "tolerance": a.tolerance}),
        (write_manifest, {"root": a.root, "output": a.manifest}), (release_check, {"root": a.root, "manifest": a.manifest, "evidence": a.evidence, "artifacts": a.artifacts}),
    )
    for step, options in steps:
        print(step.__name__)
        step(spark, argparse.Namespace(**options))


#: Programs of the smoke run.
SMOKE = ("def double_all(values):\n    out = []\n    for value in values:\n        out.append(value * 2)\n    return out\n", "def sign_of(number):\n    if number < 0:\n        return -1\n    return 1\n")


def smoke(spark: SparkSession, a: argparse.Namespace) -> None:
    """Synthetic programs through every step, from syntax tree to trajectories, with a made-up scorer."""
    if not a.confirm_synthetic_smoke:
        raise gates.GateError("a smoke run must be confirmed")
    tasks = spark.createDataFrame([(f"smoke{k}", "synthetic_debug", "Debug.", ["Follow the stated procedure."], [s]) for k, s in enumerate(SMOKE)], schemas.TASK)
    rendered = frames.render_programs(frames.build(tasks))
    pieces = spans.tokenize(rendered, ["trajectory_id", "task_id", "family", "condition", "variant"], "reference_text")
    # ids of a vocabulary of 64; the first one stands for the prompt
    each = pieces.groupBy("trajectory_id", "task_id", "family", "condition", "variant").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda p: F.pmod(F.crc32(p["piece"].cast("binary")), F.lit(64)).cast("int")).alias("ids"))
    sequences = each.withColumn("token_ids", F.concat(F.array(F.lit(1)), "ids")).drop("ids")

    def scorer(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.cos(ids[:, :, None] * mask[:, :, None] + np.arange(64)) * 3

    scored = readers.scored(sequences, scorer, batch=4, vocab=64).withColumnsRenamed({"position": "reference_position", "token_id": "reference_token_id"}).drop("token_ids")
    tokens = distribution.measure(scored.withColumn("logits", F.col("logits").cast("array<double>"))).withColumnsRenamed({"entropy_top": "entropy_top20_normalized", "entropy": "entropy_valid_vocab"})
    out = summarise.trajectories(summarise.drop_first(tokens), ["trajectory_id", "task_id", "family", "condition", "variant"], ["reference_position"], extra=("top_mass", "reference_surprisal"))
    out.write.mode("overwrite").parquet(f"{a.output}/trajectories.parquet")
    written = spark.read.parquet(f"{a.output}/trajectories.parquet")
    expected = len(SMOKE) * len(schemas.CONDITIONS)
    gates.enforce(gates.expectations(written, {"trajectories": (F.count(F.lit(1)), expected), "all_valid": (F.coalesce(F.bool_and("trajectory_valid"), F.lit(False)), True)}))


#: command, function, options: name, type or action, default (None with a type: required).
COMMANDS: dict[str, tuple[Callable, tuple[tuple, ...]]] = {
    "measure": (measure, (("--scores", str, None), ("--results-dir", str, None), ("--top-k", int, distribution.TOP_K), ("--valid-vocab", int, 0), ("--limit", int, 0), ("--wide", bool, False), ("--confirm-real-run", bool, False), ("--stimuli", str, ""), ("--validation", str, ""))),
    "analyze": (analyze, (("--results-dir", str, None), ("--model-slug", str, ""), ("--registry", str, ""), ("--trajectories", int, 0), ("--cells", int, 0), ("--sign-flips", int, 200_000), ("--bootstraps", int, 100_000))),
    "compare": (compare, (("--results-root", str, None), ("--models", int, 3))),
    "build-ir": (build_ir, (("--tasks", str, None), ("--output", str, None), ("--variants", int, 3), ("--expected-sha256", str, ""))),
    "render": (render, (("--ir", str, None), ("--output", str, None))),
    "validate": (validate, (("--rendered", str, None), ("--output", str, None), ("--skip-execution", bool, False))),
    "publish": (publish_tables, (("--results-root", str, None), ("--output", str, None))),
    "manifest": (write_manifest, (("--root", str, None), ("--output", str, None))),
    "release-check": (release_check, (("--root", str, None), ("--manifest", str, None), ("--evidence", str, ""), ("--artifacts", int, 0))),
    "audit": (audit, (("--root", str, None), ("--expected", str, None), ("--tolerance", float, 1e-12))),
    "release": (release, (("--root", str, None), ("--results-root", str, None), ("--expected", str, None), ("--manifest", str, None), ("--tolerance", float, 1e-12), ("--evidence", str, ""), ("--artifacts", int, 0))),
    "smoke": (smoke, (("--output", str, None), ("--confirm-synthetic-smoke", bool, False))),
}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="parallax", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (work, options) in COMMANDS.items():
        own = commands.add_parser(name, help=(work.__doc__ or "").split("\n")[0])
        for option, kind, default in options:
            if kind is bool:
                own.add_argument(option, action="store_true")
            else:
                own.add_argument(option, type=kind, default=default, required=default is None)
    a = parser.parse_args(arguments)
    if getattr(a, "valid_vocab", None) == 0:
        a.valid_vocab = None
    try:
        COMMANDS[a.command][0](spark or session(), a)
    except gates.GateError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
