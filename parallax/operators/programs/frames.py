"""The program operators on DataFrames; each row is worked on alone, so nothing is shuffled."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from parallax import schemas
from parallax.operators import gates
from parallax.operators.programs import differential, ir, rename, render
from parallax.schemas import CONDITIONS

DIFFERENTIAL = "program_id string, task_id string, passed boolean, case_count int, failed_inputs array<string>, error string"


def each_row(df: DataFrame, schema: StructType | str, work: Callable[[dict], Iterator[dict]]) -> DataFrame:
    """Rows made by `work` from each row of `df`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [out for row in frame.to_dict("records") for out in work(row)]
            if made:
                yield pd.DataFrame(made, dtype=object)

    return df.mapInPandas(run, schema)


def build(tasks: DataFrame) -> DataFrame:
    """Tasks to programs: one row per variant, numbered from 1. A text that is no program fails the job; see rejected()."""
    rows = tasks.select("id", "family", "task", "nl", F.posexplode("python").alias("_i", "source"))
    rows = rows.select("id", "family", "task", F.get("nl", F.col("_i")).alias("natural"), "source", (F.col("_i") + 1).alias("variant"))
    return each_row(rows, schemas.PROGRAM, lambda r: iter([ir.program(r["id"], r["family"], r["task"], int(r["variant"]), r["source"], r["natural"])]))


def rejected(sources: DataFrame, key: str, source: str) -> DataFrame:
    """(key, problem) of each text that is no program."""

    def work(row: dict) -> Iterator[dict]:
        try:
            ir.function_of(row[source])
        except ir.ProgramError as error:
            yield {key: row[key], "problem": str(error)}

    return each_row(sources.select(key, source), f"`{key}` {sources.schema[key].dataType.simpleString()}, problem string", work)


def steps(programs: DataFrame) -> DataFrame:
    """One row per semantic step."""
    return programs.select("program_id", F.explode("semantic_steps").alias("_s")).select("program_id", "_s.*")


def construct_histogram(programs: DataFrame) -> DataFrame:
    """How often each kind of syntax node occurs."""
    return programs.select(F.explode("trace_nodes").alias("_n")).groupBy("_n.node_type").agg(F.count(F.lit(1)).alias("n"))


def _renderings(row: dict) -> Iterator[dict]:
    function, plan, nodes = ir.load(json.loads(row["ast"])), [dict(s) for s in map(_plain, row["semantic_steps"])], [dict(n) for n in map(_plain, row["trace_nodes"])]
    opaque = rename.rename(row["source_python"])
    texts = {CONDITIONS[0]: (row["source_nl"], [])}
    texts |= {name: render.render(function, plan, style) for name, style in render.STYLES.items()}
    texts |= {"python_canonical": (row["source_python"], render.source_spans(row["source_python"], plan)), "python_opaque": (opaque["source"], render.source_spans(opaque["source"], plan))}
    for condition in CONDITIONS:
        text, spans = texts[condition]
        yield {
            **{k: row[k] for k in ("program_id", "task_id", "family", "task_text", "source_python")}, "trajectory_id": f"{row['program_id']}__{condition}", "variant": int(row["variant"]), "condition": condition, "reference_text": text,
            "semantic_step_spans": spans, "trace_spans": render.trace_spans(nodes, spans) if spans else [], "opacity": {k: v for k, v in opaque.items() if k != "source"} if condition == "python_opaque" else None,
        }


def _plain(x) -> dict:
    return x if isinstance(x, dict) else x.asDict()


def render_programs(programs: DataFrame) -> DataFrame:
    """Each program in all conditions."""

    def work(row: dict) -> Iterator[dict]:
        names = [f.name for f in schemas.RENDERED]
        for made in _renderings(row):
            yield {n: made[n] for n in names}

    return each_row(programs, schemas.RENDERED, work)


def rename_programs(sources: DataFrame, key: str, source: str) -> DataFrame:
    """(key, source, and the columns of the opacity record) of each program."""
    schema = StructType([StructField(key, sources.schema[key].dataType), StructField("source", StringType()), *schemas.OPACITY.fields])
    return each_row(sources.select(key, source), schema, lambda r: iter([{key: r[key]} | rename.rename(r[source])]))


def content_sha256(programs: DataFrame) -> str:
    """Hash of a set of programs: the same for the same rows in any order, on any cluster."""
    row = F.sha2(F.to_json(F.struct(*sorted(programs.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(8)]
    return gates.json_sha256(list(programs.agg(F.count(F.lit(1)), *parts).first()))


def differential_runs(rendered: DataFrame, allow_execution: bool = False, seconds: float = 10.0, budget: float | None = None) -> DataFrame:
    """Canonical against opaque programs of a rendered table, matched by program.

    seconds: limit of one program; budget: limit of the whole job from now on, after which programs
    that have not ended count as failed by timeout.
    """
    end = time.time() + budget if budget is not None else None
    if not allow_execution:
        raise PermissionError("differential runs execute program text; pass allow_execution=True for a trusted corpus")
    side = lambda c: F.max(F.when(F.col("condition") == c, F.col("reference_text")))
    names = F.max(F.when(F.col("condition") == "python_opaque", F.struct("opacity.canonical_function_name", "opacity.opaque_function_name")))
    pairs = rendered.where(F.col("condition").isin("python_canonical", "python_opaque")).groupBy("program_id", "task_id").agg(side("python_canonical").alias("canonical_source"), side("python_opaque").alias("opaque_source"), names.alias("_n"))
    pairs = pairs.select("program_id", "task_id", "canonical_source", "opaque_source", "_n.canonical_function_name", "_n.opaque_function_name")
    return each_row(pairs, DIFFERENTIAL, lambda r: iter([differential.compare(r, seconds, end)]))


def constructs(programs: DataFrame) -> DataFrame:
    """(task_id, constructs) over all variants of a task."""
    each = each_row(programs.select("task_id", "source_python"), StructType([StructField("task_id", StringType()), StructField("constructs", ArrayType(StringType()))]), lambda r: iter([{"task_id": r["task_id"], "constructs": sorted(ir.constructs(ir.function_of(r["source_python"])))}]))
    return each.groupBy("task_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("constructs")))).alias("constructs"))
