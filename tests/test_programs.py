"""Program operators: structure, renderings, renaming, differential runs."""

import ast
import random

import pytest

from pyspark.sql import functions as F

from parallax import schemas
from parallax.operators.programs import differential, frames, ir, rename, render
from parallax.plans import stimuli
from parallax.plans.queries import CORPUS, _programs
from parallax.sources import manifest, writers

EVERYTHING = """def work(items, limit):
    total: int = 0
    table = {'a': 1, 'b': [1, 2]}
    pair = (limit,)
    i = j = 0
    while i < len(items) and not total > limit or False:
        total //= 2
        total *= 3
        total /= 1
        total -= -1
        i += 1
        if items[i % 2] in table:
            continue
        elif total is not None:
            break
        else:
            pass
    else:
        items.append(~limit)
    for x in items[1:limit:2]:
        print(x.real, sep='')
        total = total ** 2 if x != 1 else +total
    else:
        return
    return (total | 1) & 3
"""


def test_rendering_of_every_form():
    function = ir.function_of(EVERYTHING)
    _, steps = ir.index(function)
    prose, spans = render.render(function, steps, render.STYLES["procedural_prose"])
    lines = prose.split("\n")
    for line in (
        "Define a procedure named work that receives items and limit.", "Set total to 0.", "Set table to {'a': 1, 'b': [1, 2]}.", "Set pair to (limit,).", "Set i = j to 0.",
        "While ((i is less than len(items) and not total is greater than limit) or false), do the following.", "    Update total to total // 2.", "    Multiply total by 3.", "    Divide total by 1.", "    Decrease total by -1.", "    Increase i by 1.",
        "    If items[(i % 2)] is in table, do the following.", "        Continue with the next iteration.", "    Otherwise, do the following.", "        If total is not nothing, do the following.", "            Stop the current loop.",
        "            Do nothing.", "After the loop, do the following.", "    Append ~limit to items.", "For each x in items[1:limit:2], do the following.", "    Perform print(x.real, sep='').",
        "    Set total to (total ** 2) if x does not equal 1, otherwise +total.", "Otherwise.", "    Return .", "Return ((total | 1) & 3).",
    ):
        assert line in lines, line
    controlled = render.render(function, steps, render.STYLES["controlled_nl"])[0].split("\n")
    for line in ("PROCEDURE work INPUT items, limit:", "SET total TO 0.", "WHILE ((i < len(items) AND NOT total > limit) OR FALSE):", "    UPDATE total USING // 2.", "    EXECUTE items.append(~limit).", "FOR EACH x IN items[1:limit:2]:", "ELSE", "        CONTINUE", "            NO OPERATION", "    SET total TO IF x != 1 THEN (total ** 2) ELSE +total."):
        assert line in controlled, line
    pseudo = render.render(function, steps, render.STYLES["pseudocode"])[0].split("\n")
    for line in ("PROCEDURE work(items, limit)", "total <- 0", "    total <- total // 2", "    items.append(~limit)", "FOR x IN items[1:limit:2]", "    IF items[(i % 2)] IN table", "        IF total IS NOT NONE", "RETURN ((total | 1) & 3)"):
        assert line in pseudo, line
    check_spans(prose, spans, steps)


def check_spans(text, spans, steps):
    assert [s["semantic_step_id"] for s in spans] == [s["semantic_step_id"] for s in steps]
    end = 0
    for s in sorted(spans, key=lambda s: s["start_char"]):
        assert end <= s["start_char"] < s["end_char"] <= len(text)
        end = s["end_char"]


def test_index():
    function = ir.function_of(EVERYTHING)
    nodes, steps = ir.index(function)
    assert [n["trace_node_id"] for n in nodes] == [f"N{k:04d}" for k in range(1, len(nodes) + 1)]
    assert len(nodes) == sum(1 for _ in ast.walk(function)) and steps[0]["kind"] == "FUNCTION_INTERFACE"
    assert len(steps) == sum(isinstance(n, ast.stmt) for n in ast.walk(function))
    owners = {s["path_key"] for s in steps}
    for n in nodes:
        assert ir.kind(ir.at(function, n["path_key"])) == n["node_type"]
        own = next(s for s in steps if s["semantic_step_id"] == n["owner_semantic_step_id"])
        assert n["path_key"].startswith(own["path_key"])
        assert not any(len(own["path_key"]) < len(o) and (n["path_key"] == o or n["path_key"].startswith(o + "/")) for o in owners)
    assert ast.dump(ir.load(ir.dump(function))) == ast.dump(function)


@pytest.mark.parametrize("source", ["x = 1", "def f(a=1): return a", "def f(*a): return a", "@d\ndef f(): pass", "def f():\n    import os", "def f(): return [x for x in y]", "def f(): return lambda: 1", "def f():\n    with a: pass", "def f():\n    def g(): pass", "def f(:", "def f():\n    assert a", "def f(): pass\nx = 1", "def f():\n    yield 1"])
def test_rejected_programs(spark, source):
    with pytest.raises(ir.ProgramError):
        ir.function_of(source)


def test_rename():
    text = "def  fün(größe, y):\n    # größe stays in comments\n    zav0 = größe.größe(y=y) + len(größe)\n    s = 'größe'\n    return zav0, s\n"
    out = rename.rename(text)
    assert "# größe stays" in out["source"] and "'größe'" in out["source"] and ".größe(y=" in out["source"]
    assert out["canonical_globals"] == ["len"] == out["opaque_globals"] and "zav0" not in {m["opaque"] for m in out["mapping"]}
    assert [m["original"] for m in out["mapping"]][:3] == ["fün", "größe", "y"]
    mapping = {m["original"]: m["opaque"] for m in out["mapping"]}
    assert rename.same_up_to_names(text, out["source"], mapping)
    assert not rename.same_up_to_names(text, out["source"].replace("len", "max"), mapping)
    many = "def f(a):\n" + "".join(f"    v{k} = {k}\n" for k in range(40)) + "    return a\n"
    assert len({m["opaque"] for m in rename.rename(many)["mapping"]}) == 42
    with pytest.raises(ir.ProgramError):
        rename.replaced("abc", [(0, 2, "x"), (1, 3, "y")])


def test_spans_of_source():
    for _, _, source in CORPUS:
        steps = ir.index(ir.function_of(source))[1]
        spans = render.source_spans(source, steps)
        check_spans(source, spans, steps)
        assert spans[0]["start_char"] == 0 and all(source[s["start_char"]] == "\n" for s in spans[1:])


@pytest.fixture(scope="module")
def programs(spark):
    from parallax.plans import queries

    return queries._programs(spark)


def test_frames(spark, programs):
    rendered = frames.render_programs(programs)
    rows = rendered.collect()
    assert len(rows) == 6 * len(CORPUS) and [f.name for f in rendered.schema] == [f.name for f in schemas.RENDERED]
    by = {r.trajectory_id: r for r in rows}
    for name, _, source in CORPUS:
        assert by[f"{name}__v1__python_canonical"].reference_text == source
        assert by[f"{name}__v1__{schemas.ANCHOR}"].semantic_step_spans == [] and by[f"{name}__v1__{schemas.ANCHOR}"].opacity is None
        assert by[f"{name}__v1__python_opaque"].opacity.canonical_function_name == name
        counts = {len(by[f"{name}__v1__{c}"].semantic_step_spans) for c in schemas.CONDITIONS[1:]}
        assert len(counts) == 1
    runs = frames.differential_runs(rendered, allow_execution=True).collect()
    assert len(runs) == len(CORPUS) and all(r.passed and r.case_count >= 3 for r in runs)
    with pytest.raises(PermissionError):
        frames.differential_runs(rendered)
    assert frames.steps(programs).groupBy("program_id").count().count() == len(CORPUS)
    bad = spark.createDataFrame([(1, "def f(): pass"), (2, "x = 1")], "id int, source string")
    assert [(r.id, r.problem) for r in frames.rejected(bad, "id", "source").collect()] == [(2, "expected one top-level function")]


def test_differences_are_found():
    row = {"program_id": "p", "task_id": "factorial_iterative", "canonical_source": "def f(n): return n", "canonical_function_name": "f", "opaque_source": "def g(n): return n if n < 12 else 0", "opaque_function_name": "g"}
    out = differential.compare(row)
    assert (out["passed"], out["case_count"], out["failed_inputs"]) == (False, 4, ["[12]"])
    slow = differential.compare(row | {"opaque_source": "def g(n):\n    while True: pass"}, seconds=0.3)
    assert slow["error"] == "timeout" and not slow["passed"]
    assert differential.outcome("def f(x): return open(x)", "f", ["a"])[:2] == ("exception", "NameError")
    assert differential.inputs_of("unknown_task")[0] == [[]] and differential.inputs_of("gcd_two")[1] == [12, 18]
    names = [t for names in differential.TASKS.values() for t in names]
    assert len(names) == len(set(names)) and set(differential.TASKS) <= set(differential.INPUTS)


def test_audit_sample(spark, programs):
    by_task = {r.task_id: set(r.constructs) for r in frames.constructs(programs).collect()}
    required = {*ir.CONSTRUCTS, "nested_control_flow", "function_interface"}
    chosen = ir.audit_sample(by_task, required, 2, 20260916)
    assert chosen[:2] == sorted(random.Random(20260916).sample(sorted(by_task), 2))
    assert required <= set().union(*(by_task[t] for t in chosen))
    with pytest.raises(ir.ProgramError):
        ir.audit_sample(by_task, {"goto"}, 1, 1)


def test_validation_report(spark, programs):
    from parallax.plans import stimuli

    tasks = spark.createDataFrame([(name, family, f"Write {name}.", [f"{name} in words"], [source]) for name, family, source in CORPUS], schemas.TASK)
    rendered = frames.render_programs(programs).cache()
    found = {r.check: (r.actual, r.passed) for r in stimuli.report(tasks, programs, rendered, 1, True).collect()}
    assert all(passed for _, passed in found.values()) and len(found) == 9, found
    from pyspark.sql import functions as F

    broken = rendered.withColumn("reference_text", F.when(F.col("trajectory_id").startswith("scan_max"), F.regexp_replace("reference_text", "scan_max|best|zav0", "other")).otherwise(F.col("reference_text")))
    failed = {r.check for r in stimuli.report(tasks, programs, broken, 1, coverage=False).where("not passed").collect()}
    assert {"changed_anchors", "lines_without_interface"} <= failed
    assert stimuli.audit_rows(rendered, ["scan_max"]).count() == 6
    rendered.unpersist()


def test_a_job_has_a_time_limit_of_its_own(spark):
    rendered = frames.render_programs(_programs(spark))
    late = frames.differential_runs(rendered, allow_execution=True, budget=0.0).collect()
    assert late and all((r.passed, r.error) == (False, "timeout") for r in late)


def test_content_hash_does_not_depend_on_order(spark):
    programs = _programs(spark)
    assert frames.content_sha256(programs) == frames.content_sha256(programs.orderBy(F.desc("program_id")).repartition(3)) != frames.content_sha256(programs.limit(2))


def test_corpus_report(spark, tmp_path):
    path = tmp_path / "tasks.json"
    tasks = [{"id": f"t{k}", "family": f"f{k // 2}", "task": "x", "nl": ["a", "b", "c"], "python": [f"def f(x):\n    return {v}\n" for v in (1, 2, k)]} for k in range(4)]
    writers.write_json(path, tasks)
    checks = {r.check: r.passed for r in stimuli.corpus_report(spark, str(path), manifest.sha256_file(path), 4, 2).collect()}
    assert not checks.pop("tasks_without_distinct_python") and all(checks.values())
    tasks[0]["python"][0] = "def f(x) return"
    writers.write_json(path, tasks)
    checks = {r.check: r.passed for r in stimuli.corpus_report(spark, str(path), "0", 4, 2).collect()}
    assert not checks["corpus_sha256"] and not checks["programs_not_parseable"]


@pytest.mark.parametrize("name", ["trace_spans", "audit_sample", "differential_programs"])
def test_corpus_queries_are_bounded(spark, name):
    """They read no table, and their corpus is one task, whatever the number of cores."""
    from parallax.plans import program_queries, queries

    assert _programs(spark).rdd.getNumPartitions() == 1
    assert queries.QUERIES[name](spark, "/no/such/folder").count() == len(program_queries.RECORDED.get(name, {"rows": CORPUS})["rows"])
