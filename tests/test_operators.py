"""Edge cases of distribution, summary, span, contrast, gate and resume operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parallax import schemas
from parallax.functions import distribution, text
from parallax.operators import contrast, gates, resume, spans, summarise


def test_distribution_edges(spark):
    rows = [(1, [1.0, 1.0, 1.0], 2), (2, [5.0], 0), (3, None, 0), (4, [], 0), (5, [0.0, -2000.0], 1), (6, [3.0, 1.0], 9), (7, [2.0, 7.0, 7.0], None)]
    frame = spark.createDataFrame(rows, "id int, logits array<double>, ref int")
    a = {r.id: r for r in distribution.measure(frame, reference="ref", k=2).collect()}
    b = {r.id: r for r in distribution.measure_wide(frame, reference="ref", k=2).collect()}
    assert a[1].entropy == pytest.approx(math.log(3)) and a[1].reference_rank == 1 and a[1].top1_token_id == 0
    assert (a[2].p1, a[2].p2, a[2].tail_mass) == (1.0, 0.0, 0.0)
    assert a[3].entropy is None and a[3].p2 is None
    assert a[5].entropy_top == pytest.approx(0.0) and a[5].reference_surprisal == pytest.approx(2000.0) and a[5].reference_rank == 2
    assert a[6].reference_rank is None and a[6].p1 > 0.5 and a[7].reference_logprob is None
    for k in (1, 2, 5, 6, 7):
        for name in ("entropy", "entropy_top", "top_mass", "p1", "p2", "reference_rank", "reference_surprisal", "top1_token_id", "reference_in_top"):
            assert b[k][name] == pytest.approx(a[k][name]) if a[k][name] is not None else b[k][name] is None, (k, name)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-30, 30), min_size=1, max_size=40), st.integers(0, 39), st.integers(1, 25))
def test_wide_measure_by_definition(scores, ref, k):
    z = np.array(scores)
    m = distribution._measure_one(z, ref, k)
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    top = np.sort(p)[::-1][:k]
    assert m[0] == pytest.approx(-(p[p > 0] * np.log(p[p > 0])).sum(), abs=1e-9)
    assert m[2] == pytest.approx(top.sum()) and m[4] == pytest.approx(top[0])
    assert m[10] == (1 + int((z > z[ref]).sum()) if ref < len(z) else None)


def test_trajectory_edges(spark):
    rows = [("one", 1, 0.5, 0.95), ("run", 1, 1.0, 0.90), ("run", 2, 2.0, 0.99), ("run", 3, 4.0, 0.1), ("run", 4, 4.0, 1.0)]
    frame = spark.createDataFrame(rows, "t string, pos int, entropy_top20_normalized double, p1 double").withColumn("entropy_valid_vocab", F.col("entropy_top20_normalized"))
    out = {r.t: r for r in summarise.trajectories(frame, ["t"], ["pos"]).collect()}
    assert (out["one"].mean_abs_entropy_change_top20, out["one"].std_entropy_top20, out["one"].longest_run_p1_ge_090) == (0.0, 0.0, 1)
    assert (out["run"].longest_run_p1_ge_090, out["run"].longest_run_p1_ge_099, out["run"].fraction_p1_ge_090) == (2, 1, 0.75)
    assert out["run"].mean_abs_entropy_change_top20 == pytest.approx(1.0) and out["run"].median_entropy_top20 == 3.0
    steps = spark.createDataFrame([("a", "mapped", "S1", 1.0), ("a", "mapped", "S1", 3.0), ("a", "mapped", "S2", 10.0), ("a", "unmapped", None, 99.0), ("b", "unmapped", None, 5.0)], "t string, semantic_mapping_status string, semantic_step_id string, v double")
    assert {r.t: r.step_balanced_mean for r in summarise.step_balanced(steps, ["t"], "v").collect()} == {"a": 6.0, "b": None}
    fractions = {r.t: r.step_mapped_token_fraction for r in summarise.mapping_fractions(steps, ["t"]).collect()}
    assert fractions == {"a": 0.75, "b": 0.0}


def test_span_vectors(spark):
    two = [("S001", 0, 10), ("S002", 10, 20)]
    rows = [(1, "x", 2, 8, two), (2, "x", 8, 12, two), (3, "x", 6, 8, [("S001", 0, 5)]), (4, "  ", 2, 4, two), (5, "..", 2, 4, two), (6, "a.", 2, 4, two), (7, "x", 2, 4, [("A", 0, 5), ("B", 1, 6)]), (8, "x", 2, 4, []), (9, " ", 2, 4, two), (10, "«", 2, 3, two)]
    frame = spark.createDataFrame(rows, "id int, piece string, start_char int, end_char int, spans array<struct<semantic_step_id:string,start_char:int,end_char:int>>")
    out = {r.id: (r.semantic_mapping_status, r.semantic_step_id) for r in spans.map_steps(frame).collect()}
    assert out == {1: ("mapped", "S001"), 2: ("boundary_overlap", None), 3: ("unmapped", None), 4: ("whitespace_only", None), 5: ("punctuation_only", None), 6: ("mapped", "S001"), 7: ("boundary_overlap", None), 8: ("unmapped", None), 9: ("whitespace_only", None), 10: ("punctuation_only", None)}
    anchor = spans.map_steps(frame.limit(1), condition=F.lit(schemas.ANCHOR)).first()
    assert anchor.semantic_mapping_status == "not_applicable"
    assert spans.map_steps(frame.limit(1).withColumn("pos", F.lit(1)), position="pos").first().semantic_mapping_status == "excluded_first_token"


def test_span_errors(spark):
    rows = [("ok", "S1", 0, 4), ("ok", "S2", 4, 9), ("bad", "S1", 0, 5), ("bad", "S1", 4, 4), ("bad", "S2", 8, 11), ("bad", None, None, 3)]
    frame = spark.createDataFrame(rows, "t string, semantic_step_id string, start_char int, end_char int").withColumn("n", F.lit(10))
    found = sorted((r.t, str(r.semantic_step_id), r.error) for r in spans.span_errors(frame, ["t"], "n").collect())
    assert found == [("bad", "None", "invalid_range"), ("bad", "S1", "duplicate_step"), ("bad", "S1", "invalid_range"), ("bad", "S1", "overlap"), ("bad", "S2", "invalid_range")]


def test_alignment(spark):
    rows = [("fine", [(0, 3), (3, 6), (6, 9)], 6), ("crossed", [(0, 3), (3, 8), (8, 9)], 6), ("none", [(0, 3), (3, 6)], 6), ("first", [(0, 9), (9, 10)], 6), ("short", [(0, 3)], 1)]
    frame = spark.createDataFrame(rows, "t string, offsets array<struct<start:int,end:int>>, n int")
    out = {r.t: (r.reference_start, r.boundary_crossed, r.align_error) for r in spans.align(frame, "offsets", "n").collect()}
    assert out == {"fine": (2, False, None), "crossed": (1, True, None), "none": (None, False, "no_reference_token"), "first": (0, True, "no_prompt_token"), "short": (0, True, "too_short")}
    ids = spark.createDataFrame([([1, 2, 3], [1, 2]), ([1, 9, 3], [1, 2])], "f array<int>, b array<int>")
    assert [r[0] for r in ids.select(spans.prefix_aligned(F.col("f"), F.col("b"))).collect()] == [True, False]


def test_plugin_tokenizer(spark):
    frame = spark.createDataFrame([(1, "ab cd"), (2, None)], "id int, text string")
    out = spans.tokenize_with(frame, "text", lambda texts: [[(k, 0, len(t))] if t else [] for k, t in enumerate(texts)]).collect()
    assert [(r.id, [tuple(o) for o in r.offsets]) for r in out] == [(1, [(0, 5)]), (2, [])]


def test_contrast_edges(spark):
    rows = [("t1", "f", "A", 3.0), ("t1", "f", "B", 1.0), ("t2", "f", "A", 5.0), ("t3", None, "A", 1.0), ("t4", "f", "A", float("nan")), ("t4", "f", "A", 2.0), ("t4", "f", "B", 2.0)]
    means = contrast.condition_means(spark.createDataFrame(rows, "task_id string, family string, c string, m double"), ["task_id", "family", "c"], ["m"])
    defs = contrast.definitions(spark, (("X", "A", "B", "positive"),))
    out = {r.task_id: (r.delta_m, r.paired) for r in contrast.contrasts(means, defs, ["task_id", "family"], "c", ["m"]).collect()}
    assert out == {"t1": (2.0, True), "t2": (None, False), "t4": (0.0, True)}
    twice = spark.createDataFrame([("t", "A", 1.0), ("t", "A", 2.0)], "task_id string, c string, m double")
    assert contrast.duplicates(twice, ["task_id", "c"]).count() == 1
    with pytest.raises(PySparkException):
        contrast.wide(twice, ["task_id"], "c", ["A", "B"], ["m"]).collect()
    grid = contrast.completeness(twice, "task_id", "c", ["A", "B"], 1)
    assert {(r.c, r.n, r.complete) for r in grid.collect()} == {("A", 2, False), ("B", 0, False)}


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_contrasts_send_the_definitions_to_the_means(spark, threshold):
    """Means are never dealt out by condition, nor sent to all tasks."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows = spark.range(300).selectExpr("id DIV 3 AS task_id", "array('A', 'N', 'R')[id % 3] AS c", "CAST(id AS double) AS m")
        means = contrast.condition_means(rows, ["task_id", "c"], ["m"])
        out = contrast.contrasts(means, contrast.definitions(spark, (("X", "A", "N", "positive"), ("Y", "R", "A", "two_sided"))), ["task_id"], "c", ["m"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BuildLeft" not in plan
        assert sorted(map(tuple, out.groupBy("contrast", "paired", "delta_m").count().collect())) == [("X", True, -1.0, 100), ("Y", True, 2.0, 100)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_contrasts_of_odd_cells(spark):
    """Cells that are there twice, without a number, or on both sides of a definition; a condition or unit without a name."""
    rows = [("t1", "A", 1.0, 5.0), ("t1", "A", 2.0, None), ("t1", "B", 1.0, 1.0), ("t2", "A", None, 1.0), ("t2", "B", 4.0, float("nan")), ("t3", "C", 1.0, 1.0), ("t4", None, 1.0, 1.0), (None, "A", 3.0, 2.0), (None, "B", 1.0, 4.0)]
    means = spark.createDataFrame(rows, "task_id string, c string, m double, n double")
    defs = contrast.definitions(spark, (("X", "A", "B", "positive"), ("Y", "B", "A", "positive"), ("Z", "A", "A", "positive")))
    out = contrast.contrasts(means, defs, ["task_id"], "c", ["m", "n"])
    assert out.columns == ["contrast", "left_condition", "right_condition", "alternative", "task_id", "delta_m", "delta_n", "paired"]
    found = {(r.contrast, r.task_id): (r.delta_m, None if r.delta_n is None else str(r.delta_n), r.paired) for r in out.collect()}
    assert found == {
        ("X", "t1"): (1.0, "4.0", False), ("Y", "t1"): (-1.0, "-4.0", False), ("Z", "t1"): (None, None, False),
        ("X", "t2"): (None, "nan", True), ("Y", "t2"): (None, "nan", True), ("Z", "t2"): (None, None, False),
        ("X", None): (2.0, "-2.0", True), ("Y", None): (-2.0, "2.0", True), ("Z", None): (None, None, False),
    }


def test_specs(spark):
    tasks = spark.createDataFrame([("t", "f", "do", ["a", "b", "c"], ["x", "y", "z"])], schemas.TASK)
    out = contrast.specs(tasks, expected=3).collect()
    assert [r.trajectory_id for r in out] == ["t__nl__v1", "t__nl__v2", "t__nl__v3", "t__python__v1", "t__python__v2", "t__python__v3"]
    with pytest.raises(PySparkException):
        contrast.specs(tasks, expected=2).collect()
    report = {r.check: r.passed for r in gates.corpus_gates(tasks, 1, 1, 1).collect()}
    assert all(report.values()) and not all(r.passed for r in gates.corpus_gates(tasks, 2, 1).collect())


def test_reconcile(spark):
    schema = schemas.MANIFEST
    expected = spark.createDataFrame([("ok", 1, "a"), ("gone", 1, "a"), ("size", 1, "a"), ("hash", 1, "a"), ("_hidden", 1, None)], schema)
    actual = spark.createDataFrame([("ok", 1, "a"), ("extra", 1, "a"), ("size", 2, "a"), ("hash", 1, "b"), ("_hidden", 1, None)], schema)
    assert {r.path: r.status for r in gates.reconcile(expected, actual).collect()} == {"ok": "ok", "gone": "missing", "size": "size_mismatch", "hash": "hash_mismatch", "extra": "unlisted", "_hidden": "ok"}


def test_resume(spark, tmp_path):
    schema = "trajectory_id string, v int"
    tokens = spark.createDataFrame([("complete", 1), ("complete", 2), ("partial", 3)], schema)
    done = resume.completed(spark.createDataFrame([("complete", 1), ("complete", 1), (None, 1)], schema))
    assert [r.trajectory_id for r in resume.repaired(tokens, done, ["trajectory_id"]).collect()] == ["complete"] * 2
    assert [r.trajectory_id for r in resume.remaining(tokens, done, ["trajectory_id"]).collect()] == ["partial"]
    assert resume.read_or_empty(spark, str(tmp_path / "none"), tokens.schema).count() == 0
    order = spark.createDataFrame([("complete", 1), ("partial", 0)], "trajectory_id string, ord int")
    one = tokens.dropDuplicates(["trajectory_id"])
    assert [r.trajectory_id for r in resume.in_frozen_order(one, order, "trajectory_id").collect()] == ["partial", "complete"]
    with pytest.raises(PySparkException):
        resume.in_frozen_order(one, order.limit(1), "trajectory_id").collect()


def test_audits_and_gates():
    assert gates.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}' and len(gates.json_sha256([])) == 64
    assert gates.immutable({"a": 1, "b": 2}, {"a": 1, "b": 3}, ["a", "b"]) == ["b"]
    gates.require_confirmed(True, "x", "x")
    for args in ((False, "x", "x"), (True, "x", "y")):
        with pytest.raises(gates.GateError):
            gates.require_confirmed(*args)


def test_texts(spark):
    frame = spark.createDataFrame([(0.0,), (59.5,), (60.0,), (3661.2,), (-5.0,), (90000.0,)], "s double")
    assert [r[0] for r in frame.select(text.duration(F.col("s"))).collect()] == ["0s", "1m 00s", "1m 00s", "1h 01m 01s", "0s", "25h 00m 00s"]
    words = spark.createDataFrame([("a/b é.x-_",)], "t string")
    assert words.select(text.slug(F.col("t"))).first()[0] == "a_b_é.x-_"
    assert words.select(text.missing_strings(F.col("t"), ["a/b", "zz"])).first()[0] == ["zz"]


def test_frozen_permutation(spark):
    import random

    rows = spark.createDataFrame([(f"t{k}",) for k in range(50)], "trajectory_id string").repartition(5)
    want = sorted(f"t{k}" for k in range(50))
    random.Random(20260916).shuffle(want)
    order = resume.frozen_permutation(rows, "trajectory_id", 20260916)
    assert [r.trajectory_id for r in order.orderBy("ord").collect()] == want
    assert [r.trajectory_id for r in resume.in_frozen_order(rows, order, "trajectory_id").collect()] == want


def test_offsets_of_rows_that_repeat_a_key(spark):
    rows = [("k", "ab c"), ("k", "xyz w"), ("l", None), ("m", ""), ("n", " ".join("word" for _ in range(500)))]
    found = spans.tokenize(spark.createDataFrame(rows, "k string, t string"), ["k"], "t").collect()
    assert sorted((r.piece, r.pos, r.start_char, r.end_char) for r in found if r.k == "k") == [(" ", 2, 2, 3), (" ", 2, 3, 4), ("ab", 1, 0, 2), ("c", 3, 3, 4), ("w", 3, 4, 5), ("xyz", 1, 0, 3)]
    assert [(r.pos, r.start_char) for r in sorted((r for r in found if r.k == "n"), key=lambda r: r.pos)] == [(i + 1, i // 2 * 5 + (4 if i % 2 else 0)) for i in range(999)]
    assert not [r for r in found if r.k in "lm"]


def test_tokenize_does_not_shuffle(spark):
    plan = spans.tokenize(spark.createDataFrame([("k", "a b")], "k string, t string"), ["k"], "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_completeness_knows_units_without_rows(spark):
    rows, units = spark.createDataFrame([("a", "x")], "u string, c string"), spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "u string")
    found = sorted(tuple(r) for r in contrast.completeness(rows, "u", "c", ["x", "y"], 1, units).collect())
    assert found == [("a", "x", 1, True), ("a", "y", 0, False), ("b", "x", 0, False), ("b", "y", 0, False)]
