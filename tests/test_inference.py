"""Replay of recorded results, and closed forms against brute force."""

import json
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallax.operators import decide, infer

GOLD = json.loads((Path(__file__).parent / "fixtures/golden.json").read_text())
NEAR = {"rel": 0, "abs": 1e-12}


@pytest.fixture(scope="module")
def paired(spark):
    rows = [("m", f"t{k:03d}", f"f{f:02d}", x) for k, (x, f) in enumerate(zip(GOLD["paired"]["values"], GOLD["paired"]["family"], strict=True))]
    return spark.createDataFrame(rows, "model string, task_id string, family string, delta double")


def test_paired_study(paired):
    d = infer.describe(paired, ["model"], "delta").first()
    assert (d.n, d.positive, d.negative, d.zero) == (100, 100, 0, 0)
    assert d["mean"] == pytest.approx(0.3604636771174562, **NEAR)
    assert d.median == pytest.approx(0.3549234545595626, **NEAR)
    assert d.cohens_dz == pytest.approx(2.503356800529396, **NEAR)
    r = infer.resample(paired, ["model"], ["task_id", "family"], "delta").first()
    assert (r.extreme_resamples, r.signflip_p) == (0, 4.9999750001249995e-06)
    assert (r.ci_low, r.ci_high) == (pytest.approx(0.32312414677456275, **NEAR), pytest.approx(0.3977158346571436, **NEAR))
    assert r.wilcoxon_p == pytest.approx(1.9482799225479546e-18, rel=1e-12)
    assert r.t_test_p == pytest.approx(6.460107991011706e-45, rel=1e-10)


def test_paired_study_publication_row(paired):
    from parallax.plans import publish

    rows = paired.withColumns({"l": F.col("delta") + 1.0, "r": F.lit(1.0)})
    out = publish.replication_analysis(rows.withColumnRenamed("model", "model_slug"), ["model_slug"], "l", "r", "delta", 2000, 2000)
    row = out.first()
    assert row.all_four_pass and (row.positive_families, row.total_families) == (50, 50)
    assert row.min_family_delta == pytest.approx(0.1491379914005997, **NEAR) and row.max_family_delta == pytest.approx(0.64473210953011, **NEAR)
    assert row.relative_reduction == pytest.approx(1 - 1 / row.mean_left)
    assert publish.replication_table(out).columns[:2] == ["model_slug", "mean_delta_nl_minus_python"]


@pytest.mark.parametrize(("name", "extreme", "low", "high", "p"), [("second", 17, 0.014595689224008236, 0.06881887328102718, 4.5107450535653015e-05), ("third", 132803, -0.04119985739444215, 0.028704399856202812, 0.5561375863296085)])
def test_family_vectors(spark, name, extreme, low, high, p):
    x = np.array(GOLD[name]["values"])
    assert infer.flip_test(x, False) == (extreme, (extreme + 1) / 200001)
    assert infer.percentile_ci(x) == (pytest.approx(low, **NEAR), pytest.approx(high, **NEAR))
    frame = spark.createDataFrame([(int((x > 0).sum()), len(x))], "pos int, n int")
    assert frame.select(infer.exact_sign_p(F.col("pos"), F.col("n"), F.lit(False))).first()[0] == pytest.approx(p, rel=1e-11)


def decision_rows(spark):
    names = "model contrast alternative n mean p want_holm ci_low ci_high positive negative family_positive family_negative valid_vocab_mean_delta semantic_step_mean_delta margin want_status want_interpretation want_sign_p".split()
    kinds = ["string"] * 3 + ["int", "double", "double", "double", "double", "double"] + ["int"] * 4 + ["double"] * 3 + ["string"] * 2 + ["double"]
    return spark.createDataFrame([tuple(r) for r in GOLD["decisions"]], ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def test_recorded_decisions(spark):
    rows = infer.holm(decision_rows(spark), ["model"], "p", "contrast").withColumn("sign_p", infer.exact_sign_p(F.col("positive"), F.col("n"), F.col("alternative") == "two_sided"))
    for r in decide.decide(rows).collect():
        assert r.holm_adjusted_p == pytest.approx(r.want_holm, rel=1e-12)
        assert (r.result_status, r.interpretation) == (r.want_status, r.want_interpretation)
        assert r.sign_p == pytest.approx(r.want_sign_p, rel=1e-10)


def test_recorded_verdicts(spark):
    rows = decide.decide(infer.holm(decision_rows(spark), ["model"], "p", "contrast"))
    found = {r.contrast: r for r in decide.across_models(rows, models=3).collect()}
    assert [found[c].fully_cross_model_replicated for c in ("C1", "C2", "C3")] == [False, True, True]
    assert [found[c].fully_cross_model_robust for c in ("C1", "C2", "C3")] == [False, True, True]
    c4 = found["C4"]
    assert (c4.cross_model_nonzero_difference_replicated, c4.cross_model_practical_equivalence, c4.heterogeneous) == (True, False, False)
    assert json.loads(found["C1"].model_statuses) == {"m1": "ROBUST", "m2": "ROBUST", "m3": "NOT SUPPORTED"}
    missing = decide.across_models(rows.where("model <> 'm3'"), models=3).where("contrast = 'C2'").first()
    assert not missing.fully_cross_model_replicated


def test_holm_vector(spark):
    rows = spark.createDataFrame([("C1", 0.001), ("C2", 0.02), ("C3", 0.01), ("C4", 0.5)], "c string, p double")
    assert {r.c: r.holm_adjusted_p for r in infer.holm(rows, [], "p", "c").collect()} == {"C1": 0.004, "C2": 0.04, "C3": 0.03, "C4": 0.5}


def test_sign_test_against_combinations(spark):
    cases = [(p, n) for n in (1, 2, 7, 50, 100, 1500) for p in {0, 1, n // 3, n // 2, n}]
    frame = spark.createDataFrame(cases, "pos int, n int")
    for r in frame.select("pos", "n", infer.exact_sign_p(F.col("pos"), F.col("n"), F.lit(False)).alias("one"), infer.exact_sign_p(F.col("pos"), F.col("n"), F.lit(True)).alias("two")).collect():
        tail = lambda a, b, n=r.n: sum(math.comb(n, k) for k in range(a, b + 1)) / 2**n
        assert r.one == pytest.approx(tail(r.pos, r.n), rel=1e-9)
        assert r.two == pytest.approx(min(1.0, 2 * tail(0, min(r.pos, r.n - r.pos))), rel=1e-9)


def test_signed_rank():
    x = np.array([3.0, -1.0, 2.0, 0.0, 5.0])
    values = [3, -1, 2, 5]
    w = sum(r for r, v in zip((3, 1, 2, 4), values, strict=True) if v > 0)
    import itertools

    brute = np.mean([sum(r for r, s in zip((1, 2, 3, 4), signs, strict=True) if s) >= w for signs in itertools.product((0, 1), repeat=4)])
    assert infer.signed_rank_p(x) == pytest.approx(brute)
    assert infer.signed_rank_p(np.zeros(3)) is None
    tied = infer.signed_rank_p(np.array([1.0, 1.0, 1.0, -1.0] * 30))
    assert 0 < tied < 1e-6


def test_student_tail():
    assert infer.student_tail(0.0, 5) == pytest.approx(0.5)
    assert infer.student_tail(2.015048372669157, 5) == pytest.approx(0.05, rel=1e-9)
    assert infer.student_tail(-2.015048372669157, 5) == pytest.approx(0.95, rel=1e-9)
    assert infer.t_test_p(np.ones(4)) is None


def test_resampling_depends_on_unit_order_only(spark, paired):
    args = (["model"], ["task_id"], "delta", None, 3000, 3000)
    a, b = (infer.resample(f, *args).first() for f in (paired, paired.orderBy(F.rand(3)).repartition(7)))
    assert a == b and 1 / 3001 <= a.signflip_p <= 1
    rows = paired.withColumn("delta", F.when(F.col("family") < "f25", -F.col("delta")).otherwise(F.col("delta")))
    r = infer.resample(rows, *args).first()
    mean = rows.agg(F.avg("delta")).first()[0]
    assert r.ci_low < mean < r.ci_high


def test_no_units_is_not_evaluable(spark):
    row = decision_rows(spark).limit(1).withColumns({"n": F.lit(0), "holm_adjusted_p": F.lit(None).cast("double")})
    assert decide.decide(row).first().result_status == "NOT EVALUABLE"


def test_rules_case_by_case(spark):
    base = {"model": "m", "contrast": "C4", "alternative": "two_sided", "n": 100, "mean": 0.02, "holm_adjusted_p": 0.001, "ci_low": 0.01, "ci_high": 0.03, "positive": 80, "negative": 20, "family_positive": 40, "family_negative": 10, "valid_vocab_mean_delta": 1.0, "semantic_step_mean_delta": 1.0, "margin": 0.05}
    cases = [
        ({}, decide.ROBUST, decide.SMALL),
        ({"semantic_step_mean_delta": -1.0}, decide.SENSITIVE, decide.SMALL),
        ({"margin": 0.025}, decide.ROBUST, decide.DIFFERENT),
        ({"positive": 60, "margin": 0.025}, decide.UNSUPPORTED, decide.DIFFERENT),
        ({"positive": 60}, decide.ROBUST, decide.SMALL),
        ({"holm_adjusted_p": 0.5}, decide.ROBUST, decide.EQUIVALENT),
        ({"holm_adjusted_p": 0.5, "margin": 0.03}, decide.UNSUPPORTED, decide.INCONCLUSIVE),
        ({"mean": -0.02, "ci_low": -0.03, "ci_high": -0.01, "margin": 0.01, "positive": 20, "negative": 80, "family_positive": 10, "family_negative": 40, "valid_vocab_mean_delta": -1.0, "semantic_step_mean_delta": -1.0}, decide.ROBUST, decide.DIFFERENT),
        ({"alternative": "positive"}, decide.ROBUST, None),
        ({"alternative": "positive", "valid_vocab_mean_delta": None}, decide.SENSITIVE, None),
        ({"alternative": "positive", "holm_adjusted_p": 0.01}, decide.UNSUPPORTED, None),
        ({"alternative": "positive", "family_positive": 34}, decide.UNSUPPORTED, None),
    ]
    kinds = {str: "string", int: "int", float: "double"}
    frame = spark.createDataFrame([tuple((base | {"model": str(k)} | c[0]).values()) for k, c in enumerate(cases)], ", ".join(f"{n} {kinds[type(v)]}" for n, v in base.items()))
    for r in decide.decide(frame).collect():
        assert (r.result_status, r.interpretation) == cases[int(r.model)][1:], cases[int(r.model)]


def test_draws_do_not_depend_on_how_many_are_held(monkeypatch):
    x = np.random.default_rng(3).normal(0.1, 1, 37)
    want = infer.flip_test(x, True, 3001), infer.percentile_ci(x, 2001)
    for cells in (1, 100, 37 * 64):
        monkeypatch.setattr(infer, "CELLS", cells)
        assert (infer.flip_test(x, True, 3001), infer.percentile_ci(x, 2001)) == want


def test_memory_of_resampling_many_units():
    import tracemalloc

    x = np.random.default_rng(4).normal(0, 1, infer.MAX_UNITS)
    tracemalloc.start()
    infer.flip_test(x, False, 40)
    infer.percentile_ci(x, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_numbered_has_no_gaps(spark):
    rows = spark.range(30000).selectExpr("id AS unit", "IF(id % 3 = 0, 'hot', concat('k', id % 50)) AS k")
    out = infer.numbered(rows, ["k"], ["unit"]).groupBy("k").agg(F.count("*").alias("n"), F.min("unit_no").alias("low"), F.max("unit_no").alias("high"), F.count_distinct("unit_no").alias("many"), F.max("n_units").alias("units"))
    assert all((r.low, r.high, r.many, r.units) == (0, r.n - 1, r.n, r.n) for r in out.collect())
