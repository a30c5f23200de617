"""The whole analysis on constructed trajectories, and its gates."""

import pytest
from pyspark.sql import functions as F

from parallax import schemas
from parallax.operators import gates
from parallax.plans import publish

LEVEL = dict(zip(schemas.CONDITIONS, (1.3, 1.20, 1.00, 0.80, 0.60, 0.605), strict=True))


@pytest.fixture(scope="module")
def trajectories(spark):
    """100 tasks in 50 families, 3 variants, 6 conditions, with a little spread."""
    rows = []
    for t in range(100):
        for c, level in LEVEL.items():
            for v in (1, 2, 3):
                x = level + ((t * 7 + v * 3) % 11 - 5) / 10000 + (0.0001 * (t % 5) if c == "python_opaque" else 0)
                rows.append((f"t{t:03d}__v{v}__{c}", f"t{t:03d}", f"f{t // 2:02d}", c, v, True, x, x + 0.01, None if c == schemas.ANCHOR else x + 0.02, None if c == schemas.ANCHOR else 0.99))
    return spark.createDataFrame(rows, schemas.TRAJECTORY)


def test_analysis(spark, trajectories):
    margins = spark.createDataFrame([("C4", 0.0360463677)], "contrast string, margin double")
    found = {r.contrast: r for r in publish.analyse(trajectories, 1800, 600, margins, flips=1000, boots=1000).collect()}
    assert [found[c].result_status for c in ("C1", "C2", "C3")] == ["ROBUST"] * 3
    assert found["C4"].equivalent and found["C4"].interpretation == "statistically_detectable_but_practically_small"
    assert found["C1"].n == 100 and found["C1"].family_n == 50 and found["C1"]["mean"] == pytest.approx(0.2)


def test_tables(spark, trajectories):
    margins = spark.createDataFrame([("m", "C4", 0.036)], "model_slug string, contrast string, margin double")
    rows = trajectories.withColumn("model_slug", F.lit("m"))
    tasks, families = publish.contrasts_of(rows, by=["model_slug"])
    assert publish.unpaired(tasks).count() == 0 and (tasks.count(), families.count()) == (400, 200)
    decided = publish.summaries(tasks, families, margins, ["model_slug"], 500, 500)
    table = publish.intervention_table(decided).collect()
    assert len(table) == 4 and [r.contrast for r in table if r.equivalence_margin is not None] == ["C4"]
    means = publish.condition_table(rows).orderBy("place").collect()
    assert [r.condition for r in means] == list(schemas.CONDITIONS)
    assert publish.forest_rows(decided).count() == 4 and publish.equivalence_rows(decided).count() == 1


def test_gates(spark, trajectories):
    report = lambda rows: {r.check: r.passed for r in gates.trajectory_gates(rows, 1800, 600, covered=schemas.CONDITIONS[1:]).collect()}
    assert all(report(trajectories).values())
    broken = trajectories.where("trajectory_id <> 't000__v1__pseudocode'")
    assert not report(broken)["trajectories"] and not report(broken)["cells_of_other_size"]
    assert not report(trajectories.withColumn("step_mapped_token_fraction", F.when(F.col("task_id") != "t001", F.col("step_mapped_token_fraction"))))["coverage_pseudocode"]
    assert not report(trajectories.limit(0))["all_valid"]
    with pytest.raises(gates.GateError):
        gates.enforce(gates.trajectory_gates(broken, 1800, 600))
    one_sided = trajectories.where("NOT (task_id = 't005' AND condition = 'pseudocode')")
    assert {(r.contrast, r.task_id) for r in publish.unpaired(publish.contrasts_of(one_sided)[0]).collect()} == {("C2", "t005"), ("C3", "t005")}
