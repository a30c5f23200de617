import json

import pytest

from parallax import schemas
from parallax.__main__ import main
from parallax.plans.queries import CORPUS
from parallax.sources import manifest
from parallax.sources.writers import write_json


def test_programs(spark, tmp_path):
    tasks, ir, rendered, report = (str(tmp_path / n) for n in ("tasks.json", "ir", "rendered", "report.json"))
    write_json(tasks, [{"id": n, "family": f, "task": n, "nl": ["words"], "python": [s]} for n, f, s in CORPUS])
    assert main(["build-ir", "--tasks", tasks, "--output", ir, "--variants", "1"], spark) == 0
    assert main(["render", "--ir", ir, "--output", rendered], spark) == 0
    assert main(["validate", "--rendered", rendered, "--output", report], spark) == 0
    assert all(c["passed"] for c in json.load(open(report))["checks"])
    head = json.load(open(f"{ir}.json"))
    assert head["program_count"] == len(CORPUS) and head["construct_counts"]["FunctionDef"] == len(CORPUS)
    assert main(["build-ir", "--tasks", tasks, "--output", f"{ir}2", "--variants", "1"], spark) == 0
    assert json.load(open(f"{ir}2.json"))["content_sha256"] == head["content_sha256"]
    assert main(["build-ir", "--tasks", tasks, "--output", ir, "--expected-sha256", "0"], spark) == 1


def test_analysis(spark, tmp_path):
    level = dict(zip(schemas.CONDITIONS, (1.3, 1.2, 1.0, 0.8, 0.6, 0.605), strict=True))
    rows = [(f"t{t}v{v}{c}", f"t{t:03d}", f"f{t // 2:02d}", c, v, True, x + (t % 3) / 1e4, x + 0.01, None if c == schemas.ANCHOR else x, None if c == schemas.ANCHOR else 1.0) for t in range(80) for c, x in level.items() for v in (1, 2, 3)]
    write_json(tmp_path / "registry.json", {"schema_version": "1.0", "models": [{"slug": s, "model_id": s, "revision": "r", "revision_source": "s", "c4_equivalence_margin": 0.04} for s in ("a", "b")]})
    for slug in ("a", "b"):
        spark.createDataFrame(rows, schemas.TRAJECTORY).write.parquet(str(tmp_path / f"results/{slug}/trajectories.parquet"))
        assert main(["analyze", "--results-dir", str(tmp_path / f"results/{slug}"), "--model-slug", slug, "--registry", str(tmp_path / "registry.json"), "--sign-flips", "1000", "--bootstraps", "1000"], spark) == 0
    assert main(["analyze", "--results-dir", str(tmp_path / "results/a"), "--trajectories", "7"], spark) == 1
    assert main(["compare", "--results-root", str(tmp_path / "results"), "--models", "2"], spark) == 0
    found = json.load(open(tmp_path / "analysis/cross_model_summary.json"))["contrasts"]
    assert found["C1"]["fully_cross_model_robust"] and found["C4"]["cross_model_practical_equivalence"]
    assert main(["publish", "--results-root", str(tmp_path / "results"), "--output", str(tmp_path / "tables")], spark) == 0


def test_measure_goes_on(spark, tmp_path, capsys):
    rows = [(f"t{t}", p, 1, [float(t), 1.0, 2.0]) for t in range(3) for p in (1, 2, 3)]
    scores, out = str(tmp_path / "scores"), str(tmp_path / "out")
    spark.createDataFrame(rows, "trajectory_id string, reference_position int, reference_token_id int, logits array<double>").write.parquet(scores)
    stimuli, report = str(tmp_path / "stimuli"), str(tmp_path / "report.json")
    spark.createDataFrame([("t0", "text")], "trajectory_id string, reference_text string").write.parquet(stimuli)
    write_json(report, {"passed": True, "stimuli_sha256": manifest.store_sha256(spark, stimuli)})
    write_json(f"{report}.old", {"passed": True, "stimuli_sha256": "0"})
    write_json(f"{report}.bad", {"passed": False, "stimuli_sha256": manifest.store_sha256(spark, stimuli)})
    run = ["measure", "--scores", scores, "--results-dir", out, "--stimuli", stimuli, "--validation", report]
    assert main(run, spark) == 1
    for other in (".old", ".bad"):
        assert main([*run, "--validation", report + other, "--confirm-real-run"], spark) == 1
    assert main([*run, "--confirm-real-run", "--limit", "2"], spark) == 0
    assert capsys.readouterr().out.startswith("2 of 3 trajectories, 6 tokens in ")
    config = json.load(open(f"{out}/config.json"))
    assert config["environment"]["spark"] == spark.version and config["stimuli_sha256"]
    assert spark.read.parquet(f"{out}/trajectories.parquet").count() == 2
    assert main([*run, "--confirm-real-run"], spark) == 0
    assert main([*run, "--confirm-real-run"], spark) == 0
    assert (spark.read.parquet(f"{out}/trajectories.parquet").count(), spark.read.parquet(f"{out}/tokens.parquet").count()) == (3, 9)
    assert main([*run, "--confirm-real-run", "--top-k", "2"], spark) == 1


def test_release(spark, tmp_path):
    root = tmp_path / "release"
    root.mkdir()
    (root / "a.txt").write_text("x")
    name = str(root / "MANIFEST.json")
    assert main(["manifest", "--root", str(root), "--output", name], spark) == 0
    assert main(["release-check", "--root", str(root), "--manifest", name], spark) == 0
    (root / "a.txt").write_text("y")
    assert main(["release-check", "--root", str(root), "--manifest", name], spark) == 1
    with pytest.raises(SystemExit):
        main(["nothing"], spark)


def test_audit_and_release(spark, tmp_path):
    root, results = tmp_path / "release", tmp_path / "results"
    root.mkdir()
    write_json(root / "summary.json", {"contrasts": {"C1": {"mean": 0.5, "ci": [0.25, 0.75]}}})
    (root / "text.md").write_text("The mean is 0.5000.")
    write_json(root / "EVIDENCE.json", {"artifact_count": 1, "missing_count": 0, "artifacts": [{"path": "x"}]})
    good = {"numbers": {"summary.json": {"contrasts.C1.mean": 0.5, "contrasts.C1.ci.1": 0.75}}, "texts": {"text.md": ["0.5000"]}, "hashes": {"text.md": manifest.sha256_file(root / "text.md")}}
    write_json(tmp_path / "expected.json", good)
    write_json(tmp_path / "wrong.json", {"numbers": {"summary.json": {"contrasts.C1.mean": 0.6, "contrasts.C9.mean": 1}}, "texts": {"text.md": ["0.6000"]}})
    run = ["audit", "--root", str(root), "--expected"]
    assert main([*run, str(tmp_path / "expected.json")], spark) == 0 and main([*run, str(tmp_path / "wrong.json")], spark) == 1
    spark.createDataFrame([("t", "t", "f", schemas.ANCHOR, 1, True, 1.0, 1.0, None, None)], schemas.TRAJECTORY).write.parquet(str(results / "m/trajectories.parquet"))
    release = ["release", "--root", str(root), "--results-root", str(results), "--manifest", str(root / "MANIFEST.json"), "--evidence", "EVIDENCE.json"]
    assert main([*release, "--expected", str(tmp_path / "expected.json"), "--artifacts", "1"], spark) == 0
    assert main([*release, "--expected", str(tmp_path / "expected.json"), "--artifacts", "45"], spark) == 1
    assert main([*release, "--expected", str(tmp_path / "wrong.json"), "--artifacts", "1"], spark) == 1


def test_smoke(spark, tmp_path):
    assert main(["smoke", "--output", str(tmp_path / "smoke")], spark) == 1
    assert main(["smoke", "--output", str(tmp_path / "smoke"), "--confirm-synthetic-smoke"], spark) == 0
