import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallax import schemas
from parallax.operators import summarise
from parallax.sources import manifest, readers, writers
from parallax.streaming import incremental


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes('﻿task_id,family,delta\n"a\n""b""",é,1.5\nc,,\n'.encode())
    rows = readers.csv_table(spark, str(path), schemas.TASK_DELTA).collect()
    assert [tuple(r) for r in rows] == [('a\n"b"', "é", 1.5), ("c", None, None)]
    frame = readers.csv_table(spark, str(path), schemas.TASK_DELTA)
    writers.write_csv(frame, str(tmp_path / "out"), ["task_id", "delta"], ["task_id"])
    back = readers.csv_table(spark, str(tmp_path / "out"), "task_id string, delta double").collect()
    assert [tuple(r) for r in back] == [('a\n"b"', 1.5), ("c", None)]
    with pytest.raises(ValueError):
        writers.write_csv(frame.limit(0), str(tmp_path / "none"), ["task_id"], ["task_id"], allow_empty=False)


def test_json(spark, tmp_path):
    path = tmp_path / "deep/tasks.json"
    writers.write_json(path, [{"id": "t", "family": "f", "task": "é", "nl": ["a"], "python": ["b"]}])
    assert readers.tasks(spark, str(path)).first().task == "é" and "é" in path.read_text()
    before = path.read_text()
    with pytest.raises(TypeError):
        writers.write_json(path, {"x": object()})
    assert path.read_text() == before and [p.name for p in path.parent.iterdir()] == ["tasks.json"]
    writers.write_json(tmp_path / "registry.json", {"schema_version": "1.0", "models": [{"slug": "m", "model_id": "x/m", "revision": "r", "revision_source": "s", "c4_equivalence_margin": 0.1}]})
    registry = readers.registry(spark, str(tmp_path / "registry.json"))
    assert readers.entry_of(registry, "m")["c4_equivalence_margin"] == 0.1
    with pytest.raises(KeyError):
        readers.entry_of(registry.unionAll(registry), "m")
    assert json.loads(writers.json_rows(registry).first().value)["slug"] == "m"


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for _ in range(2):
        writers.append_new(rows, path, ["k"])
    writers.append_new(spark.createDataFrame([("b", 9), ("c", 3), ("c", 3)], "k string, v int"), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_manifest(spark, tmp_path):
    root = tmp_path / "release"
    for name, body in {"_a.py": "x", ".hidden": "y", "sub/b.md": "text", "__pycache__/c.pyc": "z", "d.pyc": "z", ".venv_x/e": "z", "MANIFEST.json": "{}"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    rows = manifest.of_folder(spark, str(root), ["MANIFEST.json"])
    assert [r.path for r in rows.collect()] == [".hidden", "_a.py", "sub/b.md"]
    made = manifest.document(rows, schema_version=1)
    assert (made["file_count"], made["total_size_bytes"]) == (3, 6)
    check = lambda **more: {(r.path, r.failure) for r in manifest.validate(spark, str(root), rows, ["MANIFEST.json"], **more).collect()}
    assert check() == set()
    (root / "_a.py").write_text("C:\\Users\\me")
    (root / "sub/b.md").unlink()
    (root / "tokens.csv").write_text("t")
    assert check(forbidden=["sub"], fixed={"none": "0"}) == {("_a.py", "size_mismatch"), ("_a.py", "absolute user path"), ("sub/b.md", "missing"), ("tokens.csv", "unlisted"), ("tokens.csv", "belongs to the external archive"), ("sub", "forbidden path"), ("none", "missing frozen file")}
    stored = {r.path.rsplit("/", 1)[1]: r.sha256 for r in manifest.of_store(spark, str(root)).collect()}
    assert stored["tokens.csv"] == manifest.sha256_file(root / "tokens.csv")
    assert readers.text_files(spark, str(root), "*.csv").first().value == "t"


def test_scorer_plugin(spark):
    rows = spark.createDataFrame([("a", [1, 2, 3]), ("b", [4])], "t string, token_ids array<int>")
    scorer = lambda ids, mask: np.stack([ids, mask.sum(axis=1, keepdims=True).repeat(ids.shape[1], axis=1)], axis=2).astype(float)
    out = readers.scored(rows, scorer, pad=9).orderBy("position").collect()
    assert [(r.t, r.position, r.token_id, r.logits) for r in out] == [("a", 1, 2, [1.0, 3.0]), ("a", 2, 3, [2.0, 3.0])]
    ids, mask = readers.padded([[4], [1, 2, 3], []], pad=9)
    assert ids.tolist() == [[4, 9, 9], [1, 2, 3], [9, 9, 9]] and mask.tolist() == [[1, 0, 0], [1, 1, 1], [0, 0, 0]]
    with pytest.raises(Exception, match="exceeds the vocabulary"):
        readers.scored(rows, scorer, vocab=4).where("t = 'b'").count()
        readers.scored(rows, scorer, vocab=3).collect()
    assert readers.synthetic_records(spark, [("t", "f", "x")]).count() == len(schemas.CONDITIONS)


def test_incremental_stream(spark, tmp_path):
    schema = "trajectory_id string, pos int, entropy_top20_normalized double, entropy_valid_vocab double, p1 double"
    source, target, checkpoint = (str(tmp_path / n) for n in ("tokens", "out", "checkpoint"))
    make = lambda t: spark.createDataFrame([(t, k, k / 2, float(k), 0.95) for k in range(4)], schema)
    make("a").coalesce(1).write.parquet(source)
    run = lambda: incremental.summarise_stream(spark, source, make("x").schema, lambda df: summarise.trajectories(df, ["trajectory_id"], ["pos"]), target, checkpoint).awaitTermination(120)
    assert run()
    make("b").coalesce(1).write.mode("append").parquet(source)
    make("a").coalesce(1).write.mode("append").parquet(source)
    assert run()
    assert sorted(r.trajectory_id for r in spark.read.parquet(target).collect()) == ["a", "b"]


def test_event_time_windows(spark):
    rows = spark.createDataFrame([("x", "2024-01-01 00:00:10", 1.0), ("x", "2024-01-01 00:00:50", 3.0), ("x", "2024-01-01 00:01:10", 5.0)], "g string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    out = incremental.running_means(rows, "ts", "1 minute", "5 minutes", ["g"], "v").orderBy("start").collect()
    assert [(r.n, r.mean_v) for r in out] == [(2, 2.0), (1, 5.0)]
