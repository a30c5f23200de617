"""Rows that share an id, or lack one, are dealt over many tasks; names that clash with an operator's own do no harm."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parallax.llm import bpe, exact_dedup, langid, packing, quality, queries, secret_scan, sharding, simhash, token_planes
from parallax.llm.common import prefix_sum

ROWS = 60_000


@pytest.fixture(scope="module")
def one_id(spark):
    """A third of the rows has id 7, a third has none."""
    return spark.range(ROWS).selectExpr("CASE id % 3 WHEN 0 THEN 7 WHEN 1 THEN NULL ELSE id END AS doc_id", "concat('text number ', id, repeat(' w', int(id % 50)), ' ends') AS text").repartition(8)


def largest_window(monkeypatch, module):
    """The largest number of rows that a numbering window of the operator holds, seen from its input."""
    seen = []

    def spy(df, group, blocks, order, values):
        if any(c.startswith(("seq", "slot", "_slot")) for c in values):
            seen.append(df.groupBy(*group, *blocks).count().agg(F.max("count")).first()[0])
        return prefix_sum(df, group, blocks, order, values)

    monkeypatch.setattr(module, "prefix_sum", spy)
    return seen


def test_sharding(one_id, monkeypatch):
    seen = largest_window(monkeypatch, sharding)
    rows = sharding.shard(one_id, [1.0] * 8)
    slots = rows.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.count_distinct("slot").alias("many")).collect()
    assert sum(r.n for r in slots) == ROWS and all(r.n == r.many == r.last + 1 for r in slots)
    assert max(seen) < 100


def test_packing(one_id, monkeypatch):
    seen = largest_window(monkeypatch, packing)
    rows = packing.pack(one_id)
    places = rows.groupBy("bucket", "batch").agg(F.count("*").alias("n"), F.count_distinct("position").alias("many"), F.max("position").alias("last")).collect()
    assert sum(r.n for r in places) == ROWS and all(r.n == r.many == r.last + 1 for r in places)
    assert max(seen) < 100


def test_token_parts(spark, one_id):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small data would be put into one part
    try:
        path = token_planes.store(one_id, token_planes_path())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("ids"))
    sizes = sorted(r.ids for r in parts.collect())
    assert len(sizes) >= 3 and sizes[-1] < 0.6 * sum(sizes)
    back = token_planes.read_back(spark, path)
    assert back.count() == ROWS
    whole = back.agg(F.min("start"), F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens"), F.count_distinct("start")).first()
    assert whole[0] == 0 and whole[1] == whole[2] and whole[3] == ROWS


def token_planes_path():
    import public_tokenizers

    return public_tokenizers.path(queries.WORD_BPE)


def test_clashing_names_and_repeats(spark):
    import public_tokenizers

    names = ["_salt", "bucket", "fp", "node", "word", "digest", "known", "row", "root", "key", "size", "_n", "_hash", "at", "slot", "spans", "ids", "part"]
    texts = [(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (None, None), (2, ""), (2, "other words stand here today")]
    frame = spark.createDataFrame([(*t, *range(len(names))) for t in texts], f"doc_id long, text string, {', '.join(f'{n} int' for n in names)}")
    bare = frame.select("doc_id", "text")
    runs = {
        "langid": lambda d: langid.predict(d, None), "packing": packing.pack, "quality": quality.rules, "sharding": lambda d: sharding.shard(d, [1.0, 2.0]),
        "bpe": lambda d: bpe.round_trip(d, public_tokenizers.path(queries.BPE_RANKS), public_tokenizers.PATTERN), "secrets": lambda d: secret_scan.digests(secret_scan.scan(d)),
        "planes": lambda d: token_planes.read_back(spark, token_planes.store(d, token_planes_path())), "simhash": simhash.near_dups, "dedup": lambda d: exact_dedup.dedup(d, exact_dedup.fresh_index(spark)),
    }
    for name, run in runs.items():
        rows = [sorted(map(str, run(d).collect())) for d in (frame, bare)]
        assert rows[0] == rows[1] and len(rows[0]) == len(texts), name
    assert simhash.keep_one(frame).columns == frame.columns


def test_one_very_long_text_is_hashed_in_bounded_memory():
    code = """
import resource
from parallax.llm import simhash
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = "word_of_a_very_long_text_in_one_document " * (64 << 20 >> 5)
assert len(text) > 64 << 20
simhash.fingerprint(text)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / len(text))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True)
    assert float(out.stdout) < 5  # the text, its bytes, their lower-cased copy, and a block of words


def test_blocks_do_not_change_fingerprints(monkeypatch):
    texts = ["", "one", "two words", " a  b\tc\nd e f g h ", "x" * 300 + " y z", " ".join(f"w{i}" for i in range(200))]
    want = [(simhash.fingerprint(t), simhash.word_key(t), simhash.shingle_set(t)) for t in texts]
    for size in (1, 7, 50):
        monkeypatch.setattr(simhash, "TEXT_BLOCK", size)
        assert [(simhash.fingerprint(t), simhash.word_key(t), simhash.shingle_set(t)) for t in texts] == want
