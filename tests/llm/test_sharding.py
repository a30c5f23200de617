import hashlib
import math
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from parallax.llm import queries, sharding
from parallax.llm.common import READ_DEFAULT, READ_ROWS, READ_SETTING


def slow_shard(doc_id, weights):
    def score(s):
        digits = int(hashlib.md5(f"{'' if doc_id is None else doc_id}:{s}".encode()).hexdigest()[:13], 16)
        return -math.log((digits + 0.5) / 2**52) / weights[s]

    return min(range(len(weights)), key=score)


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_rendezvous_shards(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.shard == slow_shard(r.doc_id, [1.0] * 8) and r.grown_shard == slow_shard(r.doc_id, [1.0] * 9)
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_weights_and_growth(spark):
    frame = spark.range(20000).selectExpr("id AS doc_id", "'x' AS text")
    weights = [1.0, 2.0, 5.0]
    rows = sharding.shard(frame, weights, [*weights, 2.0]).collect()
    share = Counter(r.shard for r in rows)
    assert all(abs(share[s] / 20000 - w / 8) < 0.015 for s, w in enumerate(weights))
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert all(r.grown_shard == 3 for r in moved) and abs(len(moved) / 20000 - 0.2) < 0.015
    with pytest.raises(ValueError):
        sharding.shard(frame, [1.0, 0.0])


def test_edges(docs, empty):
    rows = sharding.shard(docs, [1.0] * 8).collect()
    assert len(rows) == docs.count() and sharding.shard(empty, [1.0] * 8).count() == 0
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id in (3, 4)} == {(1, 0)}
    assert len({r.shard for r in rows if r.doc_id == 2}) == 1 and len({r.slot for r in rows if r.doc_id == 2}) == 2
    assert [r.shard for r in rows if r.doc_id is None] == [slow_shard(None, [1.0] * 8)]


def test_texts_are_read_once(spark):
    """Rows are numbered and counted as they were first read; texts that differ at the next reading would lose rows."""
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        import os

        for b in batches:
            read.add(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([os.urandom(8).hex() for _ in range(b.num_rows)])], names=["doc_id", "text"])

    frame = spark.range(3000, numPartitions=4).mapInArrow(run, "doc_id long, text string")
    rows = sharding.shard(frame, [1.0] * 8).collect()
    assert read.value == 3000 and sorted(r.doc_id for r in rows) == list(range(3000))
    for s in range(8):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_texts_are_read_in_short_batches(spark, sf, monkeypatch):
    seen, store = [], sharding.materialise
    monkeypatch.setattr(sharding, "materialise", lambda df, label: seen.append(spark.conf.get(READ_SETTING)) or store(df, label))
    queries.op4_rendezvous_shards(spark, sf)
    assert seen == [str(READ_ROWS)] and spark.conf.get(READ_SETTING) == READ_DEFAULT
    spark.conf.set(READ_SETTING, "77")
    try:
        queries.op4_rendezvous_shards(spark, sf)
        assert seen[1:] == ["77"] and spark.conf.get(READ_SETTING) == "77"
    finally:
        spark.conf.unset(READ_SETTING)
