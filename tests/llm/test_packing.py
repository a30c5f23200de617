import itertools
import random
import re

import pyarrow.parquet as pq

from parallax.llm import packing, queries


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(150):
        lengths = rng.sample(range(1, 60), rng.randrange(1, 9))
        counts = [rng.randrange(1, 50) for _ in lengths]
        buckets = rng.randrange(1, 6)
        bounds = packing.boundaries(lengths, counts, buckets)
        others = [c for c in itertools.combinations(sorted(lengths), min(buckets, len(lengths))) if c[-1] == max(lengths)]
        assert len(bounds) <= buckets and bounds[-1] == max(lengths)
        assert padding(lengths, counts, bounds) == min(padding(lengths, counts, c) for c in others)
    assert packing.boundaries([], [], 3) == []


def check(rows, texts, max_len, budget, buckets):
    seen: dict = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r)
    for doc_id, own in seen.items():
        total = len(re.findall(r"[^\x20\x09-\x0D]+", texts[doc_id] or "")) + 1
        own.sort(key=lambda r: r.segment)
        assert [(r.segment, r.start) for r in own] == [(k, k * max_len) for k in range(len(own))]
        assert sum(r.n_tokens for r in own) == total and all(1 <= r.n_tokens <= max_len for r in own)
    bounds = sorted({r.bucket_len for r in rows})
    assert len(bounds) <= buckets
    lengths = [r.n_tokens for r in rows]
    assert all(r.bucket_len == min(b for b in bounds if b >= r.n_tokens) and r.padding == r.bucket_len - r.n_tokens for r in rows)
    groups: dict = {}
    for r in rows:
        groups.setdefault((r.bucket, r.bucket_len), {}).setdefault(r.batch, []).append(r.position)
    for (_, bound), batches in groups.items():
        room = budget // bound
        assert sorted(batches) == list(range(len(batches)))
        for k, positions in batches.items():
            assert sorted(positions) == list(range(len(positions))) and len(positions) <= room
            assert len(positions) == room or k == len(batches) - 1
    return lengths


def test_query(spark, sf):
    table = pq.read_table(f"{sf}/documents.parquet")
    texts = dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))
    rows = queries.op2_length_buckets(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts)
    check(rows, texts, packing.MAX_LEN, packing.BUDGET, packing.BUCKETS)


def test_small_limits_and_edges(spark, docs, empty):
    plain = docs.where("doc_id is not null and doc_id <> 2")
    texts = {r.doc_id: r.text for r in plain.collect()}
    check(packing.pack(plain, 7, 20, 3).collect(), texts, 7, 20, 3)
    assert packing.pack(empty).count() == 0
    rows = packing.pack(docs).collect()
    assert sorted((r.n_tokens, r.start) for r in rows if r.doc_id in (3, 4, 5)) == [(1, 0)] * 3
    assert sum(r.doc_id == 2 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
