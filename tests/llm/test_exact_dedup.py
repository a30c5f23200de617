import hashlib
import re
from collections import defaultdict

import pytest

from parallax.llm import exact_dedup
from parallax.llm.exact_dedup import DigestIndex, dedup, dedup_in_batches, keep_first, fresh_index

IDS = "doc_id long, text string"


def slow(rows):
    """One row of each group of equal texts stays: a smallest id, or the first of rows that share it."""
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[norm(text)].append(doc_id)
    out, taken = [], set()
    for doc_id, text in rows:
        own = groups[norm(text)]
        keep = min((i for i in own if i is not None), default=None)
        kept = doc_id == keep and norm(text) not in taken
        if kept:
            taken.add(norm(text))
        out.append((doc_id, keep, len(own), kept, hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out, key=str)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rows_equal_brute_force(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert plain(dedup(docs, fresh_index(spark))) == slow(rows)
    assert plain(dedup_in_batches(docs, fresh_index(spark), 3)) == slow(rows)
    assert dedup(empty, fresh_index(spark)).count() == dedup_in_batches(empty, fresh_index(spark), 2).count() == 0


def test_one_row_of_a_group_stays(spark):
    rows = [(7, "a b"), (7, "a b"), (8, "a  b"), (None, "c"), (None, "c"), (None, "a\tb"), (7, "d"), (9, "d")]
    frame = spark.createDataFrame(rows, IDS)
    found = dedup(frame, fresh_index(spark)).collect()
    assert len(found) == len(rows) and sum(r.kept for r in found) == len({r.text_sha256 for r in found}) == 3
    assert sorted((r.doc_id, r.text) for r in keep_first(frame, fresh_index(spark)).collect() if r.doc_id) == [(7, "a b"), (7, "d")]
    assert keep_first(frame, fresh_index(spark)).count() == 3


def test_index_persists_between_batches(spark, docs):
    index = fresh_index(spark)
    first = dedup(docs, index).collect()
    size = index.table().count()
    assert size == len({r.text_sha256 for r in first})
    more = spark.createDataFrame([(0, "Same text here"), (90, "new"), (91, "new")], IDS)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in dedup(more, index).collect()) == [(0, 1, 1, False), (90, 90, 2, True), (91, 90, 2, False)]
    assert index.table().count() == size + 1
    assert keep_first(spark.createDataFrame([(5, "new"), (6, "newer")], IDS), index).collect() == [(6, "newer")]


class Killed(Exception):
    pass


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_killed_run_gives_the_same_rows_again(spark, docs, monkeypatch, when):
    index, want = fresh_index(spark), [(r.doc_id, r.text) for r in docs.collect()]
    dedup(spark.createDataFrame([(100, "word " * 60000)], IDS), index)
    append = DigestIndex.append

    def dies(self, resolved, batch):
        if when == "after":
            append(self, resolved.where("keep_id < 4"), batch)  # a part of the batch's digests was written
        raise Killed

    monkeypatch.setattr(DigestIndex, "append", dies)
    with pytest.raises(Killed):
        dedup(docs, index)
    monkeypatch.undo()
    again, once_more = plain(dedup(docs, index)), plain(dedup(docs, index))
    assert again == once_more == sorted(((i, k if k != 6 else 100, n, kept and k != 6, h) for i, k, n, kept, h in slow(want)), key=str)
    assert index.table().count() == index.table().select("digest").distinct().count()
    assert keep_first(docs, index).count() == sum(r[3] for r in again)


def test_reopened_under_other_settings(spark, docs):
    index = fresh_index(spark)
    dedup(docs, index)
    size = index.table().count()
    spark.sql(f"DROP TABLE {index.name}")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = DigestIndex(spark, "reopened_index", index.path)
        assert again.buckets == index.buckets and again.table().count() == size
        assert dedup(spark.createDataFrame([(0, "Same text here"), (1, "x")], IDS), again).where("kept").count() == 1
        assert again.table().count() == size + 1
        again.drop()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert not spark.catalog.tableExists("reopened_index")


def test_index_side_needs_no_exchange(spark, docs):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = fresh_index(spark)
        dedup(docs, index)
        dedup(spark.createDataFrame([(55, "other")], IDS), index)
        batch = spark.createDataFrame([(5, b"x" * 32, 0)], "doc_id long, digest binary, row long")
        plan = index.resolve(batch, "b")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_keep_first_keeps_whole_rows(spark, docs, empty):
    kept = keep_first(docs, fresh_index(spark))
    assert kept.schema == docs.schema
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (True, 1), (True, 3), (True, 5), (True, 6), (True, 7)]
    assert keep_first(empty, fresh_index(spark)).count() == 0


def test_clashing_names(spark):
    rows = [(1, "same text", 1, 2, 3, 4), (2, "same  text", 5, 6, 7, 8), (2, "other", 9, 9, 9, 9), (3, "more", 0, 0, 0, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest long, known long, keep_id long, _id long")
    assert sorted(r.keep_id for r in keep_first(frame, fresh_index(spark)).collect()) == [0, 3, 9]
    assert sum(r.kept for r in dedup(frame, fresh_index(spark)).collect()) == 3
    assert exact_dedup.dedup(frame, fresh_index(spark)).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
