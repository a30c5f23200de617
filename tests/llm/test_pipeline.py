import re

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from parallax.llm import langid, packing, secret_scan

SMALL = "/root/testdata/sf0.001"


def slow_run(spark, rows):
    """The stages by plain loops; the language model is the same."""
    model = langid.Model.load(langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet")))
    known = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "") and (lambda s: s[1][0] >= model.floor)(model.predict([r[1].encode()]))]
    seen, first = set(), []
    for doc_id, text in sorted(known):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", text)
        if key not in seen:
            first.append((doc_id, text))
        seen.add(key)
    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for _, t in first]
    near = [[j for j, y in enumerate(sets) if len(x & y) >= 0.8 * len(x | y)] for x in sets]
    label = list(range(len(first)))
    while True:
        new = [min(label[j] for j in own) for own in near]
        if new == label:
            break
        label = new
    stays = [first[i] for i in range(len(first)) if label[i] == i]
    clean = []
    for doc_id, text in stays:
        spans = [(m.start(r.group), m.end(r.group)) for r in secret_scan.RULES for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
        for a, b in sorted(spans, reverse=True):
            text = text[:a] + "[SECRET]" + text[b:]
        clean.append((doc_id, text))
    return {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1 for i, t in clean}


def test_run_equals_brute_force(spark):
    table = pq.read_table(f"{SMALL}/documents.parquet")
    want = slow_run(spark, list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True)))
    found: dict = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + r.n_tokens
    assert found == want and len(found) < table.num_rows


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_take_empty_tables(spark, docs, empty, stage):
    out = stage(spark, docs, SMALL)
    assert out.columns == docs.columns and out.count() <= docs.count()
    assert stage(spark, empty, SMALL).count() == 0


def test_columns_of_clashing_names(spark):
    rows = [(1, "same text", "en", "password = hunter22", 7, "a", "x"), (2, "same text", "fr", "t", 8, "b", "y"), (3, "my token: abcdefgh", "en", "u", 9, "c", "z")]
    names = "doc_id long, text string, lang string, n_chars string, _digest long, _gone string, keep_id string"
    frame = spark.createDataFrame([(a, b, c, d, e, f, g) for a, b, c, d, e, f, g in rows], names)
    kept = {r.doc_id: tuple(r) for r in corpus_pipeline.exact_copies(spark, frame, SMALL).collect()}
    assert kept == {1: rows[0], 3: rows[2]}
    assert {r.doc_id: tuple(r) for r in corpus_pipeline.near_copies(spark, frame, SMALL).collect()} == kept
    masked = {r.doc_id: r for r in corpus_pipeline.secrets(spark, frame, SMALL).collect()}
    assert masked[3].text == "my token: [SECRET]" and masked[3].n_chars == "u"
    assert corpus_pipeline.batches(spark, frame, SMALL).count() == 3


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "secret scans", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and packing.MAX_LEN <= packing.BUDGET
