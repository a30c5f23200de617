import zlib

import numpy as np
import pytest

from parallax.llm import langid, queries


@pytest.fixture(scope="module")
def model(spark, sf):
    return langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))


def test_grams_stay_inside_texts_and_words():
    def of(text):
        return sorted((n, b) for n, (bucket, _) in zip(langid.SIZES, langid.grams(np.frombuffer(text, np.uint8), np.zeros(1, np.int64)), strict=False) for b in bucket.tolist())

    both = list(langid.grams(np.frombuffer(b"Ab cd" + b"xyz", np.uint8), np.array([0, 5])))
    for which, text in enumerate((b"ab CD", b"xyz")):
        assert sorted((n, b) for n, (bucket, doc) in zip(langid.SIZES, both, strict=True) for b in bucket[doc == which].tolist()) == of(text)
    assert of(b"a1b") == of(b"a b") and of(b"  ") == []


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op1_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in rows]) < 0.02


def test_calibration_is_not_overconfident():
    rng = np.random.default_rng(0)
    words = {"x": "qzj", "y": "aeo"}
    make = lambda k, n: "".join(rng.choice(list(words[k] + " "), n)).encode()
    labels = [("x", "y")[i % 2] for i in range(300)]
    texts = [make(k if rng.random() > 0.1 else "xy".replace(k, ""), 80) for k in labels]  # a tenth of the labels is wrong
    model = langid.train(texts, labels, [i % 3 == 0 for i in range(300)])
    _, score = model.predict(texts)
    assert 0.75 < score.mean() < 0.99
    again = langid.Model.load(model.dump())
    assert (again.predict(texts)[0] == model.predict(texts)[0]).all() and again.floor == model.floor


def test_never_learns_from_held_out_rows_or_their_labels(spark):
    rows = [(i, "alpha beta gamma" if i % 2 else "uno dos tres cuatro", "en" if i % 2 else "es") for i in range(200)]
    wrong = [(i, t, ("xx" if zlib.crc32(str(i).encode()) % 5 == 0 else n)) for i, t, n in rows]
    frames = [spark.createDataFrame(r, "doc_id long, text string, lang string") for r in (rows, wrong)]
    a, b = (langid.Model.load(langid.fit(f)) for f in frames)
    assert a.labels == b.labels == ["en", "es"] and np.array_equal(a.embedding, b.embedding)


def test_edges(docs, empty, model):
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for k in (3, 4, 5):
        assert (rows[k].lang_pred, rows[k].score, rows[k].rejected) == ("und", 0.0, True)
    assert rows[1].lang_pred != "und" and rows[7].lang_pred != "und"
    assert langid.fit(empty) is None and langid.predict(empty, model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    kept = langid.keep_known(docs, model)
    assert kept.schema == docs.schema
    assert {1, 2, 6} <= {r.doc_id for r in kept.collect()} and not {3, 4, 5} & {r.doc_id for r in kept.collect()}


def slow_prediction(model, text):
    """predict() by its definition, n-gram by n-gram."""
    raw = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    raw = [b if b >= 128 or 97 <= b <= 122 else 32 for b in raw]
    total, count = np.zeros(model.embedding.shape[1]), 0
    for n in langid.SIZES:
        for i in range(len(raw) - n + 1):
            gram = raw[i : i + n]
            if 32 in gram[1:-1] or (gram[0] == 32 and gram[-1] == 32):
                continue
            code = n
            for b in gram:
                code = (code ^ b) * 0x01000193 % 2**32
            code = (code ^ code >> 15) * 0x9E3779B1 % 2**32
            total += model.embedding[code >> 32 - langid.BUCKET_BITS]
            count += 1
    z = (total / max(count, 1) @ model.layer + model.bias) / model.temperature
    p = np.exp(z - z.max())
    return model.labels[int(p.argmax())], float(p.max() / p.sum())


def test_query_equals_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.Model.load(langid.fit(table))
    texts = {r.doc_id: r.text for r in table.collect()}
    rows = queries.op1_language_id(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.lang_pred == "und":
            assert not any(c.isalpha() for c in texts[r.doc_id] or "")
            continue
        lang, score = slow_prediction(model, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4 and r.rejected == (r.score < model.floor)


def test_long_texts_are_read_in_blocks(model, monkeypatch):
    own = langid.Model.load(model)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abc éü日 "), 700)).encode() for _ in range(5)] + [b"x" * 900, b"ab"]
    want = own.predict(texts)
    monkeypatch.setattr(langid, "SEGMENT", 64)
    best, score = own.predict(texts)
    assert (best == want[0]).all() and np.allclose(score, want[1], atol=1e-5)


def test_memory_of_a_very_long_text(model):
    import tracemalloc

    own, text = langid.Model.load(model), b"words of a very long text in one language " * (64 << 20 >> 5)
    tracemalloc.start()
    own.predict([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 64 << 20 and peak < 200 << 20


def test_every_label_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "HARD_CAP", 600)
    rows = [(i, f"l{i % 60} " * 5 + f"x{i}", f"l{i % 60}") for i in range(3000)]
    model = langid.Model.load(langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert len(model.labels) == 60


def test_repeated_ids_are_drawn_each(spark):
    rows = [(7, f"word{i} text", "en") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(frame, per_lang=10) is not None and langid.predict(frame, None).count() == 3000


def test_clashing_names(spark, model):
    frame = spark.createDataFrame([(1, "hello there", "en", 1, 2.0, "b")], "doc_id long, text string, lang string, at long, n double, fold string")
    assert langid.keep_known(frame, model).schema == frame.schema and langid.fit(frame) is not None
