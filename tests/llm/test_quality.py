import base64
import random

import pyarrow.parquet as pq

from parallax.llm import quality, queries


def test_base_counts_equal_brute_force(monkeypatch):
    rng = random.Random(2)
    bits = ["a", "b", "c", " ", " ", "\n", "\t", "\x0b", "#", "é", "\x85", "a b c d e ", "\n\n", "<"]
    for many in (quality.MANY_WORDS, 3):
        monkeypatch.setattr(quality, "MANY_WORDS", many)
        for _ in range(800):
            text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 60)))
            assert quality.base(text) == quality.brute_force(text), repr(text)


def test_query(spark, sf):
    table = pq.read_table(f"{sf}/documents.parquet")
    texts = dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))
    rows = queries.op3_compression_bands(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[1:7]) == quality.brute_force(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    assert 0.5 < sum(r.kept for r in rows) / len(rows) < 0.99


def test_bands():
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choice(words) for _ in range(4000)).encode()
    bands = quality.Bands()
    assert all(bands.judge(prose[:n])[0] for n in (10, 100, 200, 400, 800, 1500, 3000, 20000))
    assert not bands.judge(b"spam and eggs " * 100)[0]
    assert not bands.judge(bytes(rng.randrange(33, 127) for _ in range(5000)))[0]
    hidden = prose[:8192] + b"x" * 8192
    assert not bands.judge(hidden)[0] and bands.judge(hidden)[2:] == (4, 2)


def test_edges(docs, empty):
    rows = quality.rules(docs).collect()
    assert len(rows) == docs.count() and quality.rules(empty).count() == 0
    for r in rows:
        if r.doc_id in (3, 4, 5):
            assert (r.n_words, r.base_failed, r.kept, r.ratio) == (0, True, False, None)
        if r.doc_id == 6:
            assert (r.n_words, r.n_repeat_words, r.kept) == (60000, 60000, False)


def test_every_byte_is_in_a_chunk():
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choice(words) for _ in range(4000)).encode()
    junk = bytes(rng.randrange(33, 127) for _ in range(4095))
    bands = quality.Bands()
    assert bands.judge(prose[:4095])[2:] == (0, 0) and bands.judge(prose[:4096])[2:] == (1, 0) and bands.judge(prose[:8193])[2:] == (3, 0)
    for first, last in ((prose[:4096], junk), (junk, prose[:4096])):
        assert not bands.judge(first + last)[0] and bands.judge(first + last)[2] == 2
    assert bands.judge(prose[:8192] + junk)[2:] == bands.judge(junk + prose[:8192])[2:] == (3, 1)


def test_base64_lines_are_rejected():
    rng = random.Random(6)
    bands = quality.Bands()
    for n in (300, 700, 1200, 3000, 5000, 20000, 80000):
        lines = base64.encodebytes(rng.randbytes(n))[:n]
        assert not bands.judge(lines)[0], n
    dump = base64.encodebytes(rng.randbytes(3000)).decode()
    assert not quality.base(dump)[-1] and not bands.judge(dump.encode())[0]


def slow_verdict(text):
    """kept, from the limits as written in the table, one call of the library for each piece."""
    import zstandard

    raw = (text or "").encode()
    if quality.brute_force(text)[-1]:
        return False
    ratio = lambda piece: len(zstandard.compress(piece, quality.LEVEL)) / len(piece)
    if len(raw) < 64:
        return True
    band = [b for b in quality.BANDS if b[0] <= len(raw)][-1]
    pieces = []
    if len(raw) >= 4096:
        pieces = [raw[i : i + 4096] for i in range(0, len(raw) - len(raw) % 4096, 4096)]
        if len(raw) % 4096:
            pieces.append(raw[-4096:])
    bad = sum(1 for p in pieces if ratio(p) < quality.CHUNK_BAND[0] or ratio(p) > quality.CHUNK_BAND[1])
    return band[1] <= ratio(raw) <= band[2] and 3 * bad <= len(pieces)


def test_verdict_equals_brute_force(spark):
    path = "/root/testdata/sf0.01"
    texts = dict(zip(*(pq.read_table(f"{path}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text")), strict=True))
    rows = queries.op3_compression_bands(spark, path).collect()
    assert len(rows) == len(texts) and {r.doc_id: r.kept for r in rows} == {k: slow_verdict(t) for k, t in texts.items()}
