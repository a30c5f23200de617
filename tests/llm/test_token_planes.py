import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from parallax.llm import queries, token_planes
from parallax.llm.token_planes import END, WordEncoder, pack, unpack

PATH = public_tokenizers.path(queries.WORD_BPE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_planes_round_trip():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 49408, 1000), np.array([2**32 - 1, 0, 7]), np.zeros(9), np.empty(0), rng.integers(0, 2**31, 4097)):
        for mode in ("byte", "bit"):
            assert (unpack(pack(ids.astype(np.uint32), mode)) == ids.astype(np.uint32)).all()
    with pytest.raises(ValueError):
        unpack(pack(np.arange(10))[:-1])
    with pytest.raises(ValueError):
        unpack(b"xxxx" + pack(np.arange(10))[4:])


def test_encoder_equals_the_library(library, sf):
    rng = random.Random(5)
    bits = ["don't", "I'LL", "İstanbul", "ŉ", "ſ", "ΣΑΣ", "é", "é", "\xa0", "\x1c", "\x85", "ß", "ÀÉ", "日本", "12", "a1b2", "...", "'", " ", "\n", "  ", "²", "½", "ª", "<|endoftext|>", "<|x", "🙂", "_", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 20))) for _ in range(1500)] + pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()[:80]
    own = WordEncoder(PATH)
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def expected(rows, library):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, END], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize(("block", "mode"), [(token_planes.BLOCK, "byte"), (37, "byte"), (64, "bit")])
def test_documents_across_blocks(library, block, mode, monkeypatch):
    monkeypatch.setattr(token_planes, "BLOCK", block)
    own = WordEncoder(PATH)
    rows = [(k, "word " * n) for k, n in enumerate((0, 5, 36, 37, 300, 1, 0, 0, 75))]
    found: dict = {}
    for b in token_planes._blocks(((k, own.encode(t) + b"\1\0\0\0") for k, t in rows), mode):
        for doc_id, start, size, share in token_planes.pieces_of_block(b["payload"], b["first_id"], b["doc_ids"], b["doc_starts"], b["doc_sizes"]):
            found[doc_id, start, size] = found.get((doc_id, start, size), 0) ^ share
    assert [(*k, v) for k, v in sorted(found.items())] == expected(rows, library)


def test_query(spark, sf, library):
    table = pq.read_table(f"{sf}/documents.parquet")
    rows = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))
    assert sorted(tuple(r) for r in queries.op8_token_planes(spark, sf).collect()) == expected(rows, library)


def test_edges(spark, docs, empty, library):
    path = token_planes.store(docs, PATH)
    found = sorted((tuple(r) for r in token_planes.read_back(spark, path).collect()), key=lambda r: r[1])
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert found == expected(rows, library)
    assert token_planes.chunk_index(spark, path).where("base + first_id + n_ids <= 0").count() == 0
    assert token_planes.read_back(spark, token_planes.store(empty, PATH)).count() == 0


def test_a_tokenizer_of_another_kind_goes_through_the_library(sf):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, other = WordEncoder(path), Tokenizer.from_file(path)
    assert not own._known and WordEncoder(PATH)._known
    for text in ["Two  words", "İX don't", *pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()[:20]]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids
