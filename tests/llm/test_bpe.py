import base64
import hashlib
import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import regex
import tiktoken

from parallax.llm import bpe, queries

PATH = public_tokenizers.path(queries.BPE_RANKS)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture
def small(monkeypatch):
    """Leaves of a few characters, so that short texts have deep trees."""
    monkeypatch.setattr(bpe, "LEAF", 5)
    monkeypatch.setattr(bpe, "WINDOW", 2)
    return bpe.codec(PATH, public_tokenizers.PATTERN)


def test_joins_equal_the_library_on_random_texts(small, library):
    rng = random.Random(7)
    alphabet = ["a", "e", "s", "t", "'", "'re", "'ll", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "1", "23", "é", "日", "!", "...", "🙂", "é", "<|endoftext|>", "the", "ing"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))
        assert small.encode(text) == library.encode_ordinary(text), repr(text)
        assert small.decode(small.encode(text)) == text.encode()


def test_corpus(small, library, sf):
    for text in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()[:60]:
        assert small.encode(text) == library.encode_ordinary(text)


def test_long_runs(library):
    own = bpe.codec(PATH, public_tokenizers.PATTERN)
    for text in ("a" * 50000, " " * 300000, "\n" * 20000 + "x", "ab " * 30000, "word" * 9000 + "  " * 1500 + "x"):
        want = [i for m in regex.finditer(public_tokenizers.PATTERN, text) for i in library._core_bpe.encode_single_piece(m[0].encode())]
        assert own.encode(text) == want
        assert own.decode(want) == text.encode()
    with pytest.raises(ValueError):
        own.decode([10**9])


def test_query_and_edge_cases(docs, empty, library):
    rows = bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.round_trip(empty, PATH, public_tokenizers.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == {k: v or "" for k, v in texts.items()}


def test_query_over_all_documents(spark, sf, library):
    texts = dict(zip(*(pq.read_table(f"{sf}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text")), strict=True))
    rows = queries.op5_bpe_tree(spark, sf).collect()
    assert len(rows) == len(texts) and sum(len(t or "") > bpe.LEAF for t in texts.values()) > len(texts) / 2
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
