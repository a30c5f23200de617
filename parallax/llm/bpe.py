"""Byte-level BPE by a monoid tree reduction.

A text is halved until pieces are short; pieces are encoded on their own and joined up the
tree. Joining two neighbours re-encodes only a window around the seam. The window grows in
both directions until it ends on positions at which the split pattern always ends a match,
whatever stands further away: an ASCII graphic character or a letter followed by an ASCII
blank. No alternative of the pattern has white space after another character, and a match
that ends there depends on nothing to its right, so
    encode(x + y) == encode(x) + encode(y)
for a cut at such a position. Tokens outside the window are therefore final. A text without
any such position is re-encoded whole, which is right as well. Decoding concatenates bytes
up the same kind of tree.

Defined cases: null is the empty text; the empty text has no ids; special-token strings are
ordinary text; unknown ids raise ValueError; a text of any length is a tree of leaves of at most
LEAF characters; rows that repeat an id are encoded each; an empty table gives no rows; other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import map_arrow, slices

#: Characters of a leaf, ids of a decoding leaf, first width of a boundary window.
LEAF, DECODE_LEAF, WINDOW = 512, 1024, 32
#: White-space runs from this length on are cut out here: the library's matcher overflows on very long ones.
LONG_RUN = 1000

_CUT = re.compile(r"(?:[!-~]|[^\W\d_])[ \t\n\r]")
_LONG = re.compile(rf"\s{{{LONG_RUN}}}")


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._split = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._length = {rank: len(token) for token, rank in ranks.items()}

    def _leaf(self, text: str) -> list[int]:
        if len(text) < LONG_RUN or not _LONG.search(text):
            return self._library.encode_ordinary(text)
        ids: list[int] = []
        for match in self._split.finditer(text):
            ids += self._library._core_bpe.encode_single_piece(match[0].encode())
        return ids

    def encode(self, text: str) -> list[int]:
        return self._node(text, 0, len(text)) if text else []

    def _node(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= LEAF:
            return self._leaf(text[a:b])
        m = (a + b) // 2
        return self._join(text, a, m, b, self._node(text, a, m), self._node(text, m, b))

    def _join(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[a:b] from those of text[a:m] and text[m:b]."""
        width = WINDOW
        while True:
            low, high = max(a, m - width), min(b, m + width)
            start = a if low == a else None
            for sure in _CUT.finditer(text, low, min(m + 1, b)):
                start = sure.start() + 1
            sure = _CUT.search(text, max(m - 1, a), high)
            end = sure.start() + 1 if sure else b if high == b else None
            if start is not None and end is not None:
                break
            width *= 2
        if start == m or end == m:
            return left + right
        keep = self._without(left, len(text[start:m].encode()), last_first=True)
        skip = self._without(right, len(text[m:end].encode()), last_first=False)
        return left[: len(left) - keep] + self._leaf(text[start:end]) + right[skip:]

    def _without(self, ids: list[int], size: int, *, last_first: bool) -> int:
        """How many ids at one end make up `size` bytes."""
        count, length = 0, self._length
        for i in reversed(ids) if last_first else ids:
            if size <= 0:
                break
            size -= length[i]
            count += 1
        if size:
            raise AssertionError("a cut fell inside a token")
        return count

    def decode(self, ids: Sequence[int]) -> bytes:
        try:
            parts = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + DECODE_LEAF])) for i in range(0, len(ids), DECODE_LEAF)]
        except KeyError as error:
            raise ValueError(f"unknown id {error.args[0]}") from None
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            for rows in slices(batch):
                ids = [own.encode(text or "") for text in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded): the bytes of each row of (doc_id, ids); null ids are no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            raw = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    return map_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to.

    Encodes and decodes row by row in one pass, so that ids never leave the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            for rows in slices(batch):
                n, ids_sha, raw_sha = [], [], []
                for text in rows.column(1).to_pylist():
                    ids = own.encode(text or "")
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    raw_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
