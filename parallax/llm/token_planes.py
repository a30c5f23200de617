"""Token-id output as compressed bit or byte planes.

Documents are range-partitioned by doc_id and a hash of the text, so that rows of one id are dealt
over many parts as well; each partition becomes one part of the file set.
A part is a run of blocks of `BLOCK` ids (the last one shorter). A block's ids are transposed
into byte or bit planes and each plane is compressed with zstandard on its own; high planes of
small ids vanish. A block is one row of a Parquet data set: the payload, the block's place in
the part (the chunk index: part, chunk, first_id, n_ids) and the documents that reach into it
(the document index: id, start in the part, length). Reading the index leaves payloads
untouched, and every block can be decoded alone, in any order, on any executor.

Defined cases: a null text is empty; every document ends with the end id, so none is without
ids; null doc_ids come first; rows repeating a doc_id are stored as documents of their own,
in the order of a hash of their texts, then of the texts; a text of any length reaches over as many
blocks as it needs; an empty table gives no blocks; other columns are not looked at, whatever their
names.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.llm.common import map_arrow, prefix_sum, remove_at_exit, shared_dir

#: Ids of a block; zstandard level; words that an encoder remembers; id that ends a document.
BLOCK, LEVEL, REMEMBERED, END = 1 << 16, 3, 400_000, 1
MAGIC = b"PLN1"
HEAD = struct.Struct("<4sBI")
SCHEMA = "part int, chunk int, first_id long, n_ids int, payload binary, doc_ids array<bigint>, doc_starts array<bigint>, doc_sizes array<bigint>"


def _planes(ids: np.ndarray, mode: str) -> list[bytes]:
    if mode == "byte":
        return [np.ascontiguousarray(p).tobytes() for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]
    return [np.packbits((ids >> np.uint32(b) & np.uint32(1)).astype(np.uint8)).tobytes() for b in range(32)]


def pack(ids: np.ndarray, mode: str = "byte", level: int = LEVEL) -> bytes:
    """One block as bytes: head, plane lengths, planes; a plane of zeros has length 0."""
    from zstandard import ZstdCompressor

    zstd = ZstdCompressor(level=level)
    planes = [zstd.compress(p) if any(p) else b"" for p in _planes(ids.astype(np.uint32), mode)]
    return b"".join([HEAD.pack(MAGIC, len(planes), len(ids)), struct.pack(f"<{len(planes)}I", *map(len, planes)), *planes])


def unpack(payload: bytes) -> np.ndarray:
    """The ids of one block."""
    from zstandard import ZstdDecompressor

    magic, count, size = HEAD.unpack_from(payload)
    if magic != MAGIC or count not in (4, 32):
        raise ValueError("not a block of planes")
    lengths = struct.unpack_from(f"<{count}I", payload, HEAD.size)
    at, zstd = HEAD.size + 4 * count, ZstdDecompressor()
    if len(payload) != at + sum(lengths):
        raise ValueError("a block is cut off")
    out = np.zeros((size, 4), np.uint8) if count == 4 else np.zeros(size, np.uint32)
    for k, length in enumerate(lengths):
        if length:
            plane = np.frombuffer(zstd.decompress(payload[at : at + length]), np.uint8)
            if count == 4:
                out[:, k] = plane
            else:
                out |= np.unpackbits(plane, count=size).astype(np.uint32) << np.uint32(k)
        at += length
    return out.reshape(-1).view("<u4").astype(np.uint32) if count == 4 else out


class WordEncoder:
    """The library's ids of whole texts, as little-endian 32-bit bytes.

    A tokenizer of the KNOWN kind drops white space and treats the words between independently of
    each other, so ids are remembered by word. Latin text is cut as the tokenizer cuts it; all
    other text is cut at ASCII white space and each word goes through the whole library call.
    Texts for a tokenizer of any other kind go through the whole library call.
    """

    #: Normaliser and splitting that the short cuts stand for. Fixed values.
    KNOWN = (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    )

    #: Text on which lower-casing and normal form are the same in both languages and need no neighbours.
    _LATIN = re.compile("[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-įı-ňŊ-ſ]*")
    _LETTERS = "a-z\xdf-\xf6\xf8-ſ"
    _SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")
    _SPACE = re.compile(r"[\x20\x09-\x0D]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._model = self._library.model
        made = json.loads(self._library.to_str())
        self._known = (made["normalizer"], made["pre_tokenizer"]) == self.KNOWN and all(t["content"].startswith("<|") for t in made["added_tokens"])
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self._bytes = dict(zip(plain, plain, strict=True)) | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in plain)}
        self._latin: dict[str, bytes] = {}
        self._other: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        tokens = self._model.tokenize(piece.encode().decode("latin-1").translate(self._bytes))
        return struct.pack(f"<{len(tokens)}I", *(t.id for t in tokens))

    def _word(self, word: str) -> bytes:
        ids = self._library.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if not self._known:
            return self._word(text)
        if self._LATIN.fullmatch(text) and "<|" not in text:
            words, known, encode = self._SPLIT.findall(text.lower()), self._latin, self._piece
        else:
            words, known, encode = self._SPACE.split(text), self._other, self._word
        if len(known) > REMEMBERED:
            known.clear()
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            for word in set(words):
                if word not in known:
                    known[word] = encode(word)
            return b"".join(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _blocks(rows: Iterator[tuple[int | None, bytes]], mode: str) -> Iterator[dict]:
    """Blocks of one part; rows: doc_id and ids of each document in order."""
    held, first, chunk, total = bytearray(), 0, 0, 0
    reach: list[tuple] = []  # the documents that reach into the block that is filled now

    def block(size: int) -> dict:
        ids = np.frombuffer(bytes(held[: 4 * size]), "<u4")
        return {"chunk": chunk, "first_id": first, "n_ids": size, "payload": pack(ids, mode), "doc_ids": [d[0] for d in reach], "doc_starts": [d[1] for d in reach], "doc_sizes": [d[2] for d in reach]}

    for doc_id, ids in rows:
        reach.append((doc_id, total, len(ids) // 4))
        total += len(ids) // 4
        held += ids
        while len(held) >= 4 * BLOCK:
            yield block(BLOCK)
            del held[: 4 * BLOCK]
            first, chunk = first + BLOCK, chunk + 1
            reach = [d for d in reach[-1:] if d[1] + d[2] > first]
    if held:
        yield block(len(held) // 4)


def write(docs: DataFrame, tokenizer: str, path: str, mode: str = "byte") -> None:
    """Encode each whole text, append the end id, and write all ids in ascending doc_id order under `path`."""
    end = struct.pack("<I", END)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        rows = ((doc_id.as_py(), own.encode(text.as_py() or "") + end) for batch in batches for doc_id, text in zip(batch.column(0), batch.column(1), strict=True))
        schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int32()), ("payload", pa.binary()), *((n, pa.list_(pa.int64())) for n in ("doc_ids", "doc_starts", "doc_sizes"))])
        for block in _blocks(rows, mode):
            yield pa.RecordBatch.from_pylist([block | {"part": part}], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text")
    map_arrow(dealt.select("doc_id", "text"), run, SCHEMA).write.parquet(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """(part, chunk, first_id, n_ids, base) of each block; base: the ids of all parts before."""
    blocks = spark.read.parquet(path).select("part", "chunk", "first_id", "n_ids")
    return blocks.join(part_bases(blocks), "part")


def part_bases(blocks: DataFrame) -> DataFrame:
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids")).withColumn("_hundreds", F.expr("part div 1024"))
    return prefix_sum(parts, [], ["_hundreds"], ["part"], {"base": F.col("ids")}).select("part", "base")


def _shifted(crc: int, zeros: int) -> int:
    """What `crc` adds to the crc32 of a text that goes on for so many bytes."""
    out, nothing, chunk = crc, 0, bytes(1 << 16)
    while zeros:
        step = min(zeros, len(chunk))
        out, nothing = zlib.crc32(chunk[:step], out), zlib.crc32(chunk[:step], nothing)
        zeros -= step
    return out ^ nothing


def pieces_of_block(payload: bytes, first: int, doc_ids: list, starts: list[int], sizes: list[int]) -> Iterator[tuple]:
    """(doc_id, start, size, share) of each document in a block; a document's crc32 is the xor of its shares."""
    raw = unpack(payload).astype("<u4").tobytes()
    last = first + len(raw) // 4
    for doc_id, start, size in zip(doc_ids, starts, sizes, strict=True):
        a, b = max(start, first), min(start + size, last)
        yield doc_id, start, size, _shifted(zlib.crc32(raw[4 * (a - first) : 4 * (b - first)]), 4 * (start + size - b))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the blocks under `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = list(pieces_of_block(row["payload"], row["first_id"], row["doc_ids"], row["doc_starts"], row["doc_sizes"]))
                columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(found), pa.int32()), *columns], ["part", "doc_id", "doc_start", "n_tokens", "share"])

    blocks = spark.read.schema(SCHEMA).parquet(path)
    docs = map_arrow(blocks.select("part", "first_id", "payload", "doc_ids", "doc_starts", "doc_sizes"), run, "part int, doc_id long, doc_start long, n_tokens long, share long")
    docs = docs.groupBy("part", "doc_start", "doc_id", "n_tokens").agg(F.bit_xor("share").alias("ids_crc32"))
    return docs.join(part_bases(blocks), "part").select("doc_id", (F.col("base") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32")


def store(docs: DataFrame, tokenizer: str, mode: str = "byte") -> str:
    """Write `docs` to a new place in shared storage, which goes when the driver ends; returns the path."""
    path = f"{shared_dir(docs.sparkSession)}/token-planes-{uuid.uuid4().hex}"
    remove_at_exit(docs.sparkSession, path)
    write(docs, tokenizer, path, mode)
    return path
