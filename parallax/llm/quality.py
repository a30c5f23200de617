"""Quality rules: compression bands over whole documents and fixed chunks.

A zstandard ratio (compressed / raw bytes) below a band's floor means repetition, above its
ceiling incompressible junk. Limits depend on length, because short texts carry the frame's
overhead and have little to repeat. Texts of `CHUNK` bytes or more are also cut into chunks of
that size, each held against limits of its own; the last one reaches back to be full, so that
every byte is judged. A text fails if more than `BAD_CHUNKS` of its chunks do, which finds junk
that the rest of a document hides. Everything is row-local.

Defined cases: a null or empty text has no words and fails the base rules; texts shorter than
the first band are judged by the base rules alone; a ratio on a limit passes; a text of any length
is judged whole, chunk by chunk; rows that repeat an id are judged each on its own; an empty table
gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import map_arrow, slices

#: (bytes from, ratio from, ratio to). Floors are near 0.6 of the median ratio of ordinary prose of that length,
#: ceilings from 256 bytes on between the largest ratio of sf0.1 (0.745, 0.698, 0.592, 0.521) and base64's least (0.846, 0.797, 0.775, 0.754).
BANDS = ((64, 0.50, 1.30), (128, 0.43, 1.05), (256, 0.38, 0.82), (512, 0.35, 0.77), (1024, 0.31, 0.72), (2048, 0.28, 0.68), (65536, 0.22, 0.68))
CHUNK, CHUNK_BAND, BAD_CHUNKS, LEVEL = 4096, (0.24, 0.68), 1 / 3, 3
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: From so many words on, windows are compared as sorted integers, not as tuples.
MANY_WORDS = 20_000
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of five that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if len(words) < MANY_WORDS:
        windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
        if len(set(windows)) == n:
            return 0
        count = Counter(windows)
        found = np.fromiter((count[w] > 1 for w in windows), bool, n)
    else:
        ids: dict[bytes, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        window = code[:n]
        for k in range(1, WINDOW):  # names of windows of k + 1 words, from those of k words
            window = np.unique(window * (len(ids) + 1) + code[k : k + n], return_inverse=True)[1]
        found = np.bincount(window)[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[k : k + n] |= found
    return int(covered.sum())


def base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes: ASCII white space only
    lines = [line for line in raw.split(b"\n") if line.strip()]
    blank = len(raw) - sum(map(len, words))
    repeated = repeat_words(words)
    return len(words), len(text) - blank, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(words) < 10 or 100 * repeated > 20 * len(words)


class Bands:
    def __init__(self):
        from zstandard import ZstdCompressor

        self._zstd = ZstdCompressor(level=LEVEL)

    def ratio(self, raw: bytes) -> float:
        return len(self._zstd.compress(raw)) / len(raw)

    def judge(self, raw: bytes) -> tuple[bool, float | None, int, int]:
        """Passes, ratio of the whole, chunks, bad ones."""
        if len(raw) < BANDS[0][0]:
            return True, None, 0, 0
        ratio = self.ratio(raw)
        low, high = next((low, high) for start, low, high in reversed(BANDS) if len(raw) >= start)
        starts = [min(i, len(raw) - CHUNK) for i in range(0, len(raw), CHUNK)] if len(raw) >= CHUNK else []
        chunks = [self.ratio(raw[i : i + CHUNK]) for i in starts]
        bad = sum(not CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in chunks)
        return low <= ratio <= high and bad <= BAD_CHUNKS * len(chunks), ratio, len(chunks), bad


def rules(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, the base counts, base_failed, kept, and the ratios behind the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands()
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                counts = base(text)
                passes, ratio, chunks, bad = bands.judge(text.encode())
                rows.append((*counts, not counts[-1] and passes, ratio, chunks, bad))
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, COLUMNS)


def brute_force(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """base() from its definition, by regular expressions and plain loops."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n
