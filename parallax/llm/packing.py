"""Packing into optimal length buckets.

Lengths are words plus one end token; a document longer than `max_len` is cut into segments of
max_len and a rest, so that nothing is lost and there are at most max_len different lengths.
The histogram of all segment lengths is the only thing the driver sees. Dynamic programming
over it finds the bucket boundaries with the least padding. Inside each bucket segments are
numbered and cut into batches of budget // boundary segments; only a bucket's last batch can
be short. Numbering is spread over 65,536 blocks of each bucket, in two levels, by a hash of id, text and segment.

Defined cases: a null or empty text is one segment of length 1 (the end token); rows that repeat
an id, or lack one, are packed as documents of their own and dealt over the blocks by their texts;
of boundaries with equal padding the fewest, then the smallest win; a text of any length is cut
into segments; an empty table packs into nothing; other columns are not looked at, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import WORD, materialise, prefix_sum

#: Longest segment, tokens of a batch with padding, buckets.
MAX_LEN, BUDGET, BUCKETS = 2048, 1 << 16, 8


def boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """Ascending upper bounds of `buckets` buckets or fewer with the least total padding."""
    order = np.argsort(lengths)
    size, many = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(size)
    if not n:
        return []
    before = np.r_[0, np.cumsum(many)]  # segments among the first i lengths
    tokens = np.r_[0, np.cumsum(many * size)]
    best = size * before[1:] - tokens[1:]  # padding of the first j + 1 lengths in one bucket
    choices = []
    for _ in range(1, min(buckets, n)):
        last = np.zeros(n, np.int64)
        new = best.copy()
        for j in range(1, n):
            # the last bucket holds the lengths after i, up to j
            cost = best[:j] + size[j] * (before[j + 1] - before[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            i = int(cost.argmin())
            if cost[i] < new[j]:
                new[j], last[j] = cost[i], i + 1
        choices.append(last)
        best = new
    bounds, j = [], n - 1
    for last in reversed(choices):
        bounds.append(int(size[j]))
        if not last[j]:  # one bucket less is as good
            continue
        j = int(last[j]) - 1
    bounds.append(int(size[j]))
    return sorted(set(bounds))


def segments(docs: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, segment, start, n_tokens, text_key); text_key: 16 bits of a hash of the text."""
    length = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long") + 1
    # texts are read once; the histogram and both passes of the numbering read lengths
    text_key = F.substring(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))), 1, 4)
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), length.alias("all_tokens"), text_key.alias("text_key")), "lengths")
    rows = rows.select("doc_id", "all_tokens", "text_key", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all_tokens") - 1) / max_len).cast("long"))).alias("segment"))
    start = F.col("segment") * max_len
    return rows.select("doc_id", "segment", start.alias("start"), F.least(F.lit(max_len).cast("long"), F.col("all_tokens") - start).alias("n_tokens"), "text_key")


def pack(docs: DataFrame, max_len: int = MAX_LEN, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, segment, start, n_tokens, bucket, bucket_len, batch, position, padding) of each segment."""
    if budget < max_len:
        raise ValueError("a batch must hold the longest segment")
    rows = segments(docs, max_len)
    histogram = rows.groupBy("n_tokens").count().collect()  # max_len rows at most
    bounds = boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets) or [max_len]
    upper = F.array(*(F.lit(b).cast("long") for b in bounds))
    bucket = F.size(F.filter(upper, lambda b: b < F.col("n_tokens")))
    salt = F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("segment").cast("string"), "text_key")), 1, 4)
    rows = rows.withColumns({"bucket": bucket, "_coarse": F.substring(salt, 1, 2), "_fine": salt})
    rows = prefix_sum(rows, ["bucket"], ["_coarse", "_fine"], ["doc_id", "segment", "n_tokens", "text_key"], {"_slot": F.lit(1)})
    rows = rows.withColumn("bucket_len", F.element_at(upper, F.col("bucket") + 1))
    room = F.floor(F.lit(budget) / F.col("bucket_len"))
    return rows.select(
        "doc_id", "segment", "start", "n_tokens", "bucket", "bucket_len", F.floor(F.col("_slot") / room).cast("long").alias("batch"),
        F.pmod(F.col("_slot"), room).cast("long").alias("position"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
