"""Weighted rendezvous sharding of stable record keys.

Each (key, shard) pair hashes to a uniform u in (0, 1); a record goes to the shard with the
smallest -ln(u) / weight, so shard s gets weight(s) / sum of weights of the keys. Adding a
shard only lets the new shard win records; no record moves between old shards. Everything
is a row-local expression; only the numbering of rows inside a shard needs a shuffle, and
that is spread over 65,536 blocks per shard, in two levels, by a hash of id and text. The
numbering looks at its rows twice, so they are stored before, without texts: texts are read
once, in short batches, and a source that gives others when it is read again does no harm.

Defined cases: a null doc_id is the empty key; a null text has size 1 and crc32 0; rows
repeating a doc_id go to one shard and get slots of their own, which are dealt over the blocks by
their texts; of shards with equal scores the first wins; a text of any length is hashed whole;
empty input gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import materialise, prefix_sum, short_reads

def _digits(key: Column, shard: int) -> Column:
    """52 hash bits of the pair."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Index of the winning shard; `weights` has one positive weight per shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    races = [F.struct((-F.log((_digits(key, s).cast("double") + 0.5) / F.lit(2.0**52)) / F.lit(float(w))).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return (F.least(*races) if len(races) > 1 else races[0])["shard"]


def shard(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row.

    `grown`: the weights after growth, whose first ones equal `weights`; default one more
    shard of the mean weight. Slots run from 0 in the order of (salt, doc_id, crc32, size), the salt being four
    digits of a hash.
    """
    grown = grown or [*weights, sum(weights) / len(weights)]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"), rendezvous(key, grown).alias("grown_shard"),
    )
    salt = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")))
    rows = rows.withColumns({"_coarse": F.substring(salt, 1, 2), "_fine": F.substring(salt, 1, 4)})
    with short_reads(docs.sparkSession):
        rows = materialise(rows, "sharded")
    out = prefix_sum(rows, ["shard"], ["_coarse", "_fine"], ["doc_id", "text_crc32", "size"], {"slot": F.lit(1)})
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
