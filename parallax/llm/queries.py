"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parallax.llm import bpe, chat, exact_dedup, langid, packing, quality, secret_scan, sharding, simhash, token_planes
from parallax.llm.common import table

#: Production parameters.
SHARD_WEIGHTS = (1.0,) * 8
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
SHINGLE_WORDS, MAX_BITS = 3, 2
#: Deliveries in which the documents reach the digest index; the second one meets a filled index.
DEDUP_BATCHES = 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_WEIGHTS)


def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op6_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.read_back(spark, token_planes.store(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)))


def op9_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dups(table(spark, sf_dir, "documents"), SHINGLE_WORDS, MAX_BITS)
    return found.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_in_batches(table(spark, sf_dir, "documents"), exact_dedup.fresh_index(spark), DEDUP_BATCHES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_length_buckets, op3_compression_bands, op4_rendezvous_shards, op5_bpe_tree, op6_perspective_rotation, op7_secret_scan, op8_token_planes, op9_simhash_near_dups, op10_exact_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


#: Least padding of the first j lengths in k buckets or fewer, with their bounds; equal costs keep fewer buckets, then the smaller cut.
_MORE_BUCKETS = "".join(
    f"""
             e{k} AS (SELECT j, arg_min(cost, (cost, i)) AS cost, arg_min(bounds, (cost, i)) AS bounds FROM
                      (SELECT j, 0 AS i, cost, bounds FROM e{k - 1} UNION ALL SELECT p.j, e.j, e.cost + p.pad, list_append(e.bounds, p.j_len) FROM e{k - 1} e JOIN pad p ON p.i = e.j AND p.i < p.j) GROUP BY j),"""
    for k in range(2, packing.BUCKETS + 1)
)

SQL = {
    "op2_length_buckets": rf"""
        WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n, substr(md5(coalesce(text, '')), 1, 4) AS text_key FROM documents),
             s AS (SELECT doc_id, segment, segment * {packing.MAX_LEN} AS start, least({packing.MAX_LEN}, n - segment * {packing.MAX_LEN}) AS n_tokens, text_key FROM (SELECT *, unnest(range((n - 1) // {packing.MAX_LEN} + 1)) AS segment FROM d)),
             h AS (SELECT n_tokens, count(*) AS many, row_number() OVER (ORDER BY n_tokens) AS j FROM s GROUP BY n_tokens),
             t AS (SELECT *, sum(many) OVER (ORDER BY j) AS before, sum(many * n_tokens) OVER (ORDER BY j) AS tokens FROM h UNION ALL SELECT 0, 0, 0, 0, 0),
             pad AS (SELECT a.j AS i, b.j AS j, b.n_tokens AS j_len, b.n_tokens * (b.before - a.before) - (b.tokens - a.tokens) AS pad FROM t a JOIN t b ON a.j < b.j),
             e1 AS (SELECT j, pad AS cost, [j_len] AS bounds FROM pad WHERE i = 0),{_MORE_BUCKETS}
             u AS (SELECT bounds FROM e{packing.BUCKETS} ORDER BY j DESC LIMIT 1),
             p AS (SELECT *, len(list_filter(bounds, lambda b: b < n_tokens)) AS bucket FROM s, u),
             o AS (SELECT *, bounds[bucket + 1] AS bucket_len, row_number() OVER (PARTITION BY bucket ORDER BY substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), segment::VARCHAR, text_key)), 1, 4), doc_id NULLS FIRST, segment, n_tokens, text_key) - 1 AS slot FROM p)
        SELECT doc_id, segment, start, n_tokens, bucket::INT AS bucket, bucket_len, slot // ({packing.BUDGET} // bucket_len) AS batch, slot % ({packing.BUDGET} // bucket_len) AS position, bucket_len - n_tokens AS padding FROM o""",
    "op4_rendezvous_shards": r"""
        WITH tab AS (SELECT [list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) for n in range(256)] AS tab),
             d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, coalesce(text, '') AS said FROM documents),
             b AS (SELECT doc_id, key, strlen(said) + 1 AS size, [('0x' || p)::BIGINT for p in regexp_extract_all(hex(encode(said)), '..')] AS bytes FROM d),
             c AS (SELECT doc_id, key, size, xor(list_reduce([4294967295] || bytes, lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS text_crc32 FROM b, tab),
             k AS (SELECT DISTINCT key, s, -ln((('0x' || substr(md5(key || ':' || s), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS score FROM d, range(9) r(s)),
             w AS (SELECT key, arg_min(s, score) FILTER (s < 8) AS shard, arg_min(s, score) AS grown_shard FROM k GROUP BY key)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, grown_shard::INT AS grown_shard,
               row_number() OVER (PARTITION BY shard ORDER BY substr(md5(key || ':' || text_crc32), 1, 4), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
        FROM c JOIN w USING (key)""",
    "op6_perspective_rotation": r"""
        WITH s AS (SELECT coalesce(conv_id, -1) AS conv_id, coalesce(turn, -1) AS turn, coalesce(nullif(role, ''), 'unknown') AS speaker, coalesce(text, '') AS said FROM conversations),
             v AS (SELECT *, md5(speaker || ':' || said) AS h, regexp_replace(said, '<(\|+im_(?:start|end)\|>)', '<|\1', 'g') AS plain, regexp_replace(regexp_replace(speaker, '<(\|+im_(?:start|end)\|>)', '<|\1', 'g'), '[\r\n]', ' ', 'g') AS called FROM s),
             c AS (SELECT DISTINCT conv_id, speaker AS perspective FROM s WHERE speaker <> 'system'),
             r AS (SELECT *, CASE speaker WHEN perspective THEN 'assistant' WHEN 'system' THEN 'system' ELSE 'user' END AS role FROM v JOIN c USING (conv_id)),
             t AS (SELECT *, '<|im_start|>' || role || CASE role WHEN 'user' THEN ' name=' || called ELSE '' END || chr(10) AS head FROM r),
             g AS (SELECT *, head || plain || '<|im_end|>' || chr(10) AS segment FROM t),
             n AS (SELECT *, row_number() OVER w - 1 AS seq, (sum(length(segment)) OVER w)::BIGINT AS end_char FROM g
                   WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT conv_id, perspective, seq, turn, role, CASE role WHEN 'user' THEN speaker END AS name, segment, end_char - length(segment) AS start_char, end_char,
               CASE role WHEN 'assistant' THEN end_char - length(segment) + length(head) END AS mask_start, CASE role WHEN 'assistant' THEN end_char END AS mask_end
        FROM n""",
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY ALL)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
        FROM d JOIN g USING (text_sha256)""",
}
