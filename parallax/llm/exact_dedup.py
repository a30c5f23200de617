"""Exact deduplication against a persistent digest index.

The index is a table (digest, keep_id, batch) bucketed and sorted by digest. A batch of new
data is reduced to one row per digest (map-side first, so a group of copies of any size
collapses before the shuffle), held against the index by a sort-merge join whose index side
needs no exchange (each bucket is sorted where it is read: appends leave a file each), and the
digests that the index lacks are found by a sort-merge anti-join and appended.

Rerun after a crash: every digest carries the name of the batch that brought it. Digests of the
batch's own name count as new, so a job that died after the append gives the same rows when it
runs again, and appends only what is missing. The default name is a checksum of the batch's
rows: the same rows are the same batch.

Defined cases: a null text counts as empty; equal means identical after replacing each run of
ASCII white space by one space; a null doc_id never wins against another one; of a group of
equal texts exactly one row stays, also if rows repeat a doc_id or lack one; an empty batch
appends nothing; texts of any length are hashed whole; other columns are never looked at,
whatever their names.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.llm.common import SPACE, delete, discard, few_or_merged, materialise, shared_dir, unused_names


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """Table `name`, stored below `path` and reopened from there under any settings of a session.

    The number of buckets is fixed when the index is made; the folder's name holds it.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.name = spark, name
        self.path = (path or f"{shared_dir(spark)}/{name}").rstrip("/")
        place = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        there = [m[1] for s in (files.listStatus(place) if files.exists(place) else []) if (m := re.fullmatch(r"digests-(\d+)", s.getPath().getName()))]
        self.buckets = int(there[0]) if there else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/digests-{self.buckets}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def resolve(self, rows: DataFrame, batch: str) -> DataFrame:
        """(digest, keep_id, keep_row, group_size, known) for each digest of `rows` (doc_id, digest, row)."""
        first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row"))
        groups = rows.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
        held = self.table().where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("held_id"), F.lit(True).alias("held")).hint("merge")
        found = groups.join(held, "digest", "left").withColumn("known", F.coalesce("held", F.lit(False)))
        return found.select("digest", F.when(F.col("known"), F.col("held_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size", "known")

    def append(self, resolved: DataFrame, batch: str) -> None:
        """Add the digests that the index does not hold yet."""
        fresh = resolved.select("digest", "keep_id").join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        fresh.repartition(self.buckets, "digest").select("digest", "keep_id", F.lit(batch).alias("batch")).write.insertInto(self.name)

    def drop(self) -> None:
        """Remove the index with its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def _judged(docs: DataFrame, index: DigestIndex, batch: str | None) -> tuple[DataFrame, DataFrame]:
    """Stored tables of `docs`: (doc_id, digest, row) of each row, and what the index makes of each digest; extends the index."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "digests")  # from here on a row's number is fixed
    if batch is None:
        batch = "-".join(map(str, rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "digest").cast("decimal(38,0)"))).first()))
    resolved = materialise(index.resolve(rows, batch), "resolved")
    index.append(resolved, batch)
    return rows, resolved


def dedup(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Deduplicate `docs` (doc_id, text) against `index` and itself, then extend the index.

    Returns (doc_id, keep_id, group_size, kept, text_sha256), one row per row of `docs`;
    group_size counts rows of this batch. The last join is a plain shuffle join of two
    stored tables, so adaptive execution can split the partition of a hot digest.
    """
    rows, resolved = _judged(docs, index, batch)
    out = rows.join(resolved.hint("merge"), "digest")
    return out.select("doc_id", "keep_id", "group_size", (~F.col("known") & (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An empty index in shared storage; table and files go when the driver ends."""
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")

    def drop() -> None:
        with contextlib.suppress(Py4JError, PySparkException, OSError):  # the JVM may be gone by now
            index.drop()

    atexit.register(drop)
    return index


def dedup_in_batches(docs: DataFrame, index: DigestIndex, batches: int) -> DataFrame:
    """dedup() of a table that comes as `batches` deliveries in the order of doc_id, each against what came before.

    group_size counts rows of all batches, and as ids ascend, keep_id is the smallest of all.
    Rows without an id come last.
    """
    own = F.col("doc_id").cast("long")
    cuts = sorted(set(docs.agg(F.percentile_approx(own, [k / batches for k in range(1, batches)], 1000)).first()[0] or []))
    parts = [(own > a) & (own <= b) for a, b in zip(cuts, cuts[1:], strict=False)]
    parts = [own <= cuts[0], *parts, (own > cuts[-1]) | own.isNull()] if cuts else [F.lit(True)]
    found = [materialise(dedup(docs.where(part), index), "batch") for part in parts]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    sizes = materialise(rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size")), "group-sizes")
    return rows.drop("group_size").join(sizes.hint("merge"), "text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_first(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Texts stay where they are: the ids that go are the small side of an anti-join. Only ids of
    which some rows stay and some go (repeated ids, or none) are looked at row by row again.
    """
    rows, resolved = _judged(docs, index, batch)
    stays = ~F.col("known") & (F.col("row") == F.col("keep_row"))
    ids = rows.join(resolved.hint("merge"), "digest").groupBy("doc_id").agg(F.bool_or(stays).alias("some"), F.bool_and(stays).alias("every"))
    ids = materialise(ids.where("not every"), "not-all-kept")
    discard(rows)
    id_, key, row, without = unused_names(docs, "_id", "_digest", "_row", "_null")
    own = F.col("doc_id").cast("long")
    there = few_or_merged(materialise(ids.select(F.col("doc_id").alias(id_)), "not-all-kept-ids"))
    out = docs.join(there, own.eqNullSafe(F.col(id_)), "left_anti")
    mixed = materialise(ids.where("some").select(F.col("doc_id").alias(id_)), "mixed-ids")
    if mixed.isEmpty():
        return out
    some = docs.join(few_or_merged(mixed), own.eqNullSafe(F.col(id_)), "left_semi")
    identity = lambda c: {row: F.coalesce(c, F.lit(0)), without: c.isNull()}
    some = some.withColumn(key, digest(F.col("text"))).withColumns(identity(own))
    kept = resolved.where("not known").select(F.col("digest").alias(key), "keep_id").withColumns(identity(F.col("keep_id"))).drop("keep_id")
    some = some.join(kept.hint("merge"), [key, row, without], "left_semi").dropDuplicates([key, row, without])
    return out.unionByName(some.select(*(F.col(f"`{c}`") for c in docs.columns)))
