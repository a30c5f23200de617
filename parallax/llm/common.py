"""What the training-data operators share: tables, shared storage, prefix sums."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of the contracts: ASCII only, as Java, Python and RE2 all read it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    It is `spark.checkpoint.dir`. Only a local session (tests) may go without the
    setting; it gets one temporary folder for the life of the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    made = tempfile.mkdtemp(prefix="parallax-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def unused_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like `wanted` that no column of `df` has in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared storage, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver ends; readers of it may live until then."""

    def remove() -> None:
        with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone by now
            delete(spark, path)

    atexit.register(remove)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to shared storage and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables of materialise() that no frame still to be computed reads."""
    for df in stored:
        delete(df.sparkSession, df._stored_at)


#: Rows of one id that a join may broadcast.
BROADCAST_ROWS = 1_000_000


def few_or_merged(ids: DataFrame, most: int | None = None) -> DataFrame:
    """A stored table of ids as the small side of a join: broadcast up to BROADCAST_ROWS rows, else merged.

    most: a number of rows that `ids` does not exceed; if that is few, they are not counted.
    """
    few = (most is not None and most <= BROADCAST_ROWS) or ids.count() <= BROADCAST_ROWS
    return F.broadcast(ids) if few else ids.hint("merge")


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short runs of rows, so that only few texts are Python objects at a time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _give_back() -> None:
    """Return freed memory to the system: workers live on, and idle ones would keep what their largest task took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


#: Rows of a batch of the Parquet reader; the setting that bounds them, and its default.
READ_ROWS, READ_SETTING, READ_DEFAULT = 1024, "spark.sql.parquet.columnarReaderBatchSize", "4096"


@contextlib.contextmanager
def short_reads(spark: SparkSession) -> Iterator[None]:
    """Jobs of this block that read whole texts from Parquet hold READ_ROWS of them at a time in each task.

    The reader holds a batch as one array and doubles it while it grows. A value that somebody has set stays.
    """
    if spark.conf.get(READ_SETTING) != READ_DEFAULT:
        yield
        return
    spark.conf.set(READ_SETTING, str(READ_ROWS))
    try:
        yield
    finally:
        spark.conf.unset(READ_SETTING)


#: Rows of an Arrow batch; the setting that bounds them, and its default.
BATCH_ROWS, BATCH_SETTING, BATCH_DEFAULT = 1024, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def map_arrow(df: DataFrame, run: Run, schema: StructType | str) -> DataFrame:
    """df.mapInArrow() for rows with whole texts: in short batches, and the worker gives memory back when it has run.

    A batch is held by the executor and by its worker, and there is no setting of a single plan: the
    session's setting is lowered, unless somebody has set it.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        conf.set(BATCH_SETTING, str(BATCH_ROWS))

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(wrapped, schema)


def prefix_sum(df: DataFrame, group: list[str], blocks: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Add a column for each of `values`: its sum over all earlier rows of the group.

    Rows of a group are ordered by (`blocks` coarse to fine, then `order`). No window ever
    holds more than one finest block or the totals of one block's children, so a group of
    any size is spread over many tasks. Key columns must not be null.
    """
    keys = [*group, *blocks]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumns({name: F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long") for name, value in values.items()})
    if not blocks:
        return inner
    totals = df.groupBy(*keys).agg(*(F.sum(value).cast("long").alias(f"_of_{name}") for name, value in values.items()))
    bases = prefix_sum(totals, group, blocks[:-1], [blocks[-1]], {f"_to_{name}": F.col(f"_of_{name}") for name in values})
    bases = bases.select(*keys, *(f"_to_{name}" for name in values))
    return inner.join(bases, keys).withColumns({name: F.col(name) + F.col(f"_to_{name}") for name in values}).drop(*(f"_to_{name}" for name in values))
