"""Sinks: atomic JSON documents, CSV exports, and idempotent appends."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(path: str | Path, value: Any) -> None:
    """One JSON document, replaced atomically; a failed write leaves the old file as it is."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            json.dump(value, out, ensure_ascii=False, indent=2)
            out.write("\n")
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str], allow_empty: bool = True) -> None:
    """A sorted CSV export with a fixed column order; other columns are left out.

    One file, for report tables only; large results are written as Parquet.
    """
    if not allow_empty and df.isEmpty():
        raise ValueError(f"nothing to write to {path}")
    df.select(*columns).orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Append to a Parquet table through Spark's commit protocol."""
    df.write.mode("append").partitionBy(*partition).parquet(path)


def append_new(df: DataFrame, path: str, keys: Sequence[str], partition: Sequence[str] = ()) -> None:
    """Append only rows whose key the table does not hold: a repeated append adds nothing."""
    from parallax.operators.resume import read_or_empty

    there = read_or_empty(df.sparkSession, path, df.schema).select(*keys)
    append(df.dropDuplicates(list(keys)).join(there, list(keys), "left_anti"), path, partition)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
