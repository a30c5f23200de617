"""Typed readers: JSON documents, CSV tables, Parquet tables, text files, registries, score vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from parallax import schemas


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that is one JSON document, or one array of them."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def tasks(spark: SparkSession, path: str) -> DataFrame:
    return json_documents(spark, path, schemas.TASK)


def csv_table(spark: SparkSession, path: str, schema: StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header, doubled quotes, line breaks inside fields and an optional byte-order mark.

    Columns are matched by position; `columns` projects, and only those are parsed.
    """
    frame = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    return frame.select(*columns) if columns else frame


def text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, value): whole text files below `path`."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The model registry: one row per model."""
    models = json_documents(spark, path, StructType().add("schema_version", "string").add("models", ArrayType(schemas.REGISTRY)))
    return models.select(F.explode("models").alias("_m")).select("_m.*")


def entry_of(registry_rows: DataFrame, slug: str) -> dict:
    """The one registry entry of a slug."""
    found = registry_rows.where(F.col("slug") == slug).limit(2).collect()
    if len(found) != 1:
        raise KeyError(f"{len(found)} registry entries for {slug}")
    return found[0].asDict()


def padded(sequences: Sequence[Sequence[int]], pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids and attention mask of a batch, padded on the right to its longest sequence."""
    width = max(map(len, sequences), default=0)
    ids, mask = np.full((len(sequences), width), pad, np.int64), np.zeros((len(sequences), width), np.int64)
    for k, own in enumerate(sequences):
        ids[k, : len(own)] = own
        mask[k, : len(own)] = 1
    return ids, mask


def scored(sequences: DataFrame, scorer: Callable[[np.ndarray, np.ndarray], np.ndarray], ids: str = "token_ids", batch: int = 8, pad: int = 0, vocab: int | None = None) -> DataFrame:
    """Score vectors of each position by a plug-in: a function from ids and mask of a padded batch to vectors (batch, position, vocabulary).

    Adds (position, token_id, logits): the vector at position p - 1 scores the token at p. Rows
    are sorted by length inside an Arrow batch, so that a scorer pads little. An id that is not
    below `vocab` is an error.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sequences.schema) + ", position int, token_id int, logits array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = sorted((r for r in frame.to_dict("records") if r[ids] is not None), key=lambda r: len(r[ids]))
            for start in range(0, len(rows), batch):
                part = rows[start : start + batch]
                tokens, mask = padded([r[ids] for r in part], pad)
                if vocab is not None and (tokens * mask >= vocab).any():
                    raise ValueError("a token id exceeds the vocabulary")
                vectors = scorer(tokens, mask)
                made = [row | {"position": p, "token_id": int(tokens[k, p]), "logits": vectors[k][p - 1]} for k, row in enumerate(part) for p in range(1, len(row[ids]))]
                if made:
                    yield pd.DataFrame(made)

    return sequences.mapInPandas(run, schema)


def synthetic_records(spark: SparkSession, tasks_rows: Sequence[tuple[str, str, str]], conditions: Sequence[str] = schemas.CONDITIONS) -> DataFrame:
    """Debug records: (task_id, family, text) in every condition, one variant each."""
    rows = [(f"{t}__v1__{c}", t, f, 1, c, f"{c}: {text}") for t, f, text in tasks_rows for c in conditions]
    return spark.createDataFrame(rows, "trajectory_id string, task_id string, family string, variant int, condition string, reference_text string")
