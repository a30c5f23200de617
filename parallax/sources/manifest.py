"""File manifests: path, size and SHA-256 of the files of a release."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax import schemas
from parallax.operators import gates

#: Path parts and suffixes that no manifest lists. Fixed values.
SKIP_PARTS = (".git", ".idea", ".vscode", ".venv", "__pycache__")
SKIP_SUFFIXES = (".pyc", ".pyo")
TEXT_SUFFIXES = (".md", ".txt", ".json", ".csv", ".py", ".ps1")
#: Absolute paths of a user's home, which released text must not show. Fixed value.
USER_PATH = r"[A-Za-z]:[\\/]Users[\\/]"
BLOCK = 1 << 20


def sha256_file(path: Path) -> str:
    digest = hashlib.sha256()
    with path.open("rb") as file:
        while block := file.read(BLOCK):
            digest.update(block)
    return digest.hexdigest()


def listed(root: Path, but: Sequence[str] = ()) -> Iterator[tuple[str, Path]]:
    """(relative path, file) below `root` in path order, without skipped ones.

    Listed on the driver, because Spark's file sources leave out names that begin with `_` or `.`.
    """
    found = []
    for path in root.rglob("*"):
        name = path.relative_to(root).as_posix()
        parts = name.split("/")
        if path.is_file() and name not in but and path.suffix.lower() not in SKIP_SUFFIXES and not any(p in SKIP_PARTS or p.startswith(".venv_") for p in parts):
            found.append((name, path))
    yield from sorted(found)


def of_folder(spark: SparkSession, root: str, but: Sequence[str] = ()) -> DataFrame:
    """The manifest rows of a local release folder."""
    rows = [(name, path.stat().st_size, sha256_file(path)) for name, path in listed(Path(root), but)]
    return spark.createDataFrame(rows, schemas.MANIFEST)


def of_store(spark: SparkSession, path: str) -> DataFrame:
    """The manifest rows of any store that Spark reads, hashed on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def store_sha256(spark: SparkSession, path: str) -> str:
    """One hash of all files of a stored table: names, sizes and contents, in the order of names."""
    files = of_store(spark, path).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "size_bytes", "sha256")
    return gates.json_sha256([list(r) for r in files.orderBy("name", "sha256").collect()])  # a row for each file


def evidence_failures(path: Path, artifacts: int) -> list[tuple[str, str]]:
    """What is wrong with the manifest of an external archive: (path, failure)."""
    if not path.is_file():
        return [(path.name, "missing evidence manifest")]
    found = json.loads(path.read_text(encoding="utf-8"))
    wrong = [f"artifact count is {found.get('artifact_count')}, expected {artifacts}"] if found.get("artifact_count") != artifacts else []
    if len(found.get("artifacts", [])) != found.get("artifact_count", 0):
        wrong.append("artifact count differs from the artifacts listed")
    if found.get("missing_count") != 0:
        wrong.append("source artifacts were missing")
    return [(path.name, w) for w in wrong]


def document(rows: DataFrame, **head: Any) -> dict:
    """The manifest as one document; files in path order."""
    files = [r.asDict() for r in rows.orderBy("path").collect()]
    return head | {"file_count": len(files), "total_size_bytes": sum(f["size_bytes"] for f in files), "files": files}


def validate(spark: SparkSession, root: str, expected: DataFrame, but: Sequence[str] = (), forbidden: Sequence[str] = (), external: Sequence[str] = ("tokens.csv",), fixed: dict[str, str] | None = None, evidence: tuple[str, int] | None = None) -> DataFrame:
    """Failures of a release (path, failure): the manifest, forbidden names, files that belong elsewhere, fixed hashes, user paths.

    evidence: the manifest of the external archive below `root`, and the artifacts that it has to list.
    """
    folder = Path(root)
    actual = of_folder(spark, root, but)
    failures = gates.reconcile(expected, actual).where("status <> 'ok'").select("path", F.col("status").alias("failure"))
    found = [(n, "forbidden path") for n in forbidden if (folder / n).exists()]
    found += evidence_failures(folder / evidence[0], evidence[1]) if evidence else []
    pattern = re.compile(USER_PATH)
    hashes = {r.path: r.sha256 for r in actual.collect()} if fixed else {}
    found += [(p, "missing frozen file" if p not in hashes else "frozen file differs") for p, h in (fixed or {}).items() if hashes.get(p) != h]
    for name, path in listed(folder, but):
        if path.name in external:
            found.append((name, "belongs to the external archive"))
        if path.suffix.lower() in TEXT_SUFFIXES:
            try:
                text = path.read_text(encoding="utf-8")
            except UnicodeDecodeError:
                continue
            if pattern.search(text):
                found.append((name, "absolute user path"))
    return failures.unionByName(spark.createDataFrame(found, "path string, failure string"))
