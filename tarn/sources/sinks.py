"""Writing results: single files without half-written states, one file for each row, and registries as JSON."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources.guards import check_file


def write_file(path: str, data: bytes) -> None:
    """Write a file in one step: temporary file beside it, flushed to disk, then renamed."""
    directory = os.path.dirname(os.path.abspath(path))
    os.makedirs(directory, mode=0o750, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=directory, prefix=".tmp-")
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(data)
            file.flush()
            os.fsync(file.fileno())
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def write_rows_as_files(rows: DataFrame, directory: str, name: str = "name", content: str = "content", suffix: str = ".md") -> None:
    """One file ``<name>.md`` for each row, written by the executors; the directory must be one that they share."""

    def save(part: Iterable) -> None:
        for row in part:
            write_file(os.path.join(directory, check_file(f"{row[0]}{suffix}", suffix)), row[1].encode())

    rows.select(name, content).foreachPartition(save)


def delete_rows_as_files(rows: DataFrame, directory: str, name: str = "name", suffix: str = ".md") -> None:
    """Delete ``<name>.md`` for each row, by the executors; files that are gone already are left out, so a retry does no harm."""

    def remove(part: Iterable) -> None:
        for row in part:
            path = os.path.join(directory, check_file(f"{row[0]}{suffix}", suffix))
            if os.path.exists(path):
                os.unlink(path)

    rows.select(name).foreachPartition(remove)


def save_registry(entries: dict, path: str) -> None:
    write_file(path, json.dumps(entries, sort_keys=True, ensure_ascii=False).encode())


def load_registry(path: str, into: dict | None = None) -> dict:
    """Entries of a file, put over those that are there already."""
    with open(path, encoding="utf-8") as file:
        return (into or {}) | json.load(file)


def save_index(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def load_index(spark: SparkSession, path: str, schema: str, over: DataFrame | None = None, key: str = "key") -> DataFrame:
    """A saved index; its rows replace those of ``over`` with the same key."""
    loaded = spark.read.schema(schema).json(path)
    return loaded if over is None else over.join(loaded.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti").unionByName(loaded)
