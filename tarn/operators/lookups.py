"""Filters, lookups and file references over records."""

from __future__ import annotations

import functools
import operator
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.patterns import to_jvm
from tarn.operators.commands import tagged

OPERATORS = {
    "=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "in": lambda c, v: c.isin(list(v)), "contains": lambda c, v: F.contains(c, F.lit(v)), "exists": lambda c, v: c.isNotNull() if v else c.isNull(),
}


def condition(key: str, op: str, value) -> Column:
    """One filter; ``fileClass`` is compared without regard to case."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator '{op}'")
    column = F.col(key)
    if key in ("fileClass", "file_class") and op in ("=", "!=", "in"):
        column, value = F.lower(column), [x.lower() for x in value] if op == "in" else value.lower()
    return OPERATORS[op](column, value)


def query(records: DataFrame, *filters: tuple) -> DataFrame:
    """Records that meet all (key, operator, value) filters."""
    return records.where(functools.reduce(operator.and_, (condition(*f) for f in filters))) if filters else records


def by_path(records: DataFrame, path: str, column: str = "path") -> DataFrame:
    """One file, or everything below a directory."""
    c = F.col(column)
    return records.where((c == path) | c.startswith(path.rstrip("/") + "/"))


def by_class_prefix(records: DataFrame, directory: str | None = None, prefix: str | None = None, statuses: list[str] | None = None, path: str = "path", file_class: str = "file_class", status: str = "status") -> DataFrame:
    found = records
    if directory is not None:
        found = found.where(F.contains(F.col(path), F.lit(directory)))
    if prefix is not None:
        found = found.where(F.startswith(F.col(file_class), F.lit(prefix)))
    return found if statuses is None else found.where(F.col(status).isin(statuses))


def lookup_map(records: DataFrame, name: str, path: str) -> DataFrame:
    """name -> path, the smallest path where a name repeats, as rows (one for each name): a map that may grow with the data stays a table."""
    return records.groupBy(F.col(name).alias("name")).agg(F.min(path).alias("path"))


def choices(records: DataFrame, name: str, empty: str = "Null") -> DataFrame:
    """(nth, name): the distinct names without regard to case, after an entry for none; ``nth`` orders them."""
    found = records.where(F.col(name).isNotNull()).groupBy(F.lower(name).alias("key")).agg(F.min(name).alias("name"))
    sorted_ = F.array_sort(F.collect_list(F.struct("key", "name")))  # a list that a person chooses from
    listed = found.agg(F.concat(F.array(F.lit(empty)), F.transform(sorted_, lambda x: x["name"])).alias("names"))
    return listed.select(F.posexplode("names").alias("nth", "name"))


def negatable(column: Column, pattern: str | None) -> Column:
    """Regular expression on a column; a leading ``^`` negates it."""
    if not pattern:
        return F.lit(True)
    if pattern.startswith("^"):
        return ~F.regexp_like(column, F.lit(to_jvm(pattern[1:])))
    return F.regexp_like(column, F.lit(to_jvm(pattern)))


def file_reference(rows: DataFrame, value: str, index: DataFrame, file_class: str | None = None, directory: str | None = None, missing: bool = False) -> DataFrame:
    """Rows whose value is a path, or ``[[basename]]``, of a file in the index (path, basename, folder, file_class) that fits class and directory.
    ``missing`` gives the others. Two semi-joins on plain keys; no row is multiplied."""
    allowed = index.where(negatable(F.col("file_class"), file_class) & negatable(F.col("folder"), directory))
    link = F.regexp_extract(F.col(value), r"^\[\[([^\]|#]+)", 1)
    keys = allowed.select(F.col("path").alias("key")).union(allowed.select(F.concat(F.lit("[["), F.col("basename")).alias("key"))).distinct()
    wanted = F.when(link != "", F.concat(F.lit("[["), link)).otherwise(F.col(value))
    return rows.join(keys, wanted == F.col("key"), "left_anti" if missing else "left_semi")


def timed_statistics(records: DataFrame, valid: Column) -> dict[str, float]:
    """Counts of an indexing run and the seconds that it took."""
    began = time.monotonic()
    row = index_statistics(records, valid).first()
    return row.asDict() | {"seconds": time.monotonic() - began}


def index_statistics(records: DataFrame, valid: Column) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("records"), F.count_if(~valid).alias("warnings"))


def assign_class(records: DataFrame, field: str | None, tags: str | None, by_tag: dict[str, str], queries: list[tuple[Column, str]], fallback: str | None) -> DataFrame:
    """Class of a record: its own field, else a tag (or a tag above it), else the last query that matches, else the fallback."""
    choices = [F.nullif(F.col(field), F.lit(""))] if field else []
    if tags:
        choices += [F.when(tagged(t, tags), F.lit(c)) for t, c in by_tag.items()]
    choices += [F.when(test, F.lit(c)) for test, c in reversed(queries)]
    choices.append(F.lit(fallback).cast("string"))
    return records.withColumn("assigned_class", F.coalesce(*choices))
