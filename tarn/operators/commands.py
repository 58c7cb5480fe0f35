"""The query commands in the order in which they are written: from, where, flatten, group by, sort, limit, and the shapes of results."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tarn.functions import dynamic
from tarn.functions.values import truthy
from tarn.plans import groups

# ---- sources ----


def tagged(tag: str, tags: str = "tags") -> Column:
    """The tag itself or one below it."""
    tag = "#" + tag.lstrip("#")
    return F.exists(tags, lambda x: (x == tag) | x.startswith(tag + "/"))


def in_folder(name: str, path: str = "path") -> Column:
    """Everything below a folder, or the single file of that name."""
    c = F.col(path)
    return c.startswith(name.rstrip("/") + "/") | (c == name) | (c == name + ".md")


# ---- commands ----


def where(df: DataFrame, test: Column) -> DataFrame:
    """Rows where the value counts as true."""
    return df.where(truthy(test, df.select(test.alias("t")).schema[0].dataType))


def flatten(df: DataFrame, value: Column, name: str) -> DataFrame:
    """One row for each element of a list; a value that is no list stays as it is. Empty and absent lists keep their row with null."""
    kind = df.select(value.alias("t")).schema[0].dataType
    if not isinstance(kind, T.ArrayType):
        return df.withColumn(name, value)
    # the new column may replace the one that it is made from
    others = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*others, F.explode_outer(value).alias(name))


def group_rows(df: DataFrame, key: Column, name: str = "key", order: list[Column] | None = None) -> DataFrame:
    """(key, rows): the whole rows of each group as a list, sorted by their fields. For results that show the rows; sums and counts should use
    :func:`group_aggregate`, which never builds the lists."""
    rows = F.collect_list(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    return df.groupBy(key.alias(name)).agg(F.array_sort(rows).alias("rows"))


def grouped(df: DataFrame, key: Column, kind: T.DataType, name: str, aggregates: dict[str, Column], with_rows: bool) -> DataFrame:
    """Groups by a key of any type with some aggregates and, if wanted, the list of their rows (in the order of all fields that can be compared)."""
    found = [c.alias(n) for n, c in aggregates.items()]
    if with_rows:
        order = [c for c in df.schema if groups.orderable(c.dataType)]
        field_ = lambda f: F.col(f"`{f.name}`")
        if len(order) == len(df.columns):
            rows = F.array_sort(F.collect_list(F.struct(*map(field_, df.schema))))
        else:
            keyed = F.collect_list(F.struct(F.struct(*map(field_, order)).alias("order"), F.struct(*map(field_, df.schema)).alias("row")))
            rows = F.transform(F.array_sort(keyed, lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0)), lambda x: x["row"])
        found.append(rows.alias("rows"))
    if dynamic.is_value(kind):
        return df.groupBy(dynamic.key(key).alias("__key")).agg(F.first(key).alias(name), *found).drop("__key")
    key = key.alias(name)
    return df.groupBy(key).agg(*found) if found else df.select(key).distinct()


def group_aggregate(df: DataFrame, keys: dict[str, Column] | None, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates of groups, summed up before the shuffle; without keys one row for everything."""
    exprs = [c.alias(n) for n, c in aggregates.items()]
    return df.groupBy(*(c.alias(n) for n, c in keys.items())).agg(*exprs) if keys else df.agg(*exprs)


def sort(df: DataFrame, *keys: tuple[Column, str]) -> DataFrame:
    """Sort by (expression, 'asc' or 'desc') pairs; nulls come last either way."""
    return df.orderBy(*(c.desc_nulls_last() if way.lower().startswith("desc") else c.asc_nulls_last() for c, way in keys))


def rank_by(value: Column, order: list[str], other: int | None = None) -> Column:
    """Place of a value in a list of values; others come last."""
    places = F.create_map(*(F.lit(x) for i, v in enumerate(order) for x in (v, i)))
    return F.coalesce(F.try_element_at(places, value), F.lit(len(order) if other is None else other))


def limit(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """The first n rows by the keys. What follows works on these rows only, so a sort behind a limit sorts the limited set."""
    return df.orderBy(*keys).limit(n) if keys else df.limit(n)


# ---- shapes ----


def table(df: DataFrame, columns: dict[str, Column], ident: Column | None = None, ident_name: str = "File") -> DataFrame:
    first = [] if ident is None else [ident.alias(ident_name)]
    return df.select(*first, *(c.alias(n) for n, c in columns.items()))


def calendar(df: DataFrame, day: Column) -> DataFrame:
    """Rows by day; rows without a date are left out."""
    return df.select(F.to_date(day).alias("day")).where("day is not null").groupBy("day").agg(F.count(F.lit(1)).alias("rows"))


def markdown_table(df: DataFrame) -> Column:
    """A row as a line of a Markdown table."""
    cells = [F.coalesce(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"\|", r"\\|"), F.lit("-")) for c in df.columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown_head(names: list[str]) -> list[str]:
    """The first two lines of a Markdown table."""
    return ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]


def markdown_list(df: DataFrame) -> Column:
    """A row as a line of a Markdown list: the first column, then the others behind colons."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in df.columns]
    return F.concat(F.lit("- "), F.concat_ws(": ", *cells))


def with_total(df: DataFrame, label: str, name: str = "Total", average: bool = False) -> DataFrame:
    """The rows and one more with the sum (or average) of the numeric columns. ``is_total`` marks it."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != label]
    add = F.avg if average else F.sum
    total = df.agg(*(add(F.col(f"`{c}`").cast("double")).alias(c) for c in numeric))
    cells = [(F.lit(name) if c == label else F.col(f"`{c}`") if c in numeric else F.lit(None)).alias(c) for c in df.columns]
    rows = df.select(*(F.col(f"`{c}`").cast("double").alias(c) if c in numeric else F.col(f"`{c}`") for c in df.columns), F.lit(False).alias("is_total"))
    return rows.unionByName(total.select(*cells, F.lit(True).alias("is_total")))


def pivot_counts(df: DataFrame, series: str, category: str, values: list) -> DataFrame:
    """Counts by series (rows) and category (columns); absent pairs count 0."""
    counted = df.groupBy(series).pivot(category, values).agg(F.count(F.lit(1)))
    return counted.na.fill(0)


# ---- sequences ----


def previous_next(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each row with the value of the record before and after it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))


def as_of(df: DataFrame, day: str, moment: Column, strict: bool = True) -> DataFrame:
    """The last row before a moment (for one context row)."""
    test = F.col(day) < moment if strict else F.col(day) <= moment
    return df.where(test).orderBy(F.desc(day)).limit(1)


def day_before(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Each row with ``before``, the value of the row of the calendar day before (null if that day has none; the least of several)."""
    moved = df.groupBy(*(F.col(k).alias(f"__{k}") for k in keys), F.date_add(F.to_date(day), 1).alias("__day")).agg(F.min(value).alias("before"))
    same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.to_date(day) == F.col("__day"))
    return df.join(moved, same, "left").drop("__day", *(f"__{k}" for k in keys))


def day_runs(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Runs of consecutive days: keys, start, end, days."""
    days = df.select(*keys, F.to_date(day).alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(*keys).orderBy("day")))
    return days.withColumn("island", island).groupBy(*keys, "island").agg(F.min("day").alias("start"), F.max("day").alias("end"), F.count(F.lit(1)).alias("days")).drop("island")


def cycle_lengths(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs with the days from one start to the next."""
    following = F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))
    return runs.withColumn("cycle_days", F.date_diff(following, "start"))


def union_all(*frames: DataFrame) -> DataFrame:
    """Bag union by column name; duplicates stay."""
    return functools.reduce(lambda a, b: a.unionByName(b), frames)


def any_source(*tests: Column) -> Column:
    return functools.reduce(operator.or_, tests)


def all_sources(*tests: Column) -> Column:
    return functools.reduce(operator.and_, tests)
