"""Functions of the note query language on Spark columns.

A function that takes one value also takes a list, element by element, when ``many`` is set; the query compiler sets it from the column's
type. Nulls give null unless said otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def each(value: Column, function: Callable[[Column], Column], many: bool = False) -> Column:
    return F.transform(value, function) if many else function(value)


def truthy(value: Column, kind: T.DataType) -> Column:
    """Whether a value counts as true: not null, not false, not 0, not the empty text, list or object."""
    if isinstance(kind, T.BooleanType):
        test = value
    elif isinstance(kind, T.NumericType):
        test = value != 0
    elif isinstance(kind, T.StringType):
        test = value != ""
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        test = F.size(value) > 0
    else:
        test = value.isNotNull()
    return F.coalesce(test, F.lit(False))


#: Names of types in the language by Spark type.
def type_name(kind: T.DataType) -> str:
    for types, name in (((T.StringType,), "string"), ((T.BooleanType,), "boolean"), ((T.NumericType,), "number"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "date"), ((T.ArrayType,), "array"), ((T.NullType,), "null")):
        if isinstance(kind, types):
            return name
    if isinstance(kind, T.StructType):
        names = set(kind.names)
        return "duration" if names == {"months", "micros"} else "link" if {"path", "display", "embed"} <= names else "object"
    return "object"


def number(value: Column) -> Column:
    """The first number in a text."""
    return F.regexp_extract(value, r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def text(value: Column) -> Column:
    return value.cast("string")


def contains(holder: Column, part: Column, kind: T.DataType, fold: bool = False, loose: bool = False) -> Column:
    """Object key, list element or substring. ``fold`` ignores case; ``loose`` also finds substrings of list elements."""
    low = (lambda c: F.lower(c)) if fold else (lambda c: c)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType):
            test = (lambda x: F.contains(low(x), low(part))) if loose else (lambda x: low(x) == low(part))
            return F.exists(holder, test)
        return F.array_contains(holder, part)
    if isinstance(kind, T.MapType):
        return F.map_contains_key(holder, part)
    if isinstance(kind, T.StructType):
        return F.array_contains(F.array(*map(F.lit, kind.names)), part)
    return F.contains(low(holder.cast("string")), low(part.cast("string")))


def contains_word(value: Column, word: str, many: bool = False) -> Column:
    pattern = F.lit(rf"(?i)\b\Q{word}\E\b")
    return each(value, lambda x: F.regexp_like(x, pattern), many)


def regex_test(pattern: str, value: Column, whole: bool = False) -> Column:
    return F.regexp_like(value, F.lit(rf"^(?:{pattern})\z" if whole else pattern))


def regex_replace(value: Column, pattern: str, replacement: str, many: bool = False) -> Column:
    return each(value, lambda x: F.regexp_replace(x, pattern, replacement), many)


def replace(value: Column, old: Column, new: Column, many: bool = False) -> Column:
    return each(value, lambda x: F.replace(x, old, new), many)


def split(value: Column, pattern: str, limit: int | None = None) -> Column:
    """Parts between matches; a limit keeps the first parts and drops the rest; captured groups are part of the result."""
    groups = re.compile(pattern).groups
    if not groups:
        parts = F.split(value, pattern, -1)
    else:
        between = F.split(value, pattern, -1)
        caught = [F.regexp_extract_all(value, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
        gaps = F.sequence(F.lit(0), F.size(between) - 1)
        parts = F.flatten(F.transform(gaps, lambda i: F.concat(F.array(F.get(between, i)), F.when(i < F.size(between) - 1, F.array(*(F.get(c, i) for c in caught))).otherwise(F.array().cast("array<string>")))))
    return parts if limit is None else F.slice(parts, 1, limit)


def pad(value: Column, width: int, fill: str = " ", left: bool = True, many: bool = False) -> Column:
    """Pads to the width; longer text stays as it is."""
    padder = F.lpad if left else F.rpad
    return each(value, lambda x: F.when(F.length(x) >= width, x).otherwise(padder(x, width, fill)), many)


def substring(value: Column, start: int, end: int | None = None, many: bool = False) -> Column:
    """From position ``start`` (0-based) to ``end`` (exclusive)."""
    if end is None:
        return each(value, lambda x: F.substring(x, start + 1, 2**31 - 1), many)
    return each(value, lambda x: F.substring(x, start + 1, max(0, end - start)), many)


def truncate(value: Column, length: int, suffix: str = "...", many: bool = False) -> Column:
    return each(value, lambda x: F.when(F.length(x) > length, F.concat(F.left(x, F.lit(max(0, length - len(suffix)))), F.lit(suffix))).otherwise(x), many)


def default(value: Column, other: Column, many: bool = False) -> Column:
    return each(value, lambda x: F.coalesce(x, other), many)


def choice(test: Column, kind: T.DataType, yes: Column, no: Column) -> Column:
    return F.when(truthy(test, kind), yes).otherwise(no)


def total(values: Column) -> Column:
    """Sum of a list: null for an empty list or if an element is null."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")))


def product(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(1.0), lambda a, x: a * x.cast("double")))


def average(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def slice_of(values: Column, start: int, end: int | None = None) -> Column:
    """Elements from ``start`` (0-based) to ``end`` (exclusive, or to the last); negative places count from the end."""
    n = F.size(values)
    place = lambda i: F.greatest(n + i, F.lit(0)) if i < 0 else F.least(F.lit(i), n)
    first, stop = place(start), n if end is None else place(end)
    return F.slice(values, first + 1, F.greatest(stop - first, F.lit(0)))


def find(values: Column, test: Callable[[Column], Column], place: bool = False) -> Column:
    """The first element that meets the test, or its place (-1 if there is none)."""
    places = F.transform(values, lambda x, i: F.when(F.coalesce(test(x), F.lit(False)), i))
    first = F.get(F.array_compact(places), F.lit(0))
    return F.coalesce(first, F.lit(-1)) if place else F.get(values, first)


def distinct_by(values: Column, key: Callable[[Column], Column]) -> Column:
    """The first element of each key, in order."""
    keys = F.transform(values, key)
    return F.filter(values, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def by_key(values: Column, key: Callable[[Column], Column], largest: bool = False) -> Column:
    """Element of least (or greatest) key; the first of several."""
    keys = F.transform(values, lambda x, i: F.struct(key(x).alias("k"), (-i if largest else i).alias("i")))
    best = F.array_max(keys) if largest else F.array_min(keys)
    return F.get(values, F.abs(best["i"]))


def all_of(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.forall(values, lambda x: F.coalesce(test(x), F.lit(False)))


def any_of(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.exists(values, lambda x: F.coalesce(test(x), F.lit(False)))


def join(values: Column, separator: str = ", ") -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), separator)


def extract(holder: Column, keys: list[str], kind: T.DataType) -> Column:
    """Object with the given keys; absent keys are left out."""
    if isinstance(kind, T.MapType):
        return F.map_filter(holder, lambda k, v: k.isin(keys))
    present = [k for k in keys if k in kind.names]
    return F.struct(*(holder[k].alias(k) for k in present)) if present else F.lit(None)


def cycle(values: list[str], value: Column, start_with_null: bool = False) -> Column:
    """Next option of an ordered list; an unknown or last value goes to the first option (or to null first)."""
    options = F.array(*([F.lit(None).cast("string")] if start_with_null else []), *map(F.lit, values))
    n = len(values) + start_with_null
    at = F.coalesce(F.nullif(F.array_position(options, value), F.lit(0)), F.lit(1 if start_with_null else n))
    return F.get(options, (at % n).cast("int"))


def title_case(value: Column) -> Column:
    """First letters in capitals, small words in lower case unless first or last."""
    small = ["a", "an", "and", "as", "at", "but", "by", "for", "in", "nor", "of", "on", "or", "the", "to", "up"]
    words = F.split(F.lower(value), " ")
    n = F.size(words)
    return F.array_join(F.transform(words, lambda w, i: F.when(w.isin(small) & (i > 0) & (i < n - 1), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 2**31 - 1)))), " ")


def link(path: Column, display: Column | None = None, embed: bool = False, kind: str = "file", subpath: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(path.alias("path"), (none if display is None else display).alias("display"), (none if subpath is None else subpath).alias("subpath"), F.lit(kind).alias("type"), F.lit(embed).alias("embed"))


def link_text(value: Column) -> Column:
    """Markdown of a link."""
    target = F.concat(value["path"], F.coalesce(F.concat(F.lit("#"), value["subpath"]), F.lit("")))
    shown = F.coalesce(F.concat(F.lit("|"), value["display"]), F.lit(""))
    return F.concat(F.when(value["embed"], "!").otherwise(""), F.lit("[["), target, shown, F.lit("]]"))


def external_link(url: Column, display: Column | None = None) -> Column:
    return F.concat(F.lit("["), url if display is None else display, F.lit("]("), url, F.lit(")"))
