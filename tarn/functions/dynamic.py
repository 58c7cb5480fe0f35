"""Values whose type is known row by row, as in the headers of notes, and one order over values of all types.

A *value* is a struct with the name of its type (``kind``) and the parts that this type uses: a number (also true and false as 1 and 0), a text, a moment, months and
micros of a duration, or the raw VARIANT of lists and objects. Texts that have the form of a date, a duration or a link are values of these types.

The *key* of a value orders values of any types: first by type (null, then array, boolean, date, duration, link, number, object, string), then within it: numbers, moments
and durations by size, texts without regard to case and then by code points, lists element by element, objects and lists inside lists by their JSON. Comparisons, ``SORT``, ``sort``, ``min``,
``max`` and groups all use it. Everything here is a native expression.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions import dates, durations, values

try:  # keeps a lambda for reuse; without it each use is built anew
    from pyspark.sql.functions.builtin import _create_lambda
except ImportError:
    _create_lambda = None

FIELDS = {"kind": T.StringType(), "number": T.DoubleType(), "text": T.StringType(), "moment": T.TimestampType(), "months": T.IntegerType(), "micros": T.LongType(), "raw": T.VariantType()}
VALUE = T.StructType([T.StructField(n, t) for n, t in FIELDS.items()])
LIST = T.ArrayType(VALUE)
#: Types in their order.
KINDS = ("null", "array", "boolean", "date", "duration", "link", "number", "object", "string")
WIKI_LINK = r"^!?\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|([^\]]*))?\]\]$"


def is_value(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.names == list(FIELDS)


def is_list(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and is_value(kind.elementType)


_lambdas: dict[tuple, tuple[Column, Column]] = {}


def bind(value: Column, function: Callable[[Column], Column], *name: object) -> Column:
    """``function(value)`` with the value computed once, however often the function names it: the last step of a sum over no elements, which, unlike a list of one, is neither
    copied nor asked for its type in each row. A function that uses nothing but its argument may give itself a name, and is then put together once for a Spark application;
    large expressions take some time to build."""
    if not name or _create_lambda is None:
        return F.aggregate(F.array(), value, lambda v, _: v, function)
    key = (SparkContext._active_spark_context and SparkContext._active_spark_context.applicationId, *name)
    if key not in _lambdas:
        _lambdas[key] = (Column(_create_lambda(lambda v, _: v)), Column(_create_lambda(function)))
    return F.call_function("aggregate", F.array(), value, *_lambdas[key])


def once(function: Callable[..., Column]) -> Callable[..., Column]:
    """The function with its first column computed once; without this, nested calls would repeat their arguments over and over."""

    @functools.wraps(function)
    def wrapped(value: Column, *args) -> Column:
        plain = all(isinstance(a, (str, int, T.DataType)) for a in args)
        return bind(value, lambda v: function(v, *args), *((function.__name__, *map(repr, args)) if plain else ()))

    return wrapped


def pairwise(function: Callable[..., Column]) -> Callable[..., Column]:
    """The same for functions of two columns."""

    @functools.wraps(function)
    def wrapped(left: Column, right: Column, *args) -> Column:
        return bind(F.struct(left.alias("l"), right.alias("r")), lambda p: function(p["l"], p["r"], *args), function.__name__, *map(repr, args))

    return wrapped


def make(kind: Column | str, **parts: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(*((kind if n == "kind" else parts.get(n, F.lit(None))).cast(t).alias(n) for n, t in FIELDS.items()))


def null() -> Column:
    return make("null")


# ---- from VARIANT and back ----


def of_variant(raw: Column) -> Column:
    """The value of a VARIANT; absent ones are null."""

    def shaped(s: Column) -> Column:
        raw, shape = s["raw"], s["shape"]
        number = shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL")
        return (
            F.when(shape.isNull() | (shape == "VOID"), null())
            .when(shape == "STRING", bind(F.try_variant_get(raw, "$", "string"), of_text))
            .when(number, make("number", number=F.try_variant_get(raw, "$", "double")))
            .when(shape == "BOOLEAN", make("boolean", number=F.try_variant_get(raw, "$", "boolean").cast("double")))
            .when(shape.startswith("ARRAY"), make("array", raw=raw))
            .when(shape.startswith("OBJECT"), make("object", raw=raw))
            .when(shape.startswith("DATE") | shape.startswith("TIMESTAMP"), make("date", moment=F.try_variant_get(raw, "$", "timestamp")))
            .otherwise(bind(raw.cast("string"), lambda t: make("string", text=t)))
        )

    return bind(raw, lambda v: bind(F.struct(v.alias("raw"), F.schema_of_variant(v).alias("shape")), shaped), "of_variant")


@once
def of_text(text: Column) -> Column:
    """A text by its form. Only texts that begin like a date, a duration or a link are looked at further."""
    dated = lambda p: F.when(p["moment"].isNotNull(), make("date", moment=p["moment"])).when(
        p["length"].isNotNull(), make("duration", months=p["length"]["months"], micros=p["length"]["micros"])
    ).otherwise(make("string", text=p["text"]))
    shown = F.nullif(F.regexp_extract(text, WIKI_LINK, 2), F.lit(""))
    linked = F.when(F.regexp_like(text, F.lit(WIKI_LINK)), make("link", text=F.regexp_extract(text, WIKI_LINK, 1), raw=shown.cast("variant"))).otherwise(make("string", text=text))
    numbered = bind(F.struct(text.alias("text"), dates.date(text).alias("moment"), durations.duration(text).alias("length")), dated)
    return F.when(F.ltrim(text).substr(1, 1).between("0", "9"), numbered).when(text.startswith("[[") | text.startswith("![["), linked).otherwise(make("string", text=text))


@once
def of(column: Column, kind: T.DataType) -> Column:
    """The value of a column of any one type."""
    if is_value(kind):
        return F.when(column.isNull(), null()).otherwise(column)
    name = values.type_name(kind)
    if isinstance(kind, T.VariantType):
        return of_variant(column)
    if name == "null":
        return null()
    if name in ("number", "boolean"):
        found = make(name, number=column.cast("double"))
    elif name == "string":
        found = make(name, text=column)
    elif name == "date":
        found = make(name, moment=column)
    elif name == "duration":
        found = make(name, months=column["months"], micros=column["micros"])
    elif name == "link":
        found = make(name, text=column["path"], raw=column["display"].cast("variant"))
    elif name == "array":
        found = make(name, raw=as_variant(column, kind))
    else:
        found = make("object", raw=as_variant(column, kind))
    return F.when(column.isNull(), null()).otherwise(found)


@once
def as_variant(column: Column, kind: T.DataType) -> Column:
    """VARIANT of a column; dates, durations and links inside are texts that are read as such again."""
    if isinstance(kind, T.VariantType):
        return column
    if is_value(kind):
        written = F.when(column["kind"] == "boolean", (column["number"] != 0).cast("variant")).when(column["kind"] == "number", column["number"].cast("variant"))
        return written.when(column["kind"].isin("array", "object"), column["raw"]).when(column["kind"] != "null", text(column).cast("variant"))
    name = values.type_name(kind)
    if name == "array":
        return F.transform(column, lambda x: as_variant(x, kind.elementType)).cast("variant")
    if isinstance(kind, T.MapType):
        return F.to_variant_object(F.transform_values(column, lambda _, v: as_variant(v, kind.valueType)))
    if name in ("link", "duration", "date"):
        return text(of(column, kind)).cast("variant")
    if isinstance(kind, T.StructType):
        return F.to_variant_object(F.struct(*(as_variant(column[f.name], f.dataType).alias(f.name) for f in kind)))
    return column.cast("variant")


# ---- parts ----


@once
def items(value: Column) -> Column:
    """The elements of a list as values; one value is a list of itself, null an empty list."""
    many = F.transform(F.try_variant_get(value["raw"], "$", "array<variant>"), of_variant)
    one = F.when(value["kind"] == "null", F.array().cast(LIST)).otherwise(F.array(value))
    return F.coalesce(F.when(value["kind"] == "array", many), one)


@once
def field(value: Column, name: str) -> Column:
    """A field of an object, a part of a date or a duration, or the field of every object in a list."""
    quoted = name.replace("\\", "\\\\").replace('"', '\\"')
    inside = lambda raw: of_variant(F.try_variant_get(raw, f'$["{quoted}"]', "variant"))
    found = F.when(value["kind"] == "object", inside(value["raw"]))
    swizzled = F.transform(F.try_variant_get(value["raw"], "$", "array<variant>"), lambda x: F.try_variant_get(x, f'$["{quoted}"]', "variant"))
    found = found.when(value["kind"] == "array", make("array", raw=swizzled.cast("variant")))
    if name in dates.PARTS or name in ("weekday", "second", "millisecond"):
        found = found.when(value["kind"] == "date", make("number", number=dates.part(value["moment"], name)))
    if name in durations.PARTS:
        found = found.when(value["kind"] == "duration", make("number", number=durations.part(duration(value), name)))
    return found.otherwise(null())


@pairwise
def at(value: Column, place: Column) -> Column:
    """Element of a list by its place from 0 or of an object by its name; ``place`` is a value."""
    element = F.get(F.try_variant_get(value["raw"], "$", "array<variant>"), place["number"].cast("int"))
    member = F.try_element_at(F.try_variant_get(value["raw"], "$", "map<string,variant>"), place["text"])
    listed = (value["kind"] == "array") & (place["kind"] == "number") & (place["number"] >= 0)
    return F.when(listed, of_variant(element)).when((value["kind"] == "object") & (place["kind"] == "string"), of_variant(member)).otherwise(null())


def duration(value: Column) -> Column:
    return F.when(value["kind"] == "duration", F.struct(value["months"].alias("months"), value["micros"].alias("micros")))


def moment(value: Column) -> Column:
    return F.when(value["kind"] == "date", value["moment"])


@once
def number_text(number: Column) -> Column:
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, F.when(whole, number).cast("bigint").cast("string")).otherwise(number.cast("string"))


@once
def moment_text(moment: Column) -> Column:
    midnight = F.date_trunc("day", moment) == moment
    return F.when(midnight, F.date_format(moment, "yyyy-MM-dd")).otherwise(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"))


@once
def scalar_text(value: Column) -> Column:
    link = F.concat(F.lit("[["), value["text"], F.coalesce(F.concat(F.lit("|"), F.try_variant_get(value["raw"], "$", "string")), F.lit("")), F.lit("]]"))
    return (
        F.when(value["kind"] == "string", value["text"])
        .when(value["kind"] == "number", number_text(value["number"]))
        .when(value["kind"] == "boolean", (value["number"] != 0).cast("string"))
        .when(value["kind"] == "date", moment_text(value["moment"]))
        .when(value["kind"] == "duration", durations.text(duration(value)))
        .when(value["kind"] == "link", link)
        .when(value["kind"].isin("array", "object"), F.to_json(value["raw"]))
    )


@once
def text(value: Column) -> Column:
    """A value as it is shown: lists by commas, objects and lists in lists as JSON; null for null."""
    shown = F.array_join(F.transform(items(value), scalar_text), ", ", "-")
    return F.when(value["kind"] == "array", shown).otherwise(scalar_text(value))


@once
def string(value: Column) -> Column:
    """The text of a text or the target of a link; null for other types."""
    return F.when(value["kind"].isin("string", "link"), value["text"])


@once
def truthy(value: Column) -> Column:
    kind = value["kind"]
    empty = F.to_json(value["raw"]).isin("[]", "{}")
    test = F.when(kind.isin("boolean", "number"), value["number"] != 0).when(kind == "string", value["text"] != "").when(kind.isin("array", "object"), ~empty).otherwise(kind != "null")
    return F.coalesce(test, F.lit(False))


@once
def length(value: Column) -> Column:
    """Elements of a list, names of an object, characters of a text; 0 for null and null for others."""
    kind = value["kind"]
    names = F.size(F.try_variant_get(value["raw"], "$", "map<string,variant>"))
    return F.when(kind == "array", F.size(items(value))).when(kind == "object", names).when(kind == "string", F.length(value["text"])).when(kind == "null", F.lit(0))


# ---- order ----


def rank(kind: Column) -> Column:
    places = ", ".join(f"'{k}', {i}Y" for i, k in enumerate(KINDS))
    return F.try_element_at(F.expr(f"map({places})"), kind)


def folded(text: Column) -> Column:
    return F.concat(F.lower(text), F.lit("\0"), text)


@once
def scalar_key(value: Column) -> Column:
    number = F.coalesce(value["number"], F.unix_micros(value["moment"]).cast("double"), durations.length(duration(value)).cast("double"))
    deep = F.when(value["kind"].isin("array", "object"), F.to_json(value["raw"]))
    # -0.0 equals 0.0, and no number is above another for its sign bit alone
    return F.struct(rank(value["kind"]).alias("rank"), (number + 0.0).alias("number"), F.coalesce(folded(value["text"]), deep).alias("text"))


@once
def key(value: Column) -> Column:
    """The key of a value, as a struct that Spark can compare, sort and group by."""

    listed = value["kind"] == "array"
    inner = F.when(listed, F.transform(items(value), scalar_key))
    return bind(scalar_key(value), lambda k: F.struct(k["rank"].alias("rank"), k["number"].alias("number"), F.when(~listed, k["text"]).alias("text"), inner.alias("items")))


@once
def same_key(value: Column) -> Column:
    """The same for values of one key and different for others, without an order. Numbers are texts, as Spark would normalise doubles anew wherever it groups by them."""
    plain = lambda k: F.struct(k["rank"].alias("rank"), k["number"].cast("string").alias("number"), k["text"].alias("text"))
    return bind(key(value), lambda k: F.struct(*(plain(k)[n].alias(n) for n in ("rank", "number", "text")), F.transform(k["items"], plain).alias("items")))


def key_of(column: Column, kind: T.DataType) -> Column:
    return key(of(column, kind))


def compare(op: str, left: Column, right: Column) -> Column:
    """Comparison of two keys."""
    return {"=": left.eqNullSafe(right), "!=": ~left.eqNullSafe(right), "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def sorted_by(column: Column, key: Callable[[Column], Column], falling: bool = False) -> Column:
    """A list in the order of its elements' keys; elements of one key keep their order either way."""
    known = lambda k: F.struct(k.isNotNull().alias("known"), k.alias("k"))  # null below everything
    keyed = F.transform(column, lambda x, i: F.struct(bind(key(x), known).alias("k"), i.alias("i")))
    if falling:
        order = F.array_sort(keyed, lambda a, b: F.when(a["k"] > b["k"], -1).when(a["k"] < b["k"], 1).otherwise(a["i"] - b["i"]))
    else:
        order = F.array_sort(keyed)
    return F.transform(order, lambda s: F.get(column, s["i"]))


def extreme(column: Column, key: Callable[[Column], Column], largest: bool = False) -> Column:
    """The element of least or greatest key; the first of several, null for an empty list."""
    return values.by_key(column, key, largest)


# ---- arithmetic ----


@pairwise
def add(left: Column, right: Column, sign: int = 1) -> Column:
    """Sum or difference by the types of both sides; null where there is none. A text on one side of a sum joins the texts of both."""
    kinds = lambda a, b: (left["kind"] == a) & (right["kind"] == b)
    moved = lambda m, d, s: make("date", moment=durations.plus(m["moment"], duration(d), s))
    long = lambda c: c.cast("bigint")
    spans = make("duration", months=left["months"] + sign * right["months"], micros=left["micros"] + sign * right["micros"])
    found = F.when(kinds("number", "number"), make("number", number=left["number"] + sign * right["number"])).when(kinds("duration", "duration"), spans)
    found = found.when(kinds("date", "duration"), moved(left, right, sign))
    if sign > 0:
        either = (left["kind"] == "string") | (right["kind"] == "string")
        joined = F.concat(F.coalesce(text(left), F.lit("")), F.coalesce(text(right), F.lit("")))
        found = found.when(kinds("duration", "date"), moved(right, left, 1)).when(either, make("string", text=joined))
    else:
        between = long(F.unix_micros(left["moment"])) - long(F.unix_micros(right["moment"]))
        found = found.when(kinds("date", "date"), make("duration", months=F.lit(0), micros=between))
    return found.otherwise(null())


def scale(op: str, left: Column, right: Column) -> Column:
    """Product, quotient or rest: of numbers, of a duration and a number, of a text and a number (repeated)."""
    return scaled(left, right, op)


@pairwise
def scaled(left: Column, right: Column, op: str) -> Column:
    kinds = lambda a, b: (left["kind"] == a) & (right["kind"] == b)
    of_numbers = {"*": left["number"] * right["number"], "/": F.try_divide(left["number"], right["number"]), "%": left["number"] % F.nullif(right["number"], F.lit(0.0))}[op]
    found = F.when(kinds("number", "number"), make("number", number=of_numbers))
    times = lambda d, n: F.struct(F.lit("duration").alias("kind"), durations.times(duration(d), n).alias("d"))
    spread = lambda s: make("duration", months=s["d"]["months"], micros=s["d"]["micros"])
    if op == "*":
        found = found.when(kinds("duration", "number"), bind(times(left, right["number"]), spread)).when(kinds("number", "duration"), bind(times(right, left["number"]), spread))
        found = found.when(kinds("string", "number"), make("string", text=F.repeat(left["text"], right["number"].cast("int"))))
    if op == "/":
        found = found.when(kinds("duration", "number") & (right["number"] != 0), bind(times(left, F.try_divide(F.lit(1.0), right["number"])), spread))
    return bind(found.otherwise(null()), lambda v: F.when((v["kind"] == "number") & v["number"].isNull(), null()).otherwise(v))


@once
def total(column: Column) -> Column:
    """Sum of a list of values: of numbers, or of durations part by part; null for an empty list or other types."""

    every = lambda kind: (F.size(column) > 0) & F.forall(column, lambda x: x["kind"] == kind)
    numbers = F.aggregate(column, F.lit(0.0), lambda a, x: a + x["number"])
    months = F.aggregate(column, F.lit(0), lambda a, x: a + x["months"])
    micros = F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + x["micros"])
    return F.when(every("number"), make("number", number=numbers)).when(every("duration"), make("duration", months=months, micros=micros)).otherwise(null())


@once
def average(column: Column) -> Column:
    return scale("/", total(column), make("number", number=F.size(column)))


@once
def product(column: Column) -> Column:
    every = (F.size(column) > 0) & F.forall(column, lambda x: x["kind"] == "number")
    return F.when(every, make("number", number=F.aggregate(column, F.lit(1.0), lambda a, x: a * x["number"]))).otherwise(null())


@once
def each(value: Column, function: Callable[[Column], Column]) -> Column:
    """A function of one value; over a list it goes element by element."""
    listed = as_variant(F.transform(items(value), function), LIST)
    return F.when(value["kind"] == "array", make("array", raw=listed)).otherwise(function(value))
