"""Aggregates out of the list expressions over ``rows`` that stand behind ``GROUP BY``.

``rows``, ``rows.x``, ``filter(…)``, ``map(…)`` and ``nonnull(…)`` of these describe a stream: what each row gives (an expression over the row's own fields) and which rows
count (tests). A function that takes such a stream to one value becomes one aggregate over the rows before they are grouped, so Spark adds up parts of groups before the shuffle and
no group is gathered. Results are those of the list form: lists of rows are in the order of all their fields, which settles ties of ``minby`` and ``maxby``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions import dynamic, durations, values

FOLDS = ("length", "sum", "average", "product", "min", "max", "minby", "maxby", "any", "some", "all", "every", "none")


@dataclass(frozen=True)
class Stream:
    element: Any
    tests: tuple = ()


@dataclass(frozen=True)
class Fold:
    """One aggregate: a function over a stream, with the key of minby and maxby or the test of any and all as a node."""

    name: str
    stream: Stream
    by: Any = None

    def nodes(self) -> list[Any]:
        return [n for n in (self.stream.element, *self.stream.tests, self.by) if n is not None]


def stream_of(node: Any, make) -> Stream | None:
    """The stream that a list expression describes; None for others. ``make`` builds a node."""
    if node.kind == "name":
        return Stream(make("row")) if node.value == "rows" else None
    if node.kind == "field":
        inner = stream_of(node.args[0], make)
        return inner and Stream(pick(inner.element, node.value, make), inner.tests)
    if node.kind != "call" or not node.args:
        return None
    if node.value in ("filter", "map") and len(node.args) == 2 and node.args[1].kind == "lambda":
        inner = stream_of(node.args[0], make)
        body = inner and applied(node.args[1], inner.element, make)
        if body is None:
            return None
        return Stream(body, inner.tests) if node.value == "map" else Stream(inner.element, (*inner.tests, body))
    if node.value == "nonnull" and len(node.args) == 1:
        inner = stream_of(node.args[0], make)
        return inner and Stream(inner.element, (*inner.tests, make("compare", "!=", [inner.element, make("literal", None)])))
    return None


def pick(element: Any, name: str, make) -> Any:
    """A field of what a row gives; of the row itself, its column."""
    return make("name", name) if element.kind == "row" else make("field", name, [element])


def applied(function: Any, element: Any, make) -> Any:
    """The body of a lambda with its first name replaced; None if a lambda inside would catch a name of the element."""
    name, *others = function.value
    free = {n.value for n in walk(element) if n.kind == "name"}

    def replace(node: Any) -> Any:
        if not hasattr(node, "args"):
            return node
        if node.kind == "name" and node.value == name:
            return element
        if node.kind == "lambda":
            if set(node.value) & free:
                raise LookupError
            if name in node.value:
                return node
        args = [replace(a) for a in node.args]
        if node.kind == "field" and args[0].kind == "row":
            return make("name", node.value)
        return make(node.kind, node.value, args)

    if others:
        return None
    try:
        return replace(function.args[0])
    except LookupError:
        return None


def walk(node: Any):
    if hasattr(node, "args"):
        yield node
        for a in node.args:
            yield from walk(a)


def bare(node: Any) -> bool:
    """Whether the whole row is used, not only its fields."""
    return any(n.kind == "row" for n in walk(node))


def fold_of(node: Any, make) -> Fold | None:
    """The aggregate that a node stands for, if it is one."""
    if node.kind == "field":  # a field of the element that minby or maxby finds
        inner = fold_of(node.args[0], make)
        if inner and inner.name in ("minby", "maxby"):
            return Fold(inner.name, Stream(pick(inner.stream.element, node.value, make), inner.stream.tests), inner.by)
        return None
    if node.kind != "call" or not node.args:
        return None
    if node.value == "length" and len(node.args) == 1:
        inner = node.args[0]
        if inner.kind == "call" and inner.value in ("unique", "distinct") and len(inner.args) == 1:
            found = stream_of(inner.args[0], make)
            return found and not bare(found.element) and all_plain(found) and Fold("distinct", found) or None
    if node.value not in FOLDS:
        return None
    found = stream_of(node.args[0], make)
    if found is None or not all_plain(found):
        return None
    if node.value in ("minby", "maxby", "any", "some", "all", "every", "none"):
        if len(node.args) == 1 and node.value not in ("minby", "maxby"):
            return None if bare(found.element) else Fold(node.value, found, found.element)
        by = applied(node.args[1], found.element, make) if len(node.args) == 2 and node.args[1].kind == "lambda" else None
        return Fold(node.value, found, by) if by is not None and not bare(by) else None
    if len(node.args) != 1 or (node.value != "length" and bare(found.element)):
        return None
    return Fold(node.value, found)


def all_plain(stream: Stream) -> bool:
    return not any(map(bare, stream.tests))


def folds_in(nodes: list[Any], make) -> tuple[dict[str, Fold], bool]:
    """The aggregates in some expressions by the text of their nodes, and whether ``rows`` is used in any other way."""
    found: dict[str, Fold] = {}
    other = False

    def scan(node: Any) -> None:
        nonlocal other
        if not hasattr(node, "args"):
            return
        if fold := fold_of(node, make):
            if not (node.kind == "call" and fold.name in ("minby", "maxby") and bare(fold.stream.element)):
                found[repr(node)] = fold
                return
        if node.kind == "name" and node.value == "rows":
            other = True
        for a in node.args:
            scan(a)

    for node in nodes:
        scan(node)
    return found, other


# ---- compiling ----


def aggregate(compiler: Any, fold: Fold) -> Column:
    """The aggregate as a column over the rows before they are grouped."""
    tests = [compiler.true(t) for t in fold.stream.tests]
    counted = F.lit(True)
    for t in tests:
        counted = counted & t
    counted = compiler.hold(counted) if tests else counted
    only = (lambda c: F.when(counted, c)) if tests else (lambda c: c)
    n = F.count_if(counted) if tests else F.count(F.lit(1))
    if fold.name == "length":
        return n.cast("int")
    if fold.name in ("any", "some", "all", "every", "none"):
        test = compiler.hold(compiler.true(fold.by))
        if fold.name in ("all", "every"):
            return F.coalesce(F.bool_and(only(test)), F.lit(True))
        some = F.coalesce(F.bool_or(only(test)), F.lit(False))
        return ~some if fold.name == "none" else some
    value, kind = compiler.typed(fold.stream.element)
    one = dynamic.is_value(kind)
    if fold.name == "distinct":
        plain = compiler.hold(dynamic.same_key(value)) if one else value
        absent = F.lit(False) if one else value.isNull()
        return (F.count_distinct(only(plain)) + F.coalesce(F.max(only(absent.cast("int"))), F.lit(0))).cast("int")
    if fold.name in ("minby", "maxby"):
        key, key_kind = compiler.typed(fold.by)
        rows = row_order(compiler.df)
        least = compiler.hold((order if fold.name == "minby" else falling)(key, key_kind))
        return F.min_by(value, only(F.struct(least.alias("k"), rows.alias("row"))))
    if fold.name in ("min", "max"):
        if one or values.type_name(kind) == "duration":
            key = compiler.hold(dynamic.key(value)) if one else durations.length(value)
            set_ = value["kind"] != "null" if one else value.isNotNull()
            found = (F.min_by if fold.name == "min" else F.max_by)(value, F.when(counted & set_, key))
            return F.coalesce(found, dynamic.null()) if one else found
        return (F.min if fold.name == "min" else F.max)(only(value))
    if one:
        return fold_values(fold.name, compiler.hold(value), only, n)
    if values.type_name(kind) == "duration":
        if fold.name == "product":
            raise ValueError("product is not defined for durations")
        whole = F.when((n > 0) & (F.count(only(value)) == n), durations.summed(only(value)))
        return whole if fold.name == "sum" else durations.times(whole, F.try_divide(F.lit(1.0), n))
    number = only(value.cast("double"))
    add = {"sum": F.sum, "average": F.avg, "product": F.product}[fold.name](number)
    return F.when((n > 0) & (F.count(number) == n), add)


def fold_values(name: str, value: Column, only, n: Column) -> Column:
    """Sum, average or product where each row's type is its own: of numbers, or of durations; null for a mixture."""
    every = lambda kind: (n > 0) & (F.count_if(F.coalesce(only(value["kind"] == kind), F.lit(False))) == n)
    add = {"sum": F.sum, "average": F.avg, "product": F.product}[name](only(value["number"]))
    found = F.when(every("number"), dynamic.make("number", number=add))
    if name != "product":
        whole = F.struct(F.sum(only(value["months"])).cast("int").alias("months"), F.sum(only(value["micros"])).alias("micros"))
        whole = durations.times(whole, F.try_divide(F.lit(1.0), n)) if name == "average" else whole
        found = found.when(every("duration"), dynamic.make("duration", months=whole["months"], micros=whole["micros"]))
    return found.otherwise(dynamic.null())


def orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind)
    return not isinstance(kind, (T.VariantType, T.MapType))


def row_order(df: DataFrame) -> Column:
    """All fields of a row that can be compared, in order."""
    return F.struct(*(F.col(f"`{f.name}`") for f in df.schema if orderable(f.dataType)))


def order(key: Column, kind: T.DataType) -> Column:
    """What least keys are found by; null comes first, as in a list."""
    if dynamic.is_value(kind):
        return F.when(key["kind"] != "null", dynamic.key(key))
    return durations.length(key) if values.type_name(kind) == "duration" else key


def falling(key: Column, kind: T.DataType) -> Column:
    """Something whose least is the greatest key; null comes last."""
    name = values.type_name(kind)
    if dynamic.is_value(kind):
        inverse = lambda k: F.struct((-k["rank"]).alias("rank"), (-k["number"]).alias("number"), turned(k["text"]).alias("text"))
        last = F.struct(F.lit(127).cast("tinyint").alias("rank"), F.lit(0.0).alias("number"), F.lit("").alias("text"))
        found = dynamic.bind(dynamic.key(key), lambda k: F.struct(inverse(k).alias("own"), F.concat(F.transform(k["items"], inverse), F.array(last)).alias("items")))
        return F.struct((key["kind"] == "null").alias("unset"), found.alias("k"))
    if name == "duration":
        found = -durations.length(key)
    elif name == "number":
        found = -key
    elif name == "boolean":
        found = ~key
    elif name == "date":
        found = -F.unix_micros(key.cast("timestamp"))
    else:
        found = turned(key.cast("string"))
    return F.struct(key.isNull().alias("unset"), found.alias("k"))


def turned(text: Column) -> Column:
    """Texts in the opposite order: each half byte turned, and an end above all of them."""
    return F.concat(F.translate(F.hex(text), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
