"""The note query language: text in, DataFrame out.

``TABLE a, b AS "B" FROM #tag and "folder" WHERE x SORT y DESC GROUP BY k FLATTEN list AS item LIMIT 5``. Commands run in the order in which they
are written; each becomes one DataFrame step, and Catalyst plans the whole. After ``GROUP BY`` a row has the key and ``rows``; if everything
behind it only uses ``length(rows)``, ``sum(rows.x)`` and the like, the plan aggregates directly and never gathers the rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions import dates, durations, dynamic, paths, values
from tarn.operators import commands, links, tasks
from tarn.plans import groups


class QueryError(ValueError):
    """A query that can't be read or compiled."""


# ---- reading ----

TOKEN = re.compile(
    r"""\s+|(?P<comment>//[^\n]*)|(?P<number>\d+(?:\.\d+)?)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<link>\[\[[^\]]*\]\])|(?P<tag>\#[\w/\-]+)"""
    r"""|(?P<word>[^\W\d][\w\-]*)|(?P<op><=|>=|!=|=>|[=<>+\-*/%(),.\[\]!&|{}:])""",
    re.UNICODE | re.VERBOSE,
)
COMMANDS = ("FROM", "WHERE", "SORT", "GROUP", "FLATTEN", "LIMIT")
#: What may stand between the brackets of ``date`` and ``dur`` without quotes.
BARE = {
    "date": re.compile(r"\d{4}-\d{2}(?:-\d{2}(?:T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?)?"),
    "dur": re.compile(r"\d+(?:\.\d+)?\s*[A-Za-z]+(?:\s*,?\s*\d+(?:\.\d+)?\s*[A-Za-z]+)*"),
}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int = 0
    end: int = 0


def tokens_of(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected character at {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup and m.lastgroup != "comment":
            out.append(Token(m.lastgroup, m[0], m.start(), m.end()))
    return out


@dataclass
class Node:
    """An expression: kind and parts."""

    kind: str
    value: Any = None
    args: list[Any] = field(default_factory=list)


@dataclass
class Query:
    form: str
    columns: list[tuple[Node, str | None]]
    with_id: bool
    commands: list[tuple[str, Any]]

    def expressions(self) -> list[Node]:
        return [n for n, _ in self.columns] + [n for w, p in self.commands for n in nodes_of(w, p)]


class Reader:
    def __init__(self, text: str):
        self.text = text
        self.tokens = tokens_of(text)
        self.at = 0

    def peek(self, *texts: str, ahead: int = 0) -> bool:
        t = self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else None
        return t is not None and t.kind in ("word", "op") and t.text.upper() in texts

    def take(self, *texts: str) -> bool:
        if self.peek(*texts):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise QueryError(f"expected {text} at {self.rest()}")

    def rest(self) -> str:
        return " ".join(t.text for t in self.tokens[self.at : self.at + 4]) or "the end"

    def next(self) -> Token:
        if self.at >= len(self.tokens):
            raise QueryError("unexpected end of query")
        self.at += 1
        return self.tokens[self.at - 1]

    # expressions, loosest first

    def expression(self) -> Node:
        left = self.conjunction()
        while self.peek("OR", "|"):
            self.at += 1
            left = Node("or", args=[left, self.conjunction()])
        return left

    def conjunction(self) -> Node:
        left = self.comparison()
        while self.peek("AND", "&"):
            self.at += 1
            left = Node("and", args=[left, self.comparison()])
        return left

    def comparison(self) -> Node:
        left = self.sum()
        while self.peek("=", "!=", "<", ">", "<=", ">="):
            left = Node("compare", self.next().text, [left, self.sum()])
        return left

    def sum(self) -> Node:
        left = self.term()
        while self.peek("+", "-"):
            left = Node("arithmetic", self.next().text, [left, self.term()])
        return left

    def term(self) -> Node:
        left = self.unary()
        while self.peek("*", "/", "%"):
            left = Node("arithmetic", self.next().text, [left, self.unary()])
        return left

    def unary(self) -> Node:
        if self.take("!"):
            return Node("not", args=[self.unary()])
        if self.take("-"):
            return Node("arithmetic", "-", [Node("literal", 0), self.unary()])
        return self.postfix()

    def postfix(self) -> Node:
        node = self.atom()
        while True:
            if self.take("."):
                node = Node("field", self.next().text, [node])
            elif self.take("["):
                node = Node("index", args=[node, self.expression()])
                self.need("]")
            elif self.peek("(") and node.kind == "name":
                if bare := self.bare(node.value.lower()):
                    node = bare
                    continue
                self.at += 1
                node = Node("call", node.value.lower(), self.arguments(")"))
            else:
                return node

    def bare(self, name: str) -> Node | None:
        """``date(2024-01-31)`` and ``dur(1 day, 2 h)``: a literal without quotes in the brackets that follow."""
        close = next((i for i in range(self.at + 1, len(self.tokens)) if self.tokens[i].text in "()"), None)
        if name not in BARE or close is None:
            return None
        inside = self.text[self.tokens[self.at].end : self.tokens[close].start].strip()
        if self.tokens[close].text != ")" or not BARE[name].fullmatch(inside):
            return None
        self.at = close + 1
        return Node("call", name, [Node("literal", inside)])

    def arguments(self, end: str) -> list[Node]:
        out: list[Node] = []
        while not self.take(end):
            if out:
                self.need(",")
            out.append(self.expression())
        return out

    def atom(self) -> Node:
        t = self.next()
        if t.kind == "number":
            return Node("literal", float(t.text) if "." in t.text else int(t.text))
        if t.kind == "string":
            return Node("literal", unescaped(t.text))
        if t.kind == "link":
            target, _, shown = t.text[2:-2].partition("|")
            return Node("link", (target, shown or None))
        if t.kind == "tag":
            return Node("literal", t.text)
        if t.text == "(":
            if lambda_names := self.lambda_head():
                return Node("lambda", lambda_names, [self.expression()])
            inner = self.expression()
            self.need(")")
            return inner
        if t.text == "[":
            return Node("call", "list", self.arguments("]"))
        if t.kind == "word":
            low = t.text.lower()
            if low in ("true", "false"):
                return Node("literal", low == "true")
            if low == "null":
                return Node("literal", None)
            return Node("name", t.text)
        raise QueryError(f"unexpected {t.text!r}")

    def lambda_head(self) -> list[str] | None:
        """Names of ``(a, b) =>`` if that is what follows."""
        names, i = [], self.at
        while i < len(self.tokens) and self.tokens[i].kind == "word":
            names.append(self.tokens[i].text)
            i += 1
            if i < len(self.tokens) and self.tokens[i].text == ",":
                i += 1
        if i + 1 < len(self.tokens) and self.tokens[i].text == ")" and self.tokens[i + 1].text == "=>":
            self.at = i + 2
            return names
        return None

    # sources

    def source(self) -> Node:
        left = self.source_part()
        while self.peek("AND", "OR", "&", "|"):
            word = {"AND": "and", "&": "and"}.get(self.next().text.upper(), "or")
            left = Node(word, args=[left, self.source_part()])
        return left

    def source_part(self) -> Node:
        if self.take("-", "!"):
            return Node("not", args=[self.source_part()])
        if self.take("("):
            inner = self.source()
            self.need(")")
            return inner
        if self.take("OUTGOING"):
            self.need("(")
            target = self.next()
            self.need(")")
            return Node("outgoing", target.text[2:-2])
        t = self.next()
        if t.kind == "tag":
            return Node("tag", t.text)
        if t.kind == "string":
            return Node("folder", t.text[1:-1])
        if t.kind == "link":
            return Node("incoming", t.text[2:-2])
        raise QueryError(f"unknown source {t.text!r}")

    # the query

    def command(self) -> bool:
        """Whether a command follows, not a function of its name (``sort(…)`` without a blank)."""
        after = self.tokens[self.at + 1] if self.at + 1 < len(self.tokens) else None
        return self.peek(*COMMANDS) and not (after and after.text == "(" and after.start == self.tokens[self.at].end)

    def named(self) -> tuple[Node, str | None]:
        start = self.at
        node = self.expression()
        if self.take("AS"):
            t = self.next()
            return node, unescaped(t.text) if t.kind == "string" else t.text
        return node, source_text(self.tokens[start : self.at])

    def query(self) -> Query:
        form = self.next().text.upper()
        if form not in ("TABLE", "LIST", "TASK", "CALENDAR"):
            raise QueryError(f"unknown query type {form}")
        with_id = True
        if self.take("WITHOUT"):
            self.need("ID")
            with_id = False
        columns: list[tuple[Node, str | None]] = []
        while self.at < len(self.tokens) and not self.command():
            if columns:
                self.need(",")
            columns.append(self.named())
        if form in ("LIST", "CALENDAR") and len(columns) > 1:
            raise QueryError(f"{form} takes one expression")
        if form == "CALENDAR" and not columns:
            raise QueryError("CALENDAR needs a date")
        steps: list[tuple[str, Any]] = []
        while self.at < len(self.tokens):
            word = self.next().text.upper()
            if word == "FROM":
                if steps:
                    raise QueryError("FROM comes first")
                steps.append(("from", self.source()))
            elif word == "WHERE":
                steps.append(("where", self.expression()))
            elif word == "SORT":
                keys = []
                while True:
                    node = self.expression()
                    way = "desc" if self.take("DESC", "DESCENDING") else "asc"
                    self.take("ASC", "ASCENDING")
                    keys.append((node, way))
                    if not self.take(","):
                        break
                steps.append(("sort", keys))
            elif word == "GROUP":
                self.need("BY")
                steps.append(("group", self.named()))
            elif word == "FLATTEN":
                steps.append(("flatten", self.named()))
            elif word == "LIMIT":
                steps.append(("limit", int(self.next().text)))
            else:
                raise QueryError(f"unknown command {word}")
        return Query(form, columns, with_id, steps)


def unescaped(text: str) -> str:
    """The content of a quoted text."""
    return re.sub(r'\\(["\\])', r"\1", text[1:-1])


def source_text(tokens: list[Token]) -> str:
    out = ""
    for t in tokens:
        glue = t.text in (".", "(", ")", ",", "[", "]") or out.endswith((".", "(", "[")) or not out
        out += t.text if glue else " " + t.text
    return out


def read(text: str) -> Query:
    return Reader(text).query()


# ---- compiling ----

#: Functions of one value that go over lists element by element.
EACH: dict[str, Callable[[Column], Column]] = {
    "lower": F.lower, "upper": F.upper, "number": values.number, "string": values.text, "floor": F.floor, "ceil": F.ceil, "trunc": lambda c: c.cast("bigint"),
}


class Compiler:
    """Expressions over a DataFrame's columns."""

    def __init__(self, df: DataFrame, clock: Column, this: dict[str, Any], names: dict[str, tuple[Column, T.DataType]] | None = None, look_up: Callable[[str, str], Any] | None = None, blank: DataFrame | None = None):
        self.df, self.clock, self.this, self.names, self.blank = df, clock, this, names or {}, blank
        self.kinds = {f.name: f.dataType for f in df.schema}
        #: Expressions to be computed once a row before rows are grouped; None where nothing may be added to the rows.
        self.held: dict[str, Column] | None = None
        self.look_up = look_up or (lambda target, name: F.lit(None).cast("string"))

    def hold(self, column: Column) -> Column:
        """An expression by name, where a plan would compute it over and over (Spark's sorts do so for each comparison)."""
        if self.held is None:
            return column
        name = f"{HELD}{len(self.held)}"
        self.held[name] = column
        return F.col(name)

    def kind(self, column: Column) -> T.DataType:
        if self.blank is None:  # types are asked of an empty table of this schema, whose plan is small however long the query
            self.blank = self.df.sparkSession.createDataFrame([], self.df.schema)
        return self.blank.select(column.alias("t")).schema[0].dataType

    def inside(self, names: dict[str, tuple[Column, T.DataType]]) -> Compiler:
        """The compiler of a lambda's body."""
        return Compiler(self.df, self.clock, self.this, names, self.look_up, self.blank)

    def typed(self, node: Node) -> tuple[Column, T.DataType]:
        if node.kind == "name" and node.value in self.names:
            return self.names[node.value]
        column = self.compile(node)
        kind = self.known_kind(node) or self.element_kind(node) or self.kind(column)
        return (dynamic.of_variant(column), dynamic.VALUE) if isinstance(kind, T.VariantType) else (column, kind)

    def value(self, node: Node) -> Column:
        """An expression of any type as a value that carries its type."""
        return dynamic.of(*self.typed(node))

    def coerced(self, node: Node, name: str) -> Column:
        """An expression where a function wants one type: that part of a value, other columns as they are."""
        column, kind = self.typed(node)
        return value_part(column, name) if dynamic.is_value(kind) else column

    def known_kind(self, node: Node) -> T.DataType | None:
        """Type of a literal, a column or a function with one type of result, which needs no planning."""
        if node.kind in ("compare", "and", "or", "not") or (node.kind == "call" and node.value in TESTS):
            return T.BooleanType()
        if node.kind == "call" and node.value in ("typeof", "join", "dateformat"):
            return T.StringType()
        if node.kind == "literal":
            return {str: T.StringType(), bool: T.BooleanType(), type(None): T.NullType()}.get(type(node.value))
        path = dotted(node)
        if not path or path[0] in self.names:
            return None
        names = [path[0]] if len(path) == 1 else []
        found = next((n for n in (*names, LINKED + ".".join(path), HEADER + ".".join(path)) if n in self.kinds), None)
        return found and self.kinds[found]

    def element_kind(self, node: Node) -> T.DataType | None:
        """Type of an expression over lambda variables, which can't be selected alone."""
        if not self.names or not mentions(node, set(self.names)):
            return None
        alone = {name: (F.lit(None).cast(kind), kind) for name, (_, kind) in self.names.items()}
        return self.kind(self.inside(alone).plain(node))

    def plain(self, node: Node) -> Column:
        """Compiles with variables that are columns of their own."""
        self.element_kind = lambda _: None  # type: ignore[method-assign]
        return self.compile(node)

    def true(self, node: Node) -> Column:
        if node.kind in ("and", "or", "not"):
            return self.compile(node)
        column, kind = self.typed(node)
        return dynamic.truthy(dynamic.of(column, kind)) if dynamic.is_value(kind) else values.truthy(column, kind)

    def column(self, name: str) -> Column:
        if name in self.names:
            return self.names[name][0]
        found = [c for c in self.df.columns if c == name] or [c for c in self.df.columns if clean(c) == clean(name) or c == HEADER + name]
        return F.col(f"`{found[0]}`") if found else F.lit(None).cast("string")

    def compile(self, node: Node) -> Column:
        k, args = node.kind, node.args
        if k == "literal":
            return F.lit(node.value)
        if k == "name":
            return self.column(node.value)
        if k == "link":
            return values.link(F.lit(node.value[0]), F.lit(node.value[1]).cast("string"))
        if k == "and":
            return self.true(args[0]) & self.true(args[1])
        if k == "or":
            return self.true(args[0]) | self.true(args[1])
        if k == "not":
            return ~self.true(args[0])
        if k == "compare":
            return self.compare(node.value, *args)
        if k == "arithmetic":
            return self.arithmetic(node.value, *args)
        if k == "field":
            return self.field(args[0], node.value)
        if k == "index" and args[0].kind == "name" and args[0].value == "row" and args[1].kind == "literal" and "row" not in self.names:
            return self.column(str(args[1].value))
        if k == "index":
            holder, kind = self.typed(args[0])
            if dynamic.is_value(kind):
                return dynamic.at(holder, self.value(args[1]))
            if isinstance(kind, T.ArrayType):
                return F.get(holder, self.compile(args[1]).cast("int"))
            if args[1].kind == "literal":
                return holder[args[1].value]
            return F.try_element_at(holder, self.compile(args[1]))
        if k == "call":
            return self.call(node.value, args)
        raise QueryError(f"{k} is not a value")

    def compare(self, op: str, a: Node, b: Node) -> Column:
        """Comparison of values of one type; null equals null, and values of different types are never equal. Where a type is only known row by row, as in
        headers, values of different types have an order too, and null is below all others (:func:`dynamic.key`); a column that is null has no order."""
        (left, lk), (right, rk) = self.typed(a), self.typed(b)
        if any(map(dynamic.is_value, (lk, rk))) or any(map(dynamic.is_list, (lk, rk))):
            return dynamic.compare(op, dynamic.key_of(left, lk), dynamic.key_of(right, rk))
        same = values.type_name(lk) == values.type_name(rk) or isinstance(lk, T.NullType) or isinstance(rk, T.NullType)
        if isinstance(lk, T.StructType) and {"path", "embed"} <= set(lk.names):
            left, lk = left["path"], T.StringType()
        if isinstance(rk, T.StructType) and {"path", "embed"} <= set(rk.names):
            right, rk = right["path"], T.StringType()
        same = same or (isinstance(lk, T.StringType) and isinstance(rk, T.StringType))
        if not same:
            return F.lit(op == "!=")
        left, right = (durations.length(c) if values.type_name(k) == "duration" else c for c, k in ((left, lk), (right, rk)))
        if op == "=":
            return left.eqNullSafe(right)
        if op == "!=":
            return ~left.eqNullSafe(right)
        return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]

    def arithmetic(self, op: str, a: Node, b: Node) -> Column:
        (left, lk), (right, rk) = self.typed(a), self.typed(b)
        ln, rn = values.type_name(lk), values.type_name(rk)
        if dynamic.is_value(lk) or dynamic.is_value(rk):
            left, right = dynamic.of(left, lk), dynamic.of(right, rk)
            if a.kind == "literal" and a.value == 0 and op == "-":  # a minus before a value
                return dynamic.scale("*", right, dynamic.make("number", number=F.lit(-1.0)))
            return dynamic.add(left, right, 1 if op == "+" else -1) if op in "+-" else dynamic.scale(op, left, right)
        if "null" in (ln, rn) and "string" not in (ln, rn):
            return F.lit(None)
        if op == "+" and "string" in (ln, rn):
            shown = [F.coalesce(durations.text(c) if n == "duration" else c.cast("string"), F.lit("")) for c, n in ((left, ln), (right, rn))]
            return F.concat(*shown)
        if op == "*" and ln == "string":
            return F.repeat(left, right.cast("int"))
        if op in "+-" and ln == "date" and rn == "duration":
            return durations.plus(left, right, 1 if op == "+" else -1)
        if op == "+" and ln == "duration" and rn == "date":
            return durations.plus(right, left)
        if ln == "date" and rn == "date" and op == "-":
            return F.struct(F.lit(0).alias("months"), (F.unix_micros(left.cast("timestamp")) - F.unix_micros(right.cast("timestamp"))).alias("micros"))
        if op in "+-" and ln == rn == "duration":
            return durations.add(left, right, 1 if op == "+" else -1)
        if op in "*/" and ln == "duration" and rn == "number":
            return durations.times(left, right if op == "*" else F.try_divide(F.lit(1.0), right))
        if op == "*" and ln == "number" and rn == "duration":
            return durations.times(right, left)
        if op == "-" and rn == "duration" and a.kind == "literal" and a.value == 0:
            return durations.times(right, F.lit(-1))
        if (ln, rn) != ("number", "number"):
            raise QueryError(f"{op} is not defined for {ln} and {rn}")
        return {"+": lambda: left + right, "-": lambda: left - right, "*": lambda: left * right, "/": lambda: F.try_divide(left, right), "%": lambda: left % F.nullif(right, F.lit(0))}[op]()

    def field(self, holder: Node, name: str) -> Column:
        if holder.kind == "name" and holder.value == "this":
            if name not in self.this:
                return F.lit(None).cast("string")
            return F.lit(self.this[name])
        if holder.kind == "field" and holder.value == "file" and holder.args[0].kind == "name" and holder.args[0].value == "this":
            return self.file_field(name, F.lit(self.this.get("path")).cast("string"), {k: F.lit(v) for k, v in self.this.items()})
        if holder.kind == "name" and holder.value == "file" and "file" not in self.df.columns and "file" not in self.names:
            return self.file_field(name, self.column("path"), {c: F.col(f"`{c}`") for c in self.df.columns})
        if holder.kind == "link":
            known = f"{LINKED}[[{holder.value[0]}]].{name}"
            return F.col(f"`{known}`") if known in self.df.columns else self.look_up(holder.value[0], name)
        path = dotted(Node("field", name, [holder]))
        if path and path[0] not in self.names:
            for prefix in (LINKED, HEADER):
                if prefix + ".".join(path) in self.df.columns:
                    return F.col(f"`{prefix}{'.'.join(path)}`")
        if dotted(holder) == ["file", "frontmatter"]:
            whole = self.compile(holder)
            if isinstance(self.kind(whole), T.VariantType):
                return dynamic.of_variant(header_part(whole, name))
        column, kind = self.typed(holder)
        if dynamic.is_value(kind):
            return dynamic.field(column, name)
        if dynamic.is_list(kind):
            return F.transform(column, lambda x: dynamic.field(x, name))
        if isinstance(kind, T.ArrayType):
            inner = kind.elementType
            if isinstance(inner, T.StructType):
                found = next((c for c in inner.names if clean(c) == clean(name) or c == HEADER + name), None)
                return F.transform(column, lambda x: x[found]) if found else F.lit(None).cast("array<string>")
        if values.type_name(kind) == "duration" and name in durations.PARTS:
            return durations.part(column, name)
        if isinstance(kind, T.StructType):
            found = next((c for c in kind.names if clean(c) == clean(name) or c == HEADER + name), None)
            return column[found] if found else F.lit(None).cast("string")
        if isinstance(kind, T.MapType):
            return F.try_element_at(column, F.lit(name))
        if values.type_name(kind) == "date":
            return dates.part(column, name)
        return F.lit(None).cast("string")

    def file_field(self, name: str, path: Column, own: dict[str, Column]) -> Column:
        """Implicit fields of a note's file. Name, folder and day come from the path, times, size, tags and links from the columns of these names."""
        moment = {"ctime": "created", "mtime": "mod_time", "cday": "created", "mday": "mod_time"}
        base = paths.basename(path)
        if name in ("path", "name", "ext", "folder", "link", "day"):
            return {
                "path": lambda: path, "name": lambda: base, "ext": lambda: F.regexp_replace(paths.extension(path), r"^\.", ""), "folder": lambda: paths.folder(path),
                "link": lambda: values.link(path, base), "day": lambda: dates.file_day(base).cast("timestamp"),
            }[name]()
        if name in moment:
            found = own.get(name, own.get(moment[name], F.lit(None).cast("timestamp"))).cast("timestamp")
            return F.date_trunc("day", found) if name.endswith("day") else found
        if name == "tags":
            parts = F.transform(own["tags"], lambda t: F.split(t, "/")) if "tags" in own else F.array().cast("array<array<string>>")
            levels = F.transform(parts, lambda t: F.transform(F.sequence(F.lit(1), F.size(t)), lambda n: F.array_join(F.slice(t, 1, n), "/")))
            return F.array_sort(F.array_distinct(F.flatten(levels)))
        if name == "etags":
            return own.get("tags", F.array().cast("array<string>"))
        if name in ("size", "inlinks", "outlinks", "aliases", "frontmatter", "tasks", "lists", "starred"):
            return own.get({"frontmatter": "fields"}.get(name, name), F.lit(None).cast("string"))
        raise QueryError(f"unknown field file.{name}")

    def literal(self, node: Node) -> Any:
        if node.kind == "arithmetic" and node.value == "-" and repr(node.args[0]) == repr(Node("literal", 0)):
            return -self.literal(node.args[1])
        if node.kind != "literal":
            raise QueryError("this argument must be a literal")
        return node.value

    def function(self, node: Node, kind: T.DataType) -> Callable[[Column], Column]:
        """A lambda as a function of a column."""
        if node.kind != "lambda":
            raise QueryError("expected a function such as (x) => x")
        name = node.value[0]
        return lambda x: self.inside({**self.names, name: (x, kind)}).compile(node.args[0])

    def key(self, node: Node, kind: T.DataType) -> Callable[[Column], Column]:
        """A lambda as a function to something that can be ordered."""
        if node.kind != "lambda":
            raise QueryError("expected a function such as (x) => x")
        name = node.value[0]
        return lambda x: order_of(*self.inside({**self.names, name: (x, kind)}).typed(node.args[0]))

    def nullable(self, node: Node) -> bool:
        """Whether an expression is a plain field, which may be unset in a row."""
        return node.kind in ("name", "field") and not (node.kind == "name" and node.value in self.names)

    def of_value(self, name: str, value: Column, args: list[Node]) -> Column | None:
        """Functions of a value whose type is known row by row; None for those that take its text, its date or its elements."""
        rest = [self.value(a) for a in args[1:] if a.kind != "lambda"] if name in ("contains", "icontains", "econtains", "default", "ldefault") else []
        if name == "length":
            return dynamic.length(value)
        if name in ("lower", "upper"):
            change = EACH[name]
            return dynamic.each(value, lambda v: F.when(v["kind"] == "string", dynamic.make("string", text=change(v["text"]))).otherwise(v))
        if name in ("floor", "ceil", "trunc", "round"):
            digits = self.literal(args[1]) if len(args) > 1 else 0
            change = (lambda c: F.round(c, digits)) if name == "round" else EACH[name]
            return dynamic.each(value, lambda v: F.when(v["kind"] == "number", dynamic.make("number", number=change(v["number"]))).otherwise(dynamic.null()))
        if name == "number":
            found = lambda v: F.when(v["kind"] == "number", v["number"]).otherwise(values.number(dynamic.scalar_text(v)))
            return found(value)
        if name == "string":
            return dynamic.text(value)
        if name == "join":
            return values.join(F.transform(dynamic.items(value), dynamic.text), self.literal(args[1]) if len(args) > 1 else ", ")
        if name in ("contains", "icontains", "econtains"):
            fold = (lambda c: F.lower(c)) if name == "icontains" else (lambda c: c)
            part = rest[0]
            wanted = fold(dynamic.scalar_text(part))
            same = lambda x: dynamic.key(x).eqNullSafe(dynamic.key(part)) if name != "icontains" else fold(dynamic.scalar_text(x)) == wanted
            named = F.map_contains_key(F.try_variant_get(value["raw"], "$", "map<string,variant>"), F.coalesce(part["text"], F.lit("")))
            inside = F.contains(fold(value["text"]), wanted)
            return F.when(value["kind"] == "array", F.exists(dynamic.items(value), same)).when(value["kind"] == "object", named).otherwise(F.coalesce(inside, F.lit(False)))
        if name in ("default", "ldefault"):
            each = dynamic.each if name == "default" else (lambda v, f: f(v))
            return each(value, lambda v: F.when(v["kind"] == "null", rest[0]).otherwise(v))
        if name == "meta":
            return self.compile(args[0])
        if name == "extract":
            keys = [self.literal(a) for a in args[1:]]
            return F.to_variant_object(F.map_filter(F.try_variant_get(value["raw"], "$", "map<string,variant>"), lambda k, v: k.isin(keys)))
        return None

    def of_values(self, name: str, column: Column, args: list[Node]) -> Column | None:
        """Functions of a list whose elements each have their own type; None for those that work on any list."""
        if len(args) == 1 and name in ("sum", "product", "average"):
            return {"sum": dynamic.total, "product": dynamic.product, "average": dynamic.average}[name](column)
        if len(args) == 1 and name in ("min", "max"):
            return F.coalesce(dynamic.extreme(F.filter(column, lambda x: x["kind"] != "null"), dynamic.key, name == "max"), dynamic.null())
        if name in ("unique", "distinct"):
            return values.distinct_by(column, self.key(args[1], dynamic.VALUE) if len(args) > 1 else dynamic.key)
        if name == "nonnull":
            return F.filter(column, lambda x: x["kind"] != "null")
        if name == "join":
            return values.join(F.transform(column, dynamic.text), self.literal(args[1]) if len(args) > 1 else ", ")
        if name == "flat":
            return F.flatten(F.transform(column, dynamic.items))
        if name in ("contains", "icontains", "econtains", "indexof"):
            wanted = dynamic.key(self.value(args[1]))
            if name == "indexof":
                return F.coalesce(F.array_position(F.transform(column, dynamic.key), wanted), F.lit(0)) - 1
            return F.exists(column, lambda x: dynamic.key(x).eqNullSafe(wanted))
        if name in ("all", "any", "none", "every", "some") and len(args) == 1:
            name = {"every": "all", "some": "any"}.get(name, name)
            found = F.forall(column, dynamic.truthy) if name == "all" else F.exists(column, dynamic.truthy)
            return ~found if name == "none" else found
        if name in EACH or name == "round":
            return F.transform(column, lambda x: dynamic.of(self.of_value(name, x, args), T.DoubleType() if name == "number" else T.StringType() if name == "string" else dynamic.VALUE))
        return None

    def test(self, node: Node, kind: T.DataType) -> Callable[[Column], Column]:
        name = node.value[0]
        return lambda x: self.inside({**self.names, name: (x, kind)}).true(node.args[0])

    def call(self, name: str, args: list[Node]) -> Column:
        if name in ("list", "array"):
            found = [self.typed(a) for a in args]
            if len({values.type_name(k) for _, k in found} - {"null"}) > 1 or any(dynamic.is_value(k) for _, k in found):
                return F.array(*(dynamic.of(c, k) for c, k in found))
            return F.array(*(c for c, _ in found))
        if name == "object":
            return F.struct(*(self.compile(v).alias(self.literal(k)) for k, v in zip(args[::2], args[1::2])))
        if name == "date":
            if args[0].kind == "name" and args[0].value in ("today", "now", "tomorrow", "yesterday", "sow", "som", "soy", "eow", "eom", "eoy"):
                return dates.keyword(args[0].value, self.clock)
            column, kind = self.typed(args[0])
            if dynamic.is_value(kind):
                linked = F.when(column["kind"] == "link", dates.file_day(column["text"]).cast("timestamp"))
                return F.coalesce(dynamic.moment(column), linked, dates.date(dynamic.string(column), self.literal(args[1]) if len(args) > 1 else None))
            if values.type_name(kind) == "date":
                return column
            if values.type_name(kind) == "link":
                return dates.file_day(column["path"]).cast("timestamp")
            return dates.date(column, self.literal(args[1]) if len(args) > 1 else None)
        if name == "dur":
            column, kind = self.typed(args[0])
            if dynamic.is_value(kind):
                return F.coalesce(dynamic.duration(column), durations.duration(dynamic.string(column)))
            return column if values.type_name(kind) == "duration" else durations.duration(column)
        if name == "link":
            return values.link(self.coerced(args[0], "string"), self.coerced(args[1], "string") if len(args) > 1 else None)
        if name == "embed":
            inner = self.compile(args[0])
            return values.link(inner["path"], inner["display"], embed=True)
        if name == "elink":
            return values.external_link(self.compile(args[0]), self.compile(args[1]) if len(args) > 1 else None)
        if name == "typeof":
            column, kind = self.typed(args[0])
            return column["kind"] if dynamic.is_value(kind) else F.when(column.isNull(), "null").otherwise(values.type_name(kind)) if self.nullable(args[0]) else F.lit(values.type_name(kind))
        if name == "meta":
            return self.compile(args[0])
        if name == "choice":
            (yes, yk), (no, nk) = self.typed(args[1]), self.typed(args[2])
            if dynamic.is_value(yk) or dynamic.is_value(nk) or len({values.type_name(k) for k in (yk, nk)} - {"null"}) > 1:
                yes, no = dynamic.of(yes, yk), dynamic.of(no, nk)
            return F.when(self.true(args[0]), yes).otherwise(no)
        if name in ("min", "max") and len(args) > 1:
            found = [self.typed(a) for a in args]
            if any(dynamic.is_value(k) for _, k in found) or len({values.type_name(k) for _, k in found} - {"null"}) > 1:
                return dynamic.extreme(F.array(*(dynamic.of(c, k) for c, k in found)), dynamic.key, name == "max")
            if all(values.type_name(k) == "duration" for _, k in found):
                return values.by_key(F.array(*(c for c, _ in found)), durations.length, name == "max")
            return (F.least if name == "min" else F.greatest)(*(c for c, _ in found))
        if not args:
            raise QueryError(f"{name} needs an argument")
        column, kind = self.typed(args[0])
        if dynamic.is_value(kind):
            found = self.of_value(name, column, args)
            if found is not None:
                return found
            if name in TEXT_FUNCTIONS:
                column, kind = dynamic.string(column), T.StringType()
            elif name in DATE_FUNCTIONS:
                column, kind = dynamic.moment(column), T.TimestampType()
            elif name == "durationformat":
                column = dynamic.duration(column)
            else:
                column, kind = dynamic.items(column), dynamic.LIST
        if dynamic.is_list(kind):
            found = self.of_values(name, column, args)
            if found is not None:
                return found
        many = isinstance(kind, T.ArrayType)
        inner = kind.elementType if many else kind
        if name == "striptime":
            return dates.strip_time(column)
        if name in EACH:
            return values.each(column, EACH[name], many)
        if name == "round":
            digits = self.literal(args[1]) if len(args) > 1 else 0
            return values.each(column, lambda c: F.round(c, digits), many)
        simple = {
            "sum": values.total, "product": values.product, "average": values.average, "min": F.array_min, "max": F.array_max, "reverse": F.reverse, "nonnull": F.array_compact,
            "length": lambda c: F.size(c) if isinstance(kind, (T.ArrayType, T.MapType)) else F.length(c), "unique": F.array_distinct, "flat": F.flatten,
        }
        if many and values.type_name(inner) == "duration":
            if name in ("sum", "average"):
                whole = F.when(F.size(column) > 0, durations.total(column))
                return whole if name == "sum" else durations.times(whole, F.try_divide(F.lit(1.0), F.size(column)))
            if name in ("min", "max"):
                return values.by_key(column, durations.length, name == "max")
        if name in simple and len(args) == 1:
            return simple[name](column)
        if name == "sort":
            way = self.literal(args[-1]) if len(args) > 1 and args[-1].kind == "literal" else "asc"
            if way not in ("asc", "desc"):
                raise QueryError(f"sort goes asc or desc, not {way}")
            if len(args) > 1 and args[1].kind == "lambda":
                return dynamic.sorted_by(column, self.key(args[1], inner), way == "desc")
            if way == "asc" and groups.orderable(inner) and values.type_name(inner) != "duration":
                return F.array_sort(column)
            return dynamic.sorted_by(column, lambda x: order_of(x, inner), way == "desc")
        if name in ("minby", "maxby"):
            return values.by_key(column, self.key(args[1], inner), name == "maxby")
        if name in ("contains", "icontains", "econtains"):
            return values.contains(column, self.compile(args[1]), kind, fold=name == "icontains")
        if name == "containsword":
            return values.contains_word(column, self.literal(args[1]), many)
        if name == "extract":
            return values.extract(column, [self.literal(a) for a in args[1:]], kind)
        name = {"every": "all", "some": "any"}.get(name, name)
        if name in ("all", "any", "none"):
            if len(args) > 1 and args[1].kind == "lambda":
                tested = self.test(args[1], inner)
            elif many:
                tested = lambda x: values.truthy(x, inner)
            else:
                every = [self.true(a) for a in args]
                joined = commands.all_sources(*every) if name == "all" else commands.any_source(*every)
                return ~joined if name == "none" else joined
            return values.all_of(column, tested) if name == "all" else values.any_of(column, tested) if name == "any" else ~values.any_of(column, tested)
        if name == "join":
            return values.join(column, self.literal(args[1]) if len(args) > 1 else ", ")
        if name == "filter":
            return F.filter(column, self.test(args[1], inner))
        if name == "map":
            return F.transform(column, self.function(args[1], inner))
        if name in ("regextest", "regexmatch"):
            subject, subject_kind = self.typed(args[1])
            if dynamic.is_value(subject_kind):
                subject, subject_kind = dynamic.string(subject), T.StringType()
            return values.each(subject, lambda c: values.regex_test(self.literal(args[0]), c, name == "regexmatch"), isinstance(subject_kind, T.ArrayType))
        if name == "regexreplace":
            return values.regex_replace(column, self.literal(args[1]), self.literal(args[2]), many)
        if name == "replace":
            return values.replace(column, self.compile(args[1]), self.compile(args[2]), many)
        if name == "split":
            return values.split(column, self.literal(args[1]), self.literal(args[2]) if len(args) > 2 else None)
        if name in ("startswith", "endswith"):
            test = F.startswith if name == "startswith" else F.endswith
            return values.each(column, lambda c: test(c, self.compile(args[1])), many)
        if name in ("padleft", "padright"):
            return values.pad(column, self.literal(args[1]), self.literal(args[2]) if len(args) > 2 else " ", name == "padleft", many)
        if name == "substring":
            return values.substring(column, self.literal(args[1]), self.literal(args[2]) if len(args) > 2 else None, many)
        if name == "truncate":
            return values.truncate(column, self.literal(args[1]), self.literal(args[2]) if len(args) > 2 else "...", many)
        if name in ("default", "ldefault"):
            return values.default(column, self.compile(args[1]), many and name == "default")
        if name == "dateformat":
            return dates.date_format(column, self.literal(args[1]))
        if name == "localtime":
            return dates.local_time(column, self.literal(args[1]) if len(args) > 1 else "UTC")
        if name == "durationformat":
            return durations.minutes_text(column["micros"] / F.lit(60 * durations.SECOND))
        if name in ("slice", "limit"):
            start = self.literal(args[1]) if name == "slice" else 0
            end = self.literal(args[-1]) if name == "limit" or len(args) > 2 else None
            return values.slice_of(column, start, end)
        if name in ("first", "last"):
            return F.get(column, F.lit(0)) if name == "first" else F.get(column, F.size(column) - 1)
        if name == "indexof":
            return F.coalesce(F.array_position(column, self.compile(args[1])), F.lit(0)) - 1
        if name in ("find", "findindex"):
            return values.find(column, self.test(args[1], inner), name == "findindex")
        if name == "flatmap":
            return F.flatten(F.transform(column, self.function(args[1], inner)))
        if name == "distinct":
            return F.array_distinct(column) if len(args) == 1 else values.distinct_by(column, self.function(args[1], inner))
        if name == "to":
            key = self.literal(args[1])
            found = F.transform(column, lambda x: x[key])
            return F.flatten(found) if isinstance(inner, T.StructType) and isinstance(inner[key].dataType, T.ArrayType) else found
        raise QueryError(f"unknown function {name}")


#: Functions that read the text, and those that read the date, of a value whose type is known row by row.
TEXT_FUNCTIONS = {"containsword", "regextest", "regexmatch", "regexreplace", "replace", "split", "startswith", "endswith", "padleft", "padright", "substring", "truncate"}
DATE_FUNCTIONS = {"dateformat", "striptime", "localtime"}
#: Functions whose result is true or false, whatever they get.
TESTS = {"contains", "icontains", "econtains", "all", "any", "none", "every", "some"}
#: Columns that the engine adds: header fields by their path, and fields of linked notes.
HEADER, LINKED = "__header.", "__linked."
#: Columns that hold what a group needs of a row.
HELD = "__held_"


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The rows with more columns, each computed once. One row from one row: unlike a projection, a generator isn't merged into the sorts and aggregates that read it."""
    if not columns:
        return df
    rows = df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("__computed"))
    return rows.select(*(F.col(f"`{c}`") for c in df.columns), *(F.col("__computed")[n].alias(n) for n in columns))


def with_fields(known: list[str], names: list[str]) -> Callable[[Column], Column]:
    """A struct of values with more of them: ``a.b`` is the field b of the struct's a."""
    return lambda s: F.struct(*(s[k].alias(k) for k in known), *(dynamic.field(s[n.rpartition(".")[0]], n.rpartition(".")[2]).alias(n) for n in names))


def value_part(value: Column, name: str) -> Column:
    return {"string": dynamic.string, "moment": dynamic.moment, "duration": dynamic.duration, "number": lambda v: v["number"]}[name](value)


def order_of(column: Column, kind: T.DataType) -> Column:
    """Something that Spark can sort and compare, in the order of the language; null for null."""
    if dynamic.is_value(kind):
        return F.when(column["kind"] != "null", dynamic.key(column))
    if dynamic.is_list(kind) or isinstance(kind, (T.VariantType, T.MapType)):
        return F.when(column.isNotNull(), dynamic.key_of(column, kind))
    return durations.length(column) if values.type_name(kind) == "duration" else column


#: Names with a meaning of their own in ``date(today)`` and the like.
KEYWORDS = {"today", "now", "tomorrow", "yesterday", "sow", "som", "soy", "eow", "eom", "eoy"}
LINK_PARTS = ("path", "display", "subpath", "type", "embed")


def as_shown(column: Column, kind: T.DataType) -> Column:
    """A result's column: values by their text."""
    if dynamic.is_value(kind):
        return dynamic.text(column)
    return F.transform(column, dynamic.text) if dynamic.is_list(kind) else column


def dotted(node: Node) -> list[str]:
    """``a.b.c`` as its names; empty for other expressions."""
    if node.kind == "name":
        return [node.value]
    if node.kind == "field":
        before = dotted(node.args[0])
        return before and [*before, node.value]
    return []


def header_part(header: Column, name: str) -> Column:
    """The VARIANT below a name: as it is written, else in the cleaned form of names."""
    path = lambda n: '$["' + n.replace("\\", "\\\\").replace('"', '\\"') + '"]'
    found = F.try_variant_get(header, path(name), "variant")
    return found if clean(name) == name else F.coalesce(found, F.try_variant_get(header, path(clean(name)), "variant"))


def clean(name: str) -> str:
    return re.sub(r"[^\w]+", "-", name.strip().lower())


def mentions(node: Any, names: set[str]) -> bool:
    if not isinstance(node, Node):
        return False
    return (node.kind == "name" and node.value in names) or any(mentions(a, names) for a in node.args)


@dataclass
class Engine:
    """Runs queries over notes; ``links`` (src, dst) serve link sources, ``clock`` the date keywords, ``this`` the current note's fields."""

    notes: DataFrame
    links: DataFrame | None = None
    clock: Column | None = None
    this: dict[str, Any] = field(default_factory=dict)
    ident: str = "path"
    path: str = "path"
    tags: str = "tags"
    views: dict[str, Callable[[Engine, Any], DataFrame]] = field(default_factory=dict)
    #: Header fields that hold links and may be followed (columns of links always may).
    link_fields: tuple[str, ...] = ()

    def look_up(self, target: str, name: str) -> Column:
        """A field of the note with this path or name, as a subquery of one row; null if there is none."""
        path = F.col(self.path)
        own = self.notes.where((path == target) | (path == target + ".md") | (paths.basename(path) == target))
        own = self.with_headers(own, [Node("name", name)])
        return own.agg(F.min_by(Compiler(own, self.now, self.this).column(name), path)).scalar()

    @property
    def now(self) -> Column:
        return F.current_timestamp() if self.clock is None else self.clock

    def header(self) -> str | None:
        """The VARIANT column with the notes' own fields: header and inline fields together, else the header alone."""
        return next((c for c in ("metadata", "fields") if c in self.notes.columns and isinstance(self.notes.schema[c].dataType, T.VariantType)), None)

    def unknown_names(self, nodes: list[Node]) -> list[list[str]]:
        """Names, and paths that begin with them, that are no columns: header fields, if anything."""
        bound = {name for n in nodes for x in walk(n) if x.kind == "lambda" for name in x.value}
        columns = {clean(c) for c in self.notes.columns} | bound | {"this", "file", "row", "rows"}
        found: dict[str, list[str]] = {}
        for n in (x for node in nodes for x in walk(node)):
            path = [n.args[1].value] if n.kind == "index" and repr(n.args[0]) == repr(Node("name", "row")) and isinstance(n.args[1].value, str) else dotted(n)
            path = path[1:] if path[:1] == ["rows"] else path
            if path and path[0] not in columns and clean(path[0]) not in columns:
                for n in range(1, len(path) + 1):
                    found[".".join(path[:n])] = path[:n]
        return sorted(found.values(), key=len)

    def with_headers(self, df: DataFrame, nodes: list[Node]) -> DataFrame:
        """A column for each header path that the expressions name, each path taken out of the VARIANT once."""
        header, wanted = self.header(), {".".join(p): p for p in self.unknown_names(nodes) if HEADER + ".".join(p) not in df.columns}
        if header is None or not wanted:
            return df
        depths: dict[int, list[str]] = {1: []}
        for name, path in wanted.items():
            depths.setdefault(len(path), []).append(name)
        taken = sorted({p[0] for p in wanted.values()} - set(depths[1]))  # by an earlier step
        first = {n: dynamic.of_variant(header_part(F.col(header), n)) for n in depths.pop(1)} | {n: F.col(f"`{HEADER}{n}`") for n in taken}
        found, known = F.struct(*(c.alias(n) for n, c in first.items())), list(first)
        for _, names in sorted(depths.items()):
            found, known = dynamic.bind(found, with_fields(known, names)), known + names
        # one row from one row: unlike a projection, a generator isn't repeated in every filter and column that reads it
        df = df.select("*", F.explode(F.array(found)).alias("__headers"))
        return df.select(*(F.col(f"`{c}`") for c in df.columns if c != "__headers"), *(F.col("__headers")[n].alias(HEADER + n) for n in known if n not in taken))

    def filtered(self, parsed: Query) -> tuple[DataFrame, int]:
        """The notes behind the tests that a query begins with, and the number of commands that this does. Test by test: the header fields that a test needs are only taken out of the notes
        that the tests before it leave. Tests of linked notes, or of fields inside of header fields, come later with all else."""
        df, n = self.notes, 0
        for word, part in parsed.commands:
            tests = conjuncts(part) if word == "where" else []
            if not tests or not all(map(self.is_plain, tests)):
                break
            for test in tests:
                df = self.with_headers(df, [test])
                df = df.where(Compiler(df, self.now, self.this, look_up=self.look_up).true(test))
            n += 1
        return df, n

    def is_plain(self, test: Node) -> bool:
        """Whether a test reads columns and whole header fields only."""
        roots = {path[0] for path in map(dotted, walk(test)) if path}
        kinds = {x.kind for x in walk(test)}
        return not kinds & {"link", "row", "lambda"} and not roots & {"this", "file", "row"} and not any(self.is_link(self.notes, r) for r in roots) and all(len(p) == 1 for p in self.unknown_names([test]))

    def with_linked(self, df: DataFrame, nodes: list[Node]) -> DataFrame:
        """Fields of linked notes that the expressions read (``owner.team.name``): the tail of a chain is joined to the notes of the hop before it, each note once, and rows are
        joined to the whole chain in one join. Paths that begin alike share their hops."""
        bound = {name for n in nodes for x in walk(n) if x.kind == "lambda" for name in x.value}
        roots: dict[str, dict] = {}
        for path in (dotted(x) for node in nodes for x in walk(node)):
            if len(path) > 1 and path[0] not in bound and self.is_link(df, path[0]):
                tree = roots
                for name in path:
                    tree = tree.setdefault(name, {})
        for n in (x for node in nodes for x in walk(node) if x.kind == "field" and x.args[0].kind == "link"):
            if (column := f"{LINKED}[[{n.args[0].value[0]}]].{n.value}") not in df.columns:
                df = df.withColumn(column, self.look_up(n.args[0].value[0], n.value))
        for root, tree in roots.items():
            if set(tree) - set(LINK_PARTS):
                df = self.followed(df, Compiler(df, self.now, self.this).column(root), root, tree)
        return df

    def is_link(self, df: DataFrame, name: str) -> bool:
        return name in self.link_fields or (name in df.columns and values.type_name(df.schema[name].dataType) == "link")

    def followed(self, df: DataFrame, link: Column, root: str, tree: dict) -> DataFrame:
        """The rows with ``tree`` of the notes that a link column names, under the name of the path. Rows without a link are dealt out by their own path: as null keys of the
        join they would all go to one task."""
        tree = {name: below for name, below in tree.items() if name not in LINK_PARTS}  # these are the link's own
        kind = df.select(link.alias("t")).schema[0].dataType
        target = F.when(link["kind"] == "link", link["text"]) if dynamic.is_value(kind) else link["path"]
        pages = self.pages(tree)
        renamed = pages.select("__dealt", "__key", *(F.col(f"page.`{c}`").alias(f"{LINKED}{root}.{c}") for c in pages.schema["page"].dataType.names))
        dealt = F.xxhash64(F.coalesce(target, F.col(self.path)))
        return df.join(renamed, (dealt == F.col("__dealt")) & (target == F.col("__key")), "left").drop("__dealt", "__key")

    def pages(self, tree: dict) -> DataFrame:
        """(__dealt, __key, page) for every name that a link may use: a note's path with or without its ending, or its base name (the first path of several). ``page`` has a
        field for each path of the tree; ``__dealt`` is the name's hash."""
        notes = self.with_headers(self.notes, [Node("name", name) for name in tree])
        for name, below in tree.items():
            compiler = Compiler(notes, self.now, self.this)
            if set(below) - set(LINK_PARTS) and self.is_link(notes, name):
                notes = self.followed(notes, compiler.column(name), name, below)
        compiler = Compiler(notes, self.now, self.this)
        path = F.col(self.path)
        short = F.regexp_replace(path, r"\.md$", "")
        keys = F.array_distinct(F.array(path, short, paths.basename(path), paths.basename(short)))
        shown = [compiler.column(name).alias(name) for name in tree]
        deeper = [F.col(f"`{c}`").alias(c.removeprefix(LINKED)) for c in notes.columns if c.startswith(LINKED)]
        found = notes.select(F.explode(keys).alias("__key"), path.alias("__path"), F.struct(*shown, *deeper).alias("page"))
        return found.groupBy(F.xxhash64("__key").alias("__dealt"), "__key").agg(F.min_by("page", "__path").alias("page"))

    def view(self, name: str, given: Any = None) -> DataFrame:
        """The result of a registered script."""
        if name not in self.views:
            raise QueryError(f"unknown view {name}")
        return self.views[name](self, given)

    def markdown(self, text: str) -> DataFrame:
        """The query's result as lines of Markdown (column ``line``); a table's head is not among them (``commands.markdown_head``)."""
        form, result = read(text).form, self.query(text)
        if form == "TASK":
            mark = F.concat(F.lit("- ["), F.col("status"), F.lit("] "), F.col("text"))
            return result.select(F.concat(F.expr("repeat(' ', indent)"), F.when(F.col("task"), mark).otherwise(F.concat(F.lit("- "), F.col("text")))).alias("line"))
        if form == "LIST":
            return result.select(commands.markdown_list(result).alias("line"))
        return result.select(commands.markdown_table(result).alias("line"))

    def query(self, text: str, ordered: bool = True) -> DataFrame:
        return self.planned(read(text), ordered)

    def planned(self, parsed: Query, ordered: bool = True) -> DataFrame:
        """The rows of a query. Unless they are to be ``ordered``, a sort that the query ends with is left out, for callers that unite, count or sort them otherwise; all rows are there either way."""
        if not ordered and parsed.commands and parsed.commands[-1][0] == "sort":
            parsed = replace(parsed, commands=parsed.commands[:-1])
        every = parsed.expressions()
        folds, whole = groups.folds_in(every, Node)
        every += [n for fold in folds.values() for n in fold.nodes()]
        if whole:  # fields of listed rows may be header fields too
            every += [Node("name", n.value) for node in every for n in walk(node) if n.kind == "field"]
        df, done = self.filtered(parsed)
        df = self.with_linked(self.with_headers(df, every), every)
        now = self.now
        steps, at = parsed.commands[done:], 0
        grouped = False
        columns = list(parsed.columns)
        while at < len(steps):
            word, part = steps[at]
            compiler = Compiler(df, now, self.this, look_up=self.look_up)
            at += 1
            if word == "from":
                df = self.source(df, part)
            elif word == "where":
                df = df.where(compiler.true(part))
            elif word == "flatten":
                column, kind = compiler.typed(part[0])
                if dynamic.is_value(kind):
                    df = commands.flatten(df, dynamic.items(column), part[1])
                    df = df.withColumn(part[1], F.coalesce(F.col(f"`{part[1]}`"), dynamic.null()))
                else:
                    df = commands.flatten(df, column, part[1])
            elif word == "sort":
                df = commands.sort(df, *((order_of(*compiler.typed(n)), way) for n, way in part))
            elif word == "limit":
                df = df.limit(part)
            else:
                node, name = part
                rest = [n for w, p in steps[at:] for n in nodes_of(w, p)] + [n for n, _ in columns]
                found, whole = groups.folds_in(rest, Node)
                compiler.held = None if whole else {}  # listed rows have no columns but their own
                made = {f"__agg{i}": groups.aggregate(compiler, fold) for i, fold in enumerate(found.values())}
                df = computed(df, compiler.held or {})
                swap = {text: Node("name", k) for k, text in zip(made, found)}
                df = commands.grouped(df, *compiler.typed(node), name, made, whole)
                steps = steps[:at] + [(w, rewrite(p, swap)) for w, p in steps[at:]]
                columns = [(rewrite(n, swap), t) for n, t in columns]
                grouped, self_key = True, name
        compiler = Compiler(df, now, self.this, look_up=self.look_up)
        if parsed.form == "CALENDAR":
            column, kind = compiler.typed(columns[0][0])
            return commands.calendar(df, dynamic.moment(column) if dynamic.is_value(kind) else column)
        if parsed.form == "TASK":
            return df if grouped or not {"line", "parent_line"} <= set(df.columns) else tasks.with_children(self.notes, df)
        shown = [as_shown(*compiler.typed(n)).alias(t or f"value{i}") for i, (n, t) in enumerate(columns)]
        if parsed.with_id:
            ident = self_key if grouped else self.ident
            shown = [as_shown(F.col(f"`{ident}`"), df.schema[ident].dataType).alias(ident), *shown]
        return df.select(*(shown or [F.col(f"`{self.ident}`")]))

    def value(self, expression: str, row: DataFrame) -> DataFrame:
        """One expression on one context row."""
        node = Reader(expression).expression()
        row = self.with_headers(row, [node])
        return row.limit(1).select(as_shown(*Compiler(row, self.now, self.this, look_up=self.look_up).typed(node)).alias("value"))

    def try_query(self, text: str) -> tuple[DataFrame | None, str | None]:
        """(result, error) instead of an exception. Unlike :meth:`query`, it also reports a name that is in no column and, after one look at the notes, in no header."""
        try:
            parsed = read(text)
            if missing := self.missing(parsed):
                return None, f"unknown field {missing}"
            return self.planned(parsed), None
        except QueryError as error:
            return None, str(error)
        except AnalysisException as error:
            return None, str(error).split("\n")[0]

    def missing(self, parsed: Query) -> str | None:
        """The first name of a query that nothing defines."""
        every = parsed.expressions()
        given = {clean(p[1]) for w, p in parsed.commands if w in ("group", "flatten")}
        names = sorted({path[0] for path in self.unknown_names(every)} - KEYWORDS)
        names = [n for n in names if clean(n) not in given]
        if not names or self.header() is None:
            return names[0] if names else None
        rows = self.with_headers(self.notes, [Node("name", n) for n in names])
        seen = rows.agg(*(F.bool_or(F.col(f"`{HEADER}{n}`.kind") != "null").alias(f"n{i}") for i, n in enumerate(names))).first()
        return next((n for i, n in enumerate(names) if not seen[i]), None)

    def source(self, df: DataFrame, node: Node) -> DataFrame:
        """Notes of a source. Tags and folders are predicates; link sources are marked by a join on the distinct ends of the links."""
        links = [n for n in walk(node) if n.kind in ("incoming", "outgoing")]
        for i, n in enumerate(links):
            if self.links is None:
                raise QueryError("no links are given")
            mine, other = ("src", "dst") if n.kind == "incoming" else ("dst", "src")
            target = n.value or self.this.get(self.path)
            ends = self.links.where(F.col(other) == target).select(F.col(mine).alias(f"__end{i}")).distinct()
            df = df.join(ends, F.col(self.path) == F.col(f"__end{i}"), "left")
        marks = {id(n): F.col(f"__end{i}").isNotNull() for i, n in enumerate(links)}

        def test(n: Node) -> Column:
            if n.kind == "and":
                return test(n.args[0]) & test(n.args[1])
            if n.kind == "or":
                return test(n.args[0]) | test(n.args[1])
            if n.kind == "not":
                return ~test(n.args[0])
            if n.kind == "tag":
                return F.coalesce(commands.tagged(n.value, self.tags), F.lit(False))
            if n.kind == "folder":
                return commands.in_folder(n.value, self.path)
            return marks[id(n)]

        return df.where(test(node)).drop(*(f"__end{i}" for i in range(len(links))))


def walk(node: Any):
    if isinstance(node, Node):
        yield node
        for a in node.args:
            yield from walk(a)


def nodes_of(word: str, part: Any) -> list[Node]:
    if word == "sort":
        return [n for n, _ in part]
    if word in ("group", "flatten"):
        return [part[0]]
    return [part] if isinstance(part, Node) else []


def conjuncts(test: Node) -> list[Node]:
    """The tests that a test joins with ``and``."""
    return [c for a in test.args for c in conjuncts(a)] if test.kind == "and" else [test]


def rewrite(part: Any, swap: dict[str, Node]) -> Any:
    if isinstance(part, Node):
        return swap.get(repr(part)) or Node(part.kind, part.value, [rewrite(a, swap) for a in part.args])
    if isinstance(part, (list, tuple)):
        return type(part)(rewrite(x, swap) for x in part)
    return part
