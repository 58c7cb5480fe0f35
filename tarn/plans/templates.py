"""Templates compiled to Column expressions: a row goes in, a text comes out, all inside one projection.

A template is text with ``{{ ... }}`` actions: paths from the dot (``.field.part``), from the row (``$.field``) and from variables (``$x.part``), literals, calls with
arguments, calls inside brackets, pipelines (``.title | toUpper``), ``$x := …``, and blocks: ``if``, ``with``, ``range`` (``range $i, $v := .list``), each with ``else`` and ``else if`` or ``else
with``, and ``define`` with ``template``. A reader makes a tree of it, and the tree becomes columns with the dot and the variables bound lexically: a ``range`` is a ``transform`` over
the list whose texts are joined, so nothing is exploded or shuffled. ``{{-`` and ``-}}`` trim the blanks beside them. A value that is null prints as ``<no value>``; empty texts, lists and maps,
0, false and null count as false.

Not supported, and refused with the line: a variable that a block gives a new value for what follows behind it, ``break``, ``continue``, and templates that call themselves.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions import layouts, paths

ACTION = re.compile(r"\{\{(-\s)?\s*(.*?)\s*(\s-)?\}\}", re.DOTALL)
WORD = re.compile(r'\s*("(?:[^"\\]|\\.)*"|`[^`]*`|\||\(|\)|[^\s|()]+)')


class TemplateError(ValueError):
    def __init__(self, reason: str, line: int = 0):
        super().__init__(f"template line {line}: {reason}" if line else reason)
        self.reason, self.line = reason, line


def functions(clock: Column) -> dict[str, Callable[..., Column]]:
    """The functions of templates; ``now`` reads the given clock. Arguments are literals or columns; ``len``, ``index`` and ``slice`` get values with their types."""
    literal = lambda c: c if isinstance(c, str) else None
    column = lambda c: F.lit(c) if isinstance(c, (str, float, int)) else c
    compare = lambda f: lambda a, b: f(column(a), column(b))
    return {
        "now": lambda layout="": layouts.render(clock, literal(layout) or ""),
        "toLower": lambda s: F.lower(column(s)), "toUpper": lambda s: F.upper(column(s)),
        "basename": lambda p: paths.basename(column(p)), "folder": lambda p: paths.folder(column(p)), "extension": lambda p: paths.extension(column(p)), "join": lambda *p: paths.join_path(*p),
        "printf": lambda form, *a: F.format_string(form.replace("%v", "%s"), *map(column, a)),
        "print": lambda *a: F.concat(*map(shown, a)), "println": lambda *a: F.concat(F.concat_ws(" ", *map(shown, a)), F.lit("\n")),
        "eq": lambda a, *b: functools.reduce(operator.or_, [column(a) == column(x) for x in b]), "ne": compare(operator.ne), "lt": compare(operator.lt), "le": compare(operator.le), "gt": compare(operator.gt),
        "ge": compare(operator.ge), "not": lambda a: ~true(a), "and": lambda a, *b: chosen(False, a, *b), "or": lambda a, *b: chosen(True, a, *b), "len": length, "index": index,
        "slice": lambda s, a, b=None: part(s, int(a), None if b is None else int(b)),
    }


def true(value) -> Column:
    """Text is true unless empty, others unless null or false."""
    if isinstance(value, (str, float, int)):
        return F.lit(bool(value))
    return F.coalesce(~value.cast("string").isin("", "false", "0", "0.0", "[]", "{}"), F.lit(False))


def shown(value) -> Column:
    if isinstance(value, bool):
        return F.lit(str(value).lower())
    return F.lit(str(value)) if isinstance(value, (str, int, float)) else F.coalesce(value.cast("string"), F.lit("<no value>"))


def chosen(first: bool, value, *others):
    """The first value that counts as true (``or``) or as false (``and``), else the last, as a text."""
    if not others:
        return value
    text = lambda v: F.lit(str(v)) if isinstance(v, (str, int, float)) else v.cast("string")
    return F.when(true(value) if first else ~true(value), text(value)).otherwise(text(chosen(first, *others)))


@dataclass
class Typed:
    """A column whose type is known, as that of a field."""

    column: Column
    kind: T.DataType | None


def untyped(value):
    return value.column if isinstance(value, Typed) else value


def length(value) -> Column:
    if isinstance(value, str):
        return F.lit(len(value))
    many = isinstance(value, Typed) and isinstance(value.kind, (T.ArrayType, T.MapType))
    return F.size(value.column) if many else F.length(untyped(value))


def index(value, *places):
    """An element of a list by its place from 0, or of a map by its key."""
    for place in places:
        kind = value.kind if isinstance(value, Typed) else None
        if isinstance(kind, T.MapType):
            key = untyped(place) if isinstance(untyped(place), Column) else F.lit(place)
            value = Typed(F.try_element_at(value.column, key), kind.valueType)
        else:
            at = untyped(place).cast("int") if isinstance(untyped(place), Column) else F.lit(int(place))
            value = Typed(F.get(untyped(value), at), kind.elementType if isinstance(kind, T.ArrayType) else None)
    return value


def part(value, start: int, end: int | None):
    column = F.lit(value) if isinstance(value, str) else untyped(value)
    if isinstance(value, Typed) and isinstance(value.kind, T.ArrayType):
        return Typed(F.slice(column, start + 1, F.size(column) if end is None else F.lit(end - start)), value.kind)
    return F.substring(column, start + 1, 2**31 - 1 if end is None else end - start)


@dataclass
class Part:
    kind: str  # text, action
    text: str
    line: int


def scan(content: str) -> list[Part]:
    parts, at = [], 0
    trim = False
    for m in ACTION.finditer(content):
        text = content[at : m.start()]
        text = text.lstrip() if trim else text
        parts.append(Part("text", text.rstrip() if m[1] else text, content.count("\n", 0, at) + 1))
        parts.append(Part("action", m[2], content.count("\n", 0, m.start()) + 1))
        trim, at = bool(m[3]), m.end()
    rest = content[at:]
    if "{{" in rest or "}}" in re.sub(ACTION, "", content):
        raise TemplateError("unclosed action", content.count("\n", 0, at) + 1)
    parts.append(Part("text", rest.lstrip() if trim else rest, 0))
    return parts


# ---- reading ----


@dataclass
class Node:
    """Text, an action or a block. ``body`` and ``other`` are lists of nodes, ``pipe`` a pipeline of commands."""

    kind: str  # text, show, set, if, with, range, template
    line: int
    text: str = ""
    names: tuple[str, ...] = ()
    pipe: list | None = None
    body: list[Node] | None = None
    other: list[Node] | None = None


class Reader:
    """A template's tree: blocks are read recursively, each until its ``else`` or ``end``."""

    def __init__(self, content: str):
        self.parts, self.at, self.defined = scan(content), 0, {}

    def block(self, inner: bool) -> tuple[list[Node], str]:
        """Nodes up to the end of a block, and the action that ended it."""
        out: list[Node] = []
        while self.at < len(self.parts):
            p = self.parts[self.at]
            self.at += 1
            if p.kind == "text":
                if p.text:
                    out.append(Node("text", p.line, p.text))
                continue
            word = p.text.split(None, 1)[0] if p.text else ""
            rest = p.text[len(word) :].strip()
            if p.text.startswith("/*"):
                continue
            if word in ("end", "else"):
                if not inner:
                    raise TemplateError(f"unexpected {p.text}", p.line)
                return out, p.text
            if word in ("if", "with", "range"):
                out.append(self.opened(word, rest, p.line))
            elif word in ("define", "block"):
                name, _, argument = rest.partition(" ")
                if not re.fullmatch(r'"[^"]+"', name):
                    raise TemplateError(f"{word} needs a name", p.line)
                self.defined[name[1:-1]] = self.block(True)[0]
                if word == "block":
                    out.append(Node("template", p.line, name[1:-1], pipe=pipeline_of(argument, p.line)))
            elif word == "template":
                name, _, argument = rest.partition(" ")
                out.append(Node("template", p.line, name.strip('"'), pipe=pipeline_of(argument, p.line) if argument.strip() else None))
            elif word in ("break", "continue"):
                raise TemplateError(f"{word} is not supported", p.line)
            elif m := re.fullmatch(r"(\$\w+)\s*(:?=)\s*(.*)", p.text, re.DOTALL):
                out.append(Node("set", p.line, m[2], (m[1],), pipeline_of(m[3], p.line)))
            else:
                out.append(Node("show", p.line, pipe=pipeline_of(p.text, p.line)))
        if inner:
            raise TemplateError("missing end", max(p.line for p in self.parts))
        return out, ""

    def opened(self, word: str, rest: str, line: int) -> Node:
        names: tuple[str, ...] = ()
        if m := re.match(r"(\$\w+)(?:\s*,\s*(\$\w+))?\s*:=\s*", rest):
            names, rest = tuple(n for n in m.groups() if n), rest[m.end() :]
            if len(names) > 1 and word != "range":
                raise TemplateError("only range sets two variables", line)
        node = Node(word, line, names=names, pipe=pipeline_of(rest, line))
        node.body, ended = self.block(True)
        node.other = []
        if ended.startswith("else"):
            again = ended[4:].strip()
            if not again:
                node.other, ended = self.block(True)
                if ended != "end":
                    raise TemplateError(f"unexpected {ended}", self.parts[self.at - 1].line)
            else:  # else if, else with: a block inside that shares the end
                after, _, condition = again.partition(" ")
                if after not in ("if", "with") or word == "range":
                    raise TemplateError(f"unexpected {ended}", self.parts[self.at - 1].line)
                node.other = [self.opened(after, condition.strip(), self.parts[self.at - 1].line)]
        elif ended != "end":
            raise TemplateError(f"unexpected {ended}", line)
        return node


def pipeline_of(text: str, line: int) -> list:
    """Commands of a pipeline, each a list of operands; an operand is a word or, in brackets, a pipeline with the fields behind it."""
    found, rest = commands_of(text, line)
    if rest:
        raise TemplateError("unexpected )", line)
    return found


def commands_of(text: str, line: int) -> tuple[list, str]:
    commands: list[list] = [[]]
    while text := text.lstrip():
        m = WORD.match(text)
        if not m:
            raise TemplateError(f"unclosed text at {text[:10]}", line)
        text = text[m.end() :]
        if m[1] == "|":
            commands.append([])
        elif m[1] == "(":
            inner, text = commands_of(text, line)
            if not text.startswith(")"):
                raise TemplateError("unclosed (", line)
            fields = re.match(r"(?:\.\w+)*", text[1:])
            commands[-1].append((inner, fields[0]))
            text = text[1 + fields.end() :]
        elif m[1] == ")":
            text = ")" + text
            break
        else:
            commands[-1].append(m[1])
    if not all(commands):
        raise TemplateError("missing value", line)
    return commands, text


# ---- compiling ----


@dataclass
class Scope:
    """What names stand for: the dot (None at the row itself) and the variables of the blocks around."""

    dot: Any
    variables: dict[str, Any]


class Compiler:
    def __init__(self, data: Callable[[str], Column], clock: Column, kinds: T.StructType | None, defined: dict[str, list[Node]]):
        self.data, self.known, self.kinds, self.defined = data, functions(clock), kinds, defined

    def block(self, nodes: list[Node], scope: Scope, calls: tuple[str, ...] = ()) -> Column:
        out: list[Column] = []
        scope = Scope(scope.dot, dict(scope.variables))
        for node in nodes:
            if node.kind == "text":
                out.append(F.lit(node.text))
            elif node.kind == "show":
                out.append(shown(untyped(self.pipeline(node.pipe, scope, node.line))))
            elif node.kind == "set":
                if node.text == "=" and node.names[0] not in scope.variables:
                    raise TemplateError(f"undefined variable {node.names[0]}", node.line)
                scope.variables[node.names[0]] = self.pipeline(node.pipe, scope, node.line)
            elif node.kind == "template":
                if node.text not in self.defined:
                    raise TemplateError(f"template {node.text!r} not defined", node.line)
                if node.text in calls:
                    raise TemplateError(f"template {node.text!r} calls itself", node.line)
                dot = self.pipeline(node.pipe, scope, node.line) if node.pipe else Typed(F.lit(None).cast("string"), T.StringType())
                out.append(self.block(self.defined[node.text], Scope(dot, {}), (*calls, node.text)))
            else:
                self.no_assignment(node)
                out.append({"if": self.tested, "with": self.within, "range": self.ranged}[node.kind](node, scope, calls))
        return F.concat(*out) if out else F.lit("")

    def no_assignment(self, node: Node) -> None:
        """New values for variables of the blocks around would have to leave the block."""
        inside = {*node.names}
        for n in [*node.body, *node.other]:
            if n.kind == "set" and n.text == ":=":
                inside.add(n.names[0])
            elif n.kind == "set" and n.names[0] not in inside:
                raise TemplateError(f"{n.names[0]} can't be given a new value inside {node.kind}", n.line)

    def bound(self, node: Node, scope: Scope, value: Any) -> Scope:
        return Scope(scope.dot, {**scope.variables, **({node.names[0]: value} if node.names else {})})

    def tested(self, node: Node, scope: Scope, calls: tuple[str, ...]) -> Column:
        value = self.pipeline(node.pipe, scope, node.line)
        inner = self.bound(node, scope, value)
        return F.when(true(untyped(value)), self.block(node.body, inner, calls)).otherwise(self.block(node.other, inner, calls))

    def within(self, node: Node, scope: Scope, calls: tuple[str, ...]) -> Column:
        value = self.pipeline(node.pipe, scope, node.line)
        inner = self.bound(node, scope, value)
        held = value if isinstance(value, Typed) or not isinstance(value, Column) else Typed(value, None)
        return F.when(true(untyped(value)), self.block(node.body, Scope(held, inner.variables), calls)).otherwise(self.block(node.other, inner, calls))

    def ranged(self, node: Node, scope: Scope, calls: tuple[str, ...]) -> Column:
        """The body for each element, joined. A map goes by its sorted keys, a number n from 0 to n - 1."""
        value = self.pipeline(node.pipe, scope, node.line)
        kind = value.kind if isinstance(value, Typed) else None
        column = untyped(value)
        if isinstance(value, int) and not isinstance(value, bool) or isinstance(kind, T.IntegralType):
            n = F.lit(value) if isinstance(value, int) else column.cast("int")
            column, kind = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), T.ArrayType(T.IntegerType())
        if not isinstance(column, Column) or (kind is not None and not isinstance(kind, (T.ArrayType, T.MapType))):
            raise TemplateError("range needs a list", node.line)

        def over(first, second) -> Column:
            names = {node.names[0]: second} if len(node.names) == 1 else dict(zip(node.names, (first, second)))
            return self.block(node.body, Scope(second, {**scope.variables, **names}), calls)

        if isinstance(kind, T.MapType):
            entries = F.array_sort(F.transform(F.map_keys(column), lambda k: F.struct(k.alias("k"))))
            texts = F.transform(entries, lambda e: over(Typed(e["k"], kind.keyType), Typed(F.try_element_at(column, e["k"]), kind.valueType)))
            filled = F.size(column) > 0
        else:
            element = kind.elementType if kind else None
            texts = F.transform(column, lambda x, i: over(Typed(i, T.IntegerType()), Typed(x, element)))
            filled = F.size(column) > 0
        return F.when(F.coalesce(filled, F.lit(False)), F.array_join(texts, "")).otherwise(self.block(node.other, scope, calls))

    # values

    def pipeline(self, commands: list, scope: Scope, line: int) -> Any:
        result = None
        for i, operands in enumerate(commands):
            result = self.command(operands, scope, line, [] if i == 0 else [result])
        return result

    def command(self, operands: list, scope: Scope, line: int, piped: list) -> Any:
        """Value of one command: an operand, or a call with the value before it as the last argument."""
        first = operands[0]
        if isinstance(first, str) and first in self.known:
            arguments = [self.operand(o, scope, line) for o in operands[1:]] + piped
            if first not in ("len", "index", "slice"):
                arguments = [untyped(a) for a in arguments]
            try:
                return self.known[first](*arguments)
            except (TypeError, AttributeError, ValueError) as error:
                raise TemplateError(f"wrong arguments for {first}", line) from error
        if len(operands) > 1:
            raise TemplateError(f"function '{first}' not defined" if isinstance(first, str) else "a value is not a function", line)
        if piped:
            raise TemplateError(f"'{first}' is not a function", line)
        return self.operand(first, scope, line)

    def operand(self, word: Any, scope: Scope, line: int) -> Any:
        if isinstance(word, tuple):
            return self.fields(self.pipeline(word[0], scope, line), word[1], line)
        if word in self.known:
            return self.command([word], scope, line, [])
        if word[0] in "\"`":
            return word[1:-1] if word[0] == "`" else bytes(word[1:-1], "utf-8").decode("unicode_escape").encode("latin-1").decode("utf-8")
        if re.fullmatch(r"-?\d+(\.\d+)?", word):
            return float(word) if "." in word else int(word)
        if word in ("true", "false"):
            return F.lit(word == "true")
        if word == "nil":
            return F.lit(None).cast("string")
        if m := re.fullmatch(r"(\$\w*)((?:\.\w+)*)", word):
            if m[1] == "$":
                return self.of_row(m[2][1:], line)
            if m[1] not in scope.variables:
                raise TemplateError(f"undefined variable {m[1]}", line)
            return self.fields(scope.variables[m[1]], m[2], line)
        if word.startswith("."):
            if scope.dot is None:
                return self.of_row(word[1:], line)
            return scope.dot if word == "." else self.fields(scope.dot, word, line)
        raise TemplateError(f"function '{word}' not defined", line)

    def of_row(self, path: str, line: int) -> Any:
        if not path:
            raise TemplateError("the row itself has no text; name a field", line)
        kind: T.DataType | None = self.kinds
        for name in path.split("."):
            kind = child(kind, name)
        return Typed(self.data(path), kind)

    def fields(self, value: Any, path: str, line: int) -> Any:
        """``.a.b`` of a value."""
        for name in path.split(".")[1:]:
            if not isinstance(value, Typed):
                raise TemplateError(f"a value without fields has no .{name}", line)
            if isinstance(value.kind, (T.AtomicType, T.ArrayType)):
                raise TemplateError(f"a {value.kind.simpleString()} has no field .{name}", line)
            column = F.try_element_at(value.column, F.lit(name)) if isinstance(value.kind, T.MapType) else value.column[name]
            value = Typed(column, child(value.kind, name))
        return value


def child(kind: T.DataType | None, name: str) -> T.DataType | None:
    if isinstance(kind, T.StructType):
        return next((f.dataType for f in kind if f.name.lower() == name.lower()), None)
    return kind.valueType if isinstance(kind, T.MapType) else None


def compile_template(content: str, data: Callable[[str], Column] = F.col, clock: Column | None = None, kinds: T.StructType | None = None) -> Column:
    """The template as one text column. ``data`` gives the column of a field path, ``kinds`` the types of the row's fields (needed by ``range`` over maps and
    numbers and by ``len`` of lists)."""
    if not content.strip():
        raise TemplateError("content is empty")
    reader = Reader(content)
    nodes = reader.block(False)[0]
    return Compiler(data, F.current_timestamp() if clock is None else clock, kinds, reader.defined).block(nodes, Scope(None, {}))


def render(rows: DataFrame, content: str, clock: Column | None = None, name: str = "rendered") -> DataFrame:
    """Rows with the rendered text; columns are the template's fields."""
    return rows.withColumn(name, compile_template(content, lambda path: F.col(path), clock, rows.schema))


def load_templates(spark: SparkSession, directory: str, suffix: str = "*.md") -> DataFrame:
    """path, name and content of the templates of a directory."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).text(directory, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "")
    return files.select(path.alias("path"), paths.basename(path).alias("name"), F.col("value").alias("content"))


def load_template(spark: SparkSession, path: str) -> tuple[str, str]:
    """(name, content) of one template; an empty file is an error."""
    row = spark.read.text(path, wholetext=True).select("value").first()
    if row is None or not row[0].strip():
        raise TemplateError("content is empty")
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0], row[0]
