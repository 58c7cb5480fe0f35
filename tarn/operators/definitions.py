"""Schemas and properties as values, and the rules that a definition itself must keep.

Definitions are few and describe data, so they live on the driver; what is checked against them are DataFrames.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

from tarn.functions.patterns import PatternError, to_jvm

TYPES = ("string", "number", "date", "file", "bool")
IDENTIFIER = re.compile(r"[a-zA-Z][a-zA-Z0-9_-]*")
REFERENCE = re.compile(r"[^#]*#/properties/(.*)", re.DOTALL)
MOST_REFERENCES = 10


class SchemaError(ValueError):
    def __init__(self, schema: str, reason: str):
        super().__init__(f"schema '{schema}': {reason}")
        self.schema, self.reason = schema, reason


@dataclass(frozen=True)
class Property:
    """One property. Options that don't belong to the type are ignored when it is read."""

    name: str
    type: str = "string"
    required: bool = False
    array: bool = False
    enum: tuple[str, ...] = ()
    pattern: str | None = None
    min: float | None = None
    max: float | None = None
    step: float | None = None
    format: str | None = None
    file_class: str | None = None
    directory: str | None = None
    reference: str | None = None

    @classmethod
    def from_json(cls, name: str, data: dict[str, Any]) -> Property:
        """Read flat options; a nested ``spec`` object is accepted too. ``$ref`` wins over a type."""
        name = data.get("name") or name
        shape = {"required": bool(data.get("required")), "array": bool(data.get("array"))}
        if data.get("$ref"):
            return cls(name, reference=data["$ref"], **shape)
        options = {**(data.get("spec") or {}), **data}
        kind = options.get("type")
        if not kind:
            raise ValueError(f"property '{name}': missing type")
        if kind not in TYPES:
            raise ValueError(f"property '{name}': unknown type '{kind}'")
        words = lambda k: options[k] if isinstance(options.get(k), str) and options[k] else None
        count = lambda k: float(options[k]) if isinstance(options.get(k), (int, float)) and not isinstance(options[k], bool) else None
        own: dict[str, Any] = {}
        if kind == "string":
            listed = options.get("enum")
            own = {"enum": tuple(x for x in listed if isinstance(x, str)) if isinstance(listed, list) else (), "pattern": words("pattern")}
        elif kind == "number":
            own = {k: count(k) for k in ("min", "max", "step")}
        elif kind == "date":
            own = {"format": words("format")}
        elif kind == "file":
            own = {"file_class": words("fileClass"), "directory": words("directory")}
        return cls(name, kind, **shape, **own)

    def to_json(self) -> dict[str, Any]:
        """Flat options, without those that are absent."""
        if self.reference:
            return {"name": self.name, "required": self.required, "array": self.array, "$ref": self.reference}
        own = {"enum": list(self.enum) or None, "pattern": self.pattern, "min": self.min, "max": self.max, "step": self.step, "format": self.format, "fileClass": self.file_class, "directory": self.directory}
        return {"name": self.name, "required": self.required, "array": self.array, "type": self.type} | {k: v for k, v in own.items() if v is not None}


@dataclass(frozen=True)
class Schema:
    name: str
    properties: tuple[Property, ...] = ()
    extends: str | None = None
    excludes: tuple[str, ...] = ()
    resolved: tuple[Property, ...] | None = None

    @classmethod
    def from_json(cls, data: dict[str, Any]) -> Schema:
        properties = tuple(Property.from_json(k, v) for k, v in sorted((data.get("properties") or {}).items()))
        return cls(data.get("name") or "", properties, data.get("extends") or None, tuple(data.get("excludes") or ()))

    @property
    def effective(self) -> tuple[Property, ...]:
        """Resolved properties; own ones only if nothing is resolved yet (an empty resolution stays empty)."""
        return self.properties if self.resolved is None else self.resolved


@dataclass(frozen=True)
class Problem:
    """Something wrong with a definition."""

    schema: str
    property: str
    reason: str


@dataclass
class Bank:
    """Shared property definitions by name."""

    properties: dict[str, Property] = field(default_factory=dict)
    location: str = "schemas/properties"

    def __post_init__(self) -> None:
        if not self.location.strip():
            raise ValueError("bank location cannot be empty")

    def register(self, prop: Property) -> None:
        if not prop.name.strip():
            raise ValueError("property name cannot be empty")
        if prop.name != prop.name.strip():
            raise ValueError(f"property name '{prop.name}' has outer blanks")
        if prop.name in self.properties:
            raise ValueError(f"property '{prop.name}' is already registered")
        self.properties[prop.name] = prop

    def lookup(self, reference: str) -> Property:
        name = reference_name(reference)
        if name not in self.properties:
            raise KeyError(f"no property '{name}' in the bank")
        return self.properties[name]


def reference_name(reference: str) -> str:
    match = REFERENCE.fullmatch(reference)
    if not match or not match[1]:
        raise ValueError(f"'{reference}' does not name a property")
    return match[1]


def check_property(schema: str, prop: Property) -> list[Problem]:
    found = []
    say = lambda reason: found.append(Problem(schema, prop.name, reason))
    name = prop.name.strip()
    if not name:
        say("cannot be empty")
    elif not IDENTIFIER.fullmatch(name):
        say("must start with a letter and hold letters, digits, '_' or '-' only")
    if prop.pattern is not None:
        try:
            to_jvm(prop.pattern)
        except PatternError as error:
            say(f"invalid pattern: {error}")
    if prop.min is not None and prop.max is not None and prop.min > prop.max:
        say("min is greater than max")
    if prop.step is not None and prop.step <= 0:
        say("step must be positive")
    for option in ("file_class", "directory"):
        value = getattr(prop, option)
        if value is not None:
            try:
                to_jvm(value.removeprefix("^"))
            except PatternError as error:
                say(f"invalid {option}: {error}")
    return found


def check_schema(schema: Schema) -> list[Problem]:
    """Every problem of one schema, nested ones included."""
    found = []
    say = lambda reason, prop="": found.append(Problem(schema.name, prop, reason))
    name = schema.name.strip()
    if not name:
        say("name cannot be empty")
    elif not IDENTIFIER.fullmatch(name):
        say("name must start with a letter and hold letters, digits, '_' or '-' only")
    if schema.extends is not None:
        if not schema.extends.strip():
            say("extends cannot be blank")
        elif schema.extends.strip() == name:
            say("cannot extend itself")
    seen: set[str] = set()
    for x in (e.strip() for e in schema.excludes):
        if not x:
            say("excludes cannot hold a blank name")
        elif not IDENTIFIER.fullmatch(x):
            say(f"invalid exclude name: {x}")
        elif x in seen:
            say(f"duplicate exclude property: {x}")
        seen.add(x)
    names: set[str] = set()
    for prop in schema.properties:
        if prop.name in names:
            say(f"duplicate property name: {prop.name}", prop.name)
        names.add(prop.name)
        found += check_property(schema.name, prop)
    return found


def check_all(schemas: list[Schema], bank: Bank | None = None) -> list[Problem]:
    """Problems of every schema, and of what they point to: duplicate names, missing parents, missing references."""
    found = [p for s in schemas for p in check_schema(s)]
    names = [s.name for s in schemas]
    found += [Problem(n, "", "duplicate schema name") for n in sorted({n for n in names if names.count(n) > 1})]
    for s in schemas:
        if s.extends and s.extends not in names:
            found.append(Problem(s.name, "", f"parent schema '{s.extends}' not found"))
        for p in s.properties:
            if p.reference:
                try:
                    follow(p, bank or Bank())
                except (KeyError, ValueError) as error:
                    found.append(Problem(s.name, p.name, str(error.args[0])))
    return found


def follow(prop: Property, bank: Bank) -> Property:
    """The property with its references replaced by what the bank holds; the name and the shape stated at the place of use are kept."""
    seen, target = [], prop
    while target.reference:
        name = reference_name(target.reference)
        if name in seen:
            raise ValueError("circular reference: " + " -> ".join([*seen, name]))
        if len(seen) == MOST_REFERENCES:
            raise ValueError(f"more than {MOST_REFERENCES} references in a row")
        seen.append(name)
        target = bank.lookup(target.reference)
    return replace(target, name=prop.name, required=prop.required or target.required, array=prop.array or target.array)


def resolve_all(schemas: list[Schema], bank: Bank | None = None, excludes_first: bool = False) -> dict[str, Schema]:
    """Schemas with inherited properties: a parent's definitions come first, an own definition replaces the inherited one in place, then
    excluded names go. ``excludes_first`` removes them before own definitions are merged, so a schema can declare an excluded name anew."""
    by_name: dict[str, Schema] = {}
    for s in schemas:
        if s.name in by_name:
            raise SchemaError(s.name, "duplicate schema name")
        by_name[s.name] = s
    done: dict[str, Schema] = {}

    def resolve(name: str, path: tuple[str, ...]) -> Schema:
        if name in done:
            return done[name]
        if name in path:
            raise SchemaError(name, "circular inheritance: " + " -> ".join([*path[path.index(name) :], name]))
        if name not in by_name:
            raise SchemaError(path[-1] if path else name, f"parent schema '{name}' not found")
        schema = by_name[name]
        merged = {p.name: p for p in resolve(schema.extends, (*path, name)).effective} if schema.extends else {}
        hidden = {x.strip() for x in schema.excludes if x.strip()}
        if excludes_first:
            merged = {k: v for k, v in merged.items() if k not in hidden}
        merged |= {p.name: follow(p, bank) if p.reference and bank else p for p in schema.properties}
        if not excludes_first:
            merged = {k: v for k, v in merged.items() if k not in hidden}
        done[name] = replace(schema, resolved=tuple(merged.values()))
        return done[name]

    for s in schemas:
        resolve(s.name, ())
    return done
