"""Validation of records against their schemas: one scan, no join, no shuffle.

Schemas are known on the driver, so each different one becomes a Column expression: an array of violations, empty if the record is valid. A record's
fields are either typed columns or one VARIANT; both offer the same view (:class:`Value`) to the rules. All violations are reported; within one
field the first failing rule counts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.layouts import RFC3339, parse
from tarn.functions.numbers import step_from_min, step_mod
from tarn.functions.patterns import to_jvm
from tarn.operators.definitions import Property, Schema

VIOLATION = "struct<field: string, reason: string, constraint: string, value: string>"


@dataclass(frozen=True)
class Value:
    """What the rules need to know of a value: is the key there, is it null, of which kind is it, and its forms."""

    present: Column
    null: Column
    string: Column
    number: Column
    boolean: Column
    array: Column
    text: Column
    as_number: Column
    elements: Column | None = None
    element: Callable[[Column], Value] | None = None

    @classmethod
    def of_value(cls, value: Column, kind: Column | None = None) -> Value:
        kind = F.schema_of_variant(value) if kind is None else kind
        is_array = kind.startswith("ARRAY")
        return cls(
            present=value.isNotNull(), null=F.coalesce(F.is_variant_null(value), F.lit(False)), string=kind == "STRING",
            number=kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), boolean=kind == "BOOLEAN", array=is_array,
            text=F.try_variant_get(value, "$", "string"), as_number=F.try_variant_get(value, "$", "double"),
            elements=F.try_variant_get(value, "$", "array<variant>"), element=cls.of_value,
        )

    @classmethod
    def of_column(cls, column: Column, kind: T.DataType) -> Value:
        """A typed column; null means that the key is absent."""
        number, yes, no = isinstance(kind, T.NumericType), F.lit(True), F.lit(False)
        return cls(
            present=column.isNotNull(), null=no, string=yes if isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)) else no,
            number=yes if number else no, boolean=yes if isinstance(kind, T.BooleanType) else no, array=yes if isinstance(kind, T.ArrayType) else no,
            text=F.to_json(column) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else column.cast("string"),
            as_number=column.cast("double") if number else F.lit(None).cast("double"), elements=column if isinstance(kind, T.ArrayType) else None,
            element=(lambda x: cls.of_column(x, kind.elementType)) if isinstance(kind, T.ArrayType) else None,
        )


def number_text(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def rules(prop: Property, v: Value, modulo_steps: bool = False) -> list[tuple[Column, str]]:
    """(failing condition, reason) in the order in which they are tried, after shape and presence."""
    if prop.type == "string":
        out = [(~v.string, "must be a string")]
        if prop.enum:
            out.append((~v.text.isin(*prop.enum), "must be one of: [" + " ".join(prop.enum) + "]"))
        if prop.pattern is not None:
            out.append((~F.regexp_like(v.text, F.lit(to_jvm(prop.pattern))), f"must match pattern: {prop.pattern}"))
        return out
    if prop.type == "number":
        out = [(~v.number, "must be a number")]
        if prop.min is not None:
            out.append((v.as_number < prop.min, f"minimum value is {number_text(prop.min)}"))
        if prop.max is not None:
            out.append((v.as_number > prop.max, f"maximum value is {number_text(prop.max)}"))
        if prop.step is not None:
            fits = step_mod(v.as_number, prop.step) if modulo_steps else step_from_min(v.as_number, prop.step, prop.min)
            out.append((~fits, f"must be a multiple of {number_text(prop.step)}"))
        return out
    if prop.type == "date":
        layout = prop.format or RFC3339
        return [(~v.string, "must be a date string"), (parse(v.text, layout).isNull(), f"must be a valid date in format: {layout}")]
    if prop.type == "file":
        return [(~v.string, "must be a file path"), (v.text == "", "cannot be empty")]
    return [(~v.boolean, "must be a boolean")]


def violation(field: Column | str, reason: str, constraint: str, value: Column | None) -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    return F.struct(field.alias("field"), F.lit(reason).alias("reason"), F.lit(constraint).alias("constraint"), (F.lit(None).cast("string") if value is None else value).alias("value"))


def first_failing(prop: Property, v: Value, field: Column | str, modulo_steps: bool) -> Column:
    """Violation of the first failing rule, else null. A null value is of no kind, so it fails the type rule."""
    case = None
    for i, (fails, reason) in enumerate(rules(prop, v, modulo_steps)):
        fails = (v.null | F.coalesce(fails, F.lit(True))) if i == 0 else F.coalesce(fails, F.lit(True))
        hit = violation(field, reason, "validation", v.text)
        case = F.when(fails, hit) if case is None else case.when(fails, hit)
    return case


def violations_of(prop: Property, v: Value, modulo_steps: bool = False) -> Column:
    """Array of the violations of one property."""
    nothing = F.array().cast(f"array<{VIOLATION}>")
    missing = F.array(violation(prop.name, "is required but missing", "required", None)) if prop.required else nothing
    if prop.array:
        if v.elements is None:
            shaped = F.array(violation(prop.name, "must be an array", "array", v.text))
        else:
            checked = F.transform(v.elements, lambda x, i: first_failing(prop, v.element(x), F.concat(F.lit(prop.name + "["), i.cast("string"), F.lit("]")), modulo_steps))
            shaped = F.when(v.array, F.filter(checked, lambda x: x.isNotNull())).otherwise(F.array(violation(prop.name, "must be an array", "array", v.text)))
    else:
        single = F.array_compact(F.array(first_failing(prop, v, prop.name, modulo_steps)))
        shaped = F.when(v.array, F.array(violation(prop.name, "must be a single value", "array", v.text))).otherwise(single)
    return F.when(~v.present, missing).otherwise(shaped)


def schema_violations(schema: Schema, values: Mapping[str, Value], modulo_steps: bool = False) -> Column:
    """Array of all violations of a record by the schema's resolved properties, sorted by property name."""
    absent = Value.of_column(F.lit(None).cast("string"), T.StringType())
    parts = [violations_of(p, values.get(p.name, absent), modulo_steps) for p in sorted(schema.effective, key=lambda p: p.name)]
    return F.concat(*parts) if parts else F.array().cast(f"array<{VIOLATION}>")


def validate(records: DataFrame, schemas: Mapping[str, Schema], fields: str | list[str], schema_column: str | None = None, schema: str | None = None, modulo_steps: bool = False) -> DataFrame:
    """Adds ``violations`` (array) and ``valid``. Fields are a VARIANT column, or a list of typed columns. The schema is fixed, or named by a
    column, matched exactly; an unknown name is itself a violation."""
    groups: dict[tuple[Property, ...], list[str]] = {}
    for key in [schema] if schema is not None else sorted(schemas):  # schemas that agree share one rule set, whatever their number
        groups.setdefault(schemas[key].effective, []).append(key)
    if isinstance(fields, str):
        base, source = extracted(records, fields, sorted({p.name for own in groups for p in own}))
    else:
        base, source = records, {c: Value.of_column(F.col(c), records.schema[c].dataType) for c in fields}
    if schema is not None:
        found = schema_violations(schemas[schema], source, modulo_steps)
    else:
        name = F.col(schema_column)
        unknown = F.array(F.struct(F.lit("fileClass").alias("field"), F.lit("schema not found").alias("reason"), F.lit("schema").alias("constraint"), name.cast("string").alias("value")))
        case = None
        for keys in groups.values():
            own = schema_violations(schemas[keys[0]], source, modulo_steps)
            case = F.when(name.isin(keys), own) if case is None else case.when(name.isin(keys), own)
        found = unknown if case is None else case.otherwise(unknown)
    checked = base.withColumn("violations", found).drop(*(c for c in base.columns if c not in records.columns))
    return checked.withColumn("valid", F.size("violations") == 0)


def extracted(records: DataFrame, fields: str, names: list[str]) -> tuple[DataFrame, dict[str, Value]]:
    """The records with what the rules need of each property in a column of its own, and these as values: each property is taken out of its VARIANT
    once, however many rules and schemas look at it."""
    path = lambda name: "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
    taken = records.select("*", *(F.variant_get(F.col(fields), path(n), "variant").alias(f"__value{i}") for i, n in enumerate(names)))
    kinds = taken.select("*", *(F.schema_of_variant(f"__value{i}").alias(f"__kind{i}") for i in range(len(names))))
    return kinds, {n: Value.of_value(F.col(f"__value{i}"), F.col(f"__kind{i}")) for i, n in enumerate(names)}


def violation_rows(validated: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each violation, with its message."""
    rows = validated.select(*keep, F.explode("violations").alias("v")).select(*keep, "v.*")
    return rows.withColumn("message", message(F.col("field"), F.col("reason"), F.col("value")))


def message(field: Column, reason: Column, value: Column) -> Column:
    return F.concat(F.lit("field '"), field, F.lit("': "), reason, F.coalesce(F.concat(F.lit(" (value: "), value, F.lit(")")), F.lit("")))


def report(validated: DataFrame, by: list[str]) -> DataFrame:
    """How often each rule fails."""
    rows = validated.select(*by, F.explode("violations").alias("v"))
    return rows.groupBy(*by, F.col("v.field").alias("field"), F.col("v.reason").alias("reason")).agg(F.count(F.lit(1)).alias("violations"))
