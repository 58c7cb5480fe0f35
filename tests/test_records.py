"""Validation rules, schema algebra and definitions."""

import json

import pytest
from pyspark.sql import functions as F

from tarn.functions import layouts, numbers
from tarn.functions.patterns import PatternError, to_jvm
from tarn.operators import inheritance, records
from tarn.operators.definitions import Bank, Property, Schema, SchemaError, check_all, check_schema, follow, reference_name, resolve_all

EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"

# (property, JSON fields, reason or None)
CASES = [
    (Property("f"), '{"f": "Test Title"}', None),
    (Property("f"), '{"f": 123}', "must be a string"),
    (Property("f", enum=("draft", "published")), '{"f": "draft"}', None),
    (Property("f", enum=("draft", "published")), '{"f": "Draft"}', "must be one of: [draft published]"),
    (Property("f", pattern=EMAIL), '{"f": "test@example.com"}', None),
    (Property("f", pattern=EMAIL), '{"f": "invalid-email"}', f"must match pattern: {EMAIL}"),
    (Property("f", pattern="b+"), '{"f": "abc"}', None),
    (Property("f", pattern="^abc$"), '{"f": "abc\\n"}', "must match pattern: ^abc$"),
    (Property("f", "number"), '{"f": 42}', None),
    (Property("f", "number"), '{"f": 19.99}', None),
    (Property("f", "number"), '{"f": 1e3}', None),
    (Property("f", "number"), '{"f": "42"}', "must be a number"),
    (Property("f", "number", min=0), '{"f": 25}', None),
    (Property("f", "number", min=0), '{"f": -5}', "minimum value is 0"),
    (Property("f", "number", max=100), '{"f": 100}', None),
    (Property("f", "number", max=100), '{"f": 150}', "maximum value is 100"),
    (Property("f", "number", step=1), '{"f": 10}', None),
    (Property("f", "number", step=1), '{"f": 7.5}', "must be a multiple of 1"),
    (Property("f", "number", step=1), '{"f": -3}', None),
    (Property("f", "number", step=0.1), '{"f": 0.3}', "must be a multiple of 0.1"),
    (Property("f", "number", step=5, min=3), '{"f": 13}', None),
    (Property("f", "number", step=0), '{"f": 7.5}', None),
    (Property("f", "date"), '{"f": "2023-10-22T10:15:00Z"}', None),
    (Property("f", "date"), '{"f": "2023-10-22T10:15:00.123+02:00"}', None),
    (Property("f", "date"), '{"f": 123456789}', "must be a date string"),
    (Property("f", "date", format="2006-01-02"), '{"f": "2023-10-22"}', None),
    (Property("f", "date", format="2006-01-02"), '{"f": "10/22/2023"}', "must be a valid date in format: 2006-01-02"),
    (Property("f", "date", format="2006-01-02"), '{"f": "2023-1-9"}', "must be a valid date in format: 2006-01-02"),
    (Property("f", "date", format="2006-01-02"), '{"f": "2023-02-30"}', "must be a valid date in format: 2006-01-02"),
    (Property("f", "date", format="Mon, 02 Jan 2006"), '{"f": "Sun, 22 Oct 2023"}', None),
    (Property("f", "file"), '{"f": "docs/file.md"}', None),
    (Property("f", "file"), '{"f": ""}', "cannot be empty"),
    (Property("f", "file"), '{"f": 123}', "must be a file path"),
    (Property("f", "bool"), '{"f": false}', None),
    (Property("f", "bool"), '{"f": "yes"}', "must be a boolean"),
    (Property("f", required=True), "{}", "is required but missing"),
    (Property("f"), "{}", None),
    (Property("f", required=True), '{"f": null}', "must be a string"),
    (Property("f", array=True), "{}", None),
    (Property("f", array=True, required=True), '{"f": ["test"]}', None),
    (Property("f", array=True, required=True), '{"f": "single-tag"}', "must be an array"),
    (Property("f", array=True), '{"f": []}', None),
    (Property("f"), '{"f": ["a"]}', "must be a single value"),
    (Property("f"), '{"f": {"a": 1}}', "must be a string"),
]


@pytest.mark.parametrize("as_one", [False, True])
def test_rules(spark, as_one):
    if as_one:  # every case by its own schema, chosen by a column
        schemas = {f"s{i}": Schema(f"s{i}", (p,)) for i, (p, _, _) in enumerate(CASES)}
        df = spark.createDataFrame([(f"s{i}", t) for i, (_, t, _) in enumerate(CASES)], "name string, text string")
        rows = records.validate(df.withColumn("fields", F.parse_json("text")), schemas, "fields", schema_column="name").collect()
        got = {r.name: [v.reason for v in r.violations] for r in rows}
        assert got == {f"s{i}": [reason] if reason else [] for i, (_, _, reason) in enumerate(CASES)}
        return
    for prop, text, reason in CASES[::7]:
        row = records.validate(spark.createDataFrame([(text,)], "t string").withColumn("fields", F.parse_json("t")), {"s": Schema("s", (prop,))}, "fields", schema="s").first()
        assert [v.reason for v in row.violations] == ([reason] if reason else []) and row.valid == (reason is None)


def test_every_violation_is_reported(spark):
    schema = Schema("s", (Property("tags", array=True, enum=("a", "b")), Property("title", required=True), Property("age", "number", max=10)))
    df = spark.createDataFrame([('{"tags": ["a", "x", 3], "age": 11, "other": 1}',)], "t string").withColumn("fields", F.parse_json("t"))
    rows = records.violation_rows(records.validate(df, {"s": schema}, "fields", schema="s"), []).collect()
    assert {(r.field, r.reason, r.constraint) for r in rows} == {
        ("age", "maximum value is 10", "validation"), ("tags[1]", "must be one of: [a b]", "validation"), ("tags[2]", "must be a string", "validation"), ("title", "is required but missing", "required")
    }
    assert {r.message for r in rows if r.field in ("age", "title")} == {"field 'age': maximum value is 10 (value: 11)", "field 'title': is required but missing"}


def test_unknown_schema(spark):
    df = spark.createDataFrame([("s", "{}"), ("S", "{}"), (None, "{}")], "c string, t string").withColumn("fields", F.parse_json("t"))
    got = {r.c: [v.reason for v in r.violations] for r in records.validate(df, {"s": Schema("s")}, "fields", schema_column="c").collect()}
    assert got == {"s": [], "S": ["schema not found"], None: ["schema not found"]}


def test_typed_columns_and_unknown_keys(spark):
    df = spark.createDataFrame([(1.5, ["a"], None, True)], "n double, l array<string>, s string, b boolean")
    schema = Schema("s", (Property("n", "number", step=1), Property("l", array=True, enum=("b",)), Property("s", required=True), Property("b", "bool"), Property("gone", required=True)))
    row = records.validate(df, {"s": schema}, df.columns, schema="s").first()
    assert [(v.field, v.reason) for v in row.violations if v.field != "l[0]"] == [("gone", "is required but missing"), ("n", "must be a multiple of 1"), ("s", "is required but missing")]


def test_steps(spark):
    df = spark.createDataFrame([(0.3,), (-0.3,), (7.5,), (-7.5,), (0.0,)], "v double")
    got = df.select(numbers.step_from_min(F.col("v"), 0.1).alias("a"), numbers.step_mod(F.col("v"), 0.1).alias("b"), numbers.step_mod(F.col("v"), 1).alias("c")).collect()
    assert [tuple(r) for r in got] == [(False, True, False), (False, True, False), (True, True, False), (True, True, False), (True, True, True)]


def test_patterns():
    assert to_jvm("^a$") == r"^a\z" and to_jvm("[$]") == "[$]" and to_jvm("(?P<x>a)") == "(?<x>a)" and to_jvm("[[:alpha:]]") == r"[\p{Alpha}]"
    for bad in ("(?=a)", "(?<!a)", r"(a)\1", "[a", "a++", "(", "a\\"):
        with pytest.raises(PatternError):
            to_jvm(bad)


@pytest.mark.parametrize("layout, pattern", [("2006-01-02", "yyyy-MM-dd"), ("Jan 2, 2006 3:04PM", "MMM d, yyyy h:mma"), ("2006-01-02T15:04:05Z07:00", "yyyy-MM-dd'T'HH:mm:ssXXX"), ("15h04", "HH'h'mm")])
def test_layouts(layout, pattern):
    assert layouts.to_pattern(layout) == pattern


# ---- definitions ----


def test_reading_properties():
    p = Property.from_json("age", {"type": "number", "min": 0, "max": 150, "pattern": "ignored", "step": "no"})
    assert (p.min, p.max, p.step, p.pattern) == (0.0, 150.0, None, None)
    assert Property.from_json("s", {"type": "string", "enum": ["a", 1, "b"]}).enum == ("a", "b")
    assert Property.from_json("s", {"type": "string", "spec": {"pattern": "x"}}).pattern == "x"
    assert Property.from_json("k", {"name": "other", "type": "bool"}).name == "other"
    assert Property.from_json("r", {"$ref": "#/properties/x", "type": "nonsense"}).reference == "#/properties/x"
    for bad in ({}, {"type": "integer"}):
        with pytest.raises(ValueError):
            Property.from_json("x", bad)


def test_properties_round_trip():
    for p in (Property("a", enum=("x",), required=True), Property("n", "number", array=True, min=1, step=0.5), Property("d", "date", format="2006"), Property("f", "file", file_class="c", directory="d"), Property("b", "bool"), Property("r", reference="#/properties/x")):
        assert Property.from_json(p.name, json.loads(json.dumps(p.to_json()))) == p


def test_inheritance():
    note = Schema("note", (Property("title", required=True), Property("tags"), Property("created", "date")))
    meeting = Schema("meeting-note", (Property("agenda"), Property("tags", required=True)), extends="note", excludes=("created",))
    done = resolve_all([meeting, note])
    assert [(p.name, p.required) for p in done["meeting-note"].resolved] == [("title", True), ("tags", True), ("agenda", False)]
    again = Schema("again", (Property("created"),), extends="note", excludes=("created",))
    assert "created" not in [p.name for p in resolve_all([note, again])["again"].resolved]
    assert "created" in [p.name for p in resolve_all([note, again], excludes_first=True)["again"].resolved]
    chain = [Schema("root", (Property("r"),)), Schema("mid", (Property("m"),), extends="root", excludes=("r",)), Schema("leaf", (Property("l"),), extends="mid")]
    assert [p.name for p in resolve_all(chain)["leaf"].resolved] == ["m", "l"]


@pytest.mark.parametrize("schemas, text", [
    ([Schema("a", extends="b"), Schema("b", extends="a")], "a -> b -> a"), ([Schema("a", extends="a")], "a -> a"), ([Schema("a", extends="b"), Schema("b", extends="c"), Schema("c", extends="a")], "a -> b -> c -> a"),
    ([Schema("a", extends="gone")], "'gone' not found"), ([Schema("a"), Schema("a")], "duplicate"),
])
def test_inheritance_errors(schemas, text):
    with pytest.raises(SchemaError, match=text):
        resolve_all(schemas)


def test_scale_of_inheritance():
    assert len(resolve_all([Schema("base", (Property("a"), Property("b"))), *(Schema(f"c{i}", (Property(f"p{i}"),), extends="base") for i in range(99))])) == 100


def test_references():
    bank = Bank()
    bank.register(Property("common-email", required=True, pattern=EMAIL))
    bank.register(Property("alias", reference="x#/properties/common-email"))
    bank.register(Property("loop", reference="#/properties/loop"))
    assert follow(Property("mail", reference="bank.json#/properties/alias"), bank) == Property("mail", required=True, pattern=EMAIL)
    with pytest.raises(ValueError, match="loop -> loop"):
        follow(Property("x", reference="#/properties/loop"), bank)
    with pytest.raises(KeyError):
        follow(Property("x", reference="#/properties/gone"), bank)
    for bad in ("", " x", "alias"):
        with pytest.raises(ValueError):
            bank.register(Property(bad))
    with pytest.raises(ValueError):
        reference_name("no-name")


def test_structural_problems():
    bad = Schema("1x", (Property("a"), Property("a", pattern="(?=x)"), Property("n", "number", min=2, max=1, step=-1)), extends="1x", excludes=("b", " b", ""))
    reasons = " ".join(p.reason for p in check_schema(bad))
    for part in ("must start with a letter", "cannot extend itself", "duplicate exclude", "blank name", "duplicate property", "look-around", "min is greater", "step must be positive"):
        assert part in reasons
    assert [p.reason for p in check_all([Schema("a", (Property("r", reference="#/properties/z"),), extends="b")])] == ["parent schema 'b' not found", "no property 'z' in the bank"]


def test_table_form_agrees_with_driver_form(spark):
    schemas = [Schema("root", (Property("a"), Property("b"))), Schema("mid", (Property("b", "number"), Property("c")), extends="root", excludes=("a",)), Schema("leaf", (Property("a", "bool"), Property("d")), extends="mid", excludes=("c", "d"))]
    rows = [(s.name, p.name, p.type) for s in schemas for p in s.properties]
    got = inheritance.resolve(
        spark.createDataFrame([(s.name, s.extends) for s in schemas], "name string, extends string"), spark.createDataFrame(rows, "schema string, property string, definition string"),
        spark.createDataFrame([(s.name, x) for s in schemas for x in s.excludes], "schema string, property string"),
    ).collect()
    assert {(r.schema, r.property, r.definition) for r in got} == {(n, p.name, p.type) for n, s in resolve_all(schemas).items() for p in s.resolved}


def test_many_schemas_share_rule_sets(spark):
    same = Schema("x", (Property("a", "number", min=1), Property("b", required=True)))
    df = spark.createDataFrame([(f"s{i % 600}", '{"a": %d}' % (i % 3)) for i in range(60)], "name string, text string").withColumn("fields", F.parse_json("text"))
    one, many = (records.validate(df, {f"s{i}": same for i in range(n)}, "fields", schema_column="name") for n in (60, 500))
    size = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    rows = many.collect()
    assert [len(r.violations) for r in rows] == [1 + (i % 3 == 0) for i in range(60)] and [r.violations for r in rows] == [r.violations for r in one.collect()]
    assert size(many) < size(one) + 500 * 20  # names only
    # a property's VARIANT is looked up once for all rules
    assert many._jdf.queryExecution().optimizedPlan().toString().count("$['a']") <= 2
