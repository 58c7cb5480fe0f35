"""Header fields in query text: types by value, one order over all types, durations, aggregates out of rows, chains of links, names that nothing defines."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarn.functions import dynamic, durations, values
from tarn.plans.language import Engine, QueryError, read
from tarn.sources import notes

#: Values in the order of the language.
ORDERED = ["null", "[]", '[1,"x"]', "[2]", "false", "true", '"2021-02-03"', '"2021-02-03T04:05"', '"0 s"', '"1 month"', '"40 days"', '"1 yr"', '"[[A]]"', '"[[b|shown]]"', "-7", "0", "1", "2.5", "1e300", '{"k":1}', '{"k":2}', '""', '"B"', '"b"', '"é"']


@pytest.fixture(scope="module")
def values_(spark):
    rows = spark.createDataFrame(list(enumerate(ORDERED)), "n int, json string")
    return rows.select("n", dynamic.of_variant(F.parse_json("json")).alias("v"))


def test_order_over_all_types(values_):
    assert [r.n for r in values_.orderBy(dynamic.key(F.col("v")), "n").collect()] == list(range(len(ORDERED)))
    plan = values_.orderBy(dynamic.key(F.col("v")))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan
    a, b = values_.select(F.col("n").alias("a"), dynamic.key(F.col("v")).alias("ka")), values_.select(F.col("n").alias("b"), dynamic.key(F.col("v")).alias("kb"))
    for r in a.join(b, F.lit(True)).select("a", "b", *(dynamic.compare(op, F.col("ka"), F.col("kb")).alias(name) for op, name in (("<", "lt"), ("=", "eq"), (">=", "ge"), ("!=", "ne")))).collect():
        assert (r.lt, r.eq, r.ge, r.ne) == (r.a < r.b, r.a == r.b, r.a >= r.b, r.a != r.b), (ORDERED[r.a], ORDERED[r.b])


def test_types_by_form(values_):
    kinds = [r.kind for r in values_.select("v.kind").collect()]
    assert kinds == ["null"] + ["array"] * 3 + ["boolean"] * 2 + ["date"] * 2 + ["duration"] * 4 + ["link"] * 2 + ["number"] * 5 + ["object"] * 2 + ["string"] * 4
    assert [r[0] for r in values_.where("n in (2, 5, 6, 7, 9, 10, 13, 17, 19)").orderBy("n").select(dynamic.text(F.col("v"))).collect()] == [
        "1, x", "true", "2021-02-03", "2021-02-03T04:05:00", "1 month", "5 weeks, 5 days", "[[b|shown]]", "2.5", '{"k":1}'
    ]
    assert [r.n for r in values_.where(~dynamic.truthy(F.col("v"))).collect()] == [0, 1, 4, 15, 21]


@pytest.fixture(scope="module")
def engine(spark):
    made = [
        ("a.md", '{"Big Key": 1, "author": "x", "span": "2 months", "owner": "[[b]]", "list": [1, "2021-01-01"], "o": {"p": {"q": 7}}, "where": 5}', "Mood:: good\n[mood:: 3] and (Mood:: true)\n**Bold**:: \"a\", \"b\"\nn:: 1, 2"),
        ("b.md", '{"author": 5, "span": "3 h", "owner": "[[sub/c]]", "name": "bob"}', "plain"),
        ("sub/c.md", '{"author": "2024-05-06", "name": "cleo", "owner": "nobody"}', None),
        ("d.md", "{}", ""),
    ]
    rows = spark.createDataFrame(made, "path string, json string, body string").withColumn("fields", F.parse_json("json"))
    return Engine(rows.withColumn("metadata", notes.metadata(F.col("fields"), F.col("body"))).drop("json"), link_fields=("owner",))


@pytest.mark.parametrize("text, want", [
    ('LIST WITHOUT ID author WHERE author = "x"', ["x"]), ("LIST WITHOUT ID typeof(author)", ["date", "null", "number", "string"]), ("LIST WITHOUT ID author SORT author DESC LIMIT 2", ["5", "x"]),
    ("LIST WITHOUT ID big-key WHERE big-key", ["1"]), ('LIST WITHOUT ID row["Big Key"] + 1 WHERE row["Big Key"]', ["2"]), ('LIST WITHOUT ID row["where"] WHERE row["where"]', ["5"]), ("LIST WITHOUT ID file.frontmatter.author WHERE author > 4", ["5", "x"]),
    ("LIST WITHOUT ID o.p.q * 2 WHERE o", ["14"]), ('LIST WITHOUT ID o["p"]["q"] WHERE o', ["7"]), ("LIST WITHOUT ID mood WHERE mood", ["good, 3, true"]), ("LIST WITHOUT ID length(mood)", [0, 0, 0, 3]), ("LIST WITHOUT ID mood[1] + 1 WHERE mood", ["4"]),
    ("LIST WITHOUT ID bold[0] WHERE bold", ["a"]), ("LIST WITHOUT ID sum(n) WHERE n", ["3"]), ("LIST WITHOUT ID typeof(list[1]) WHERE list", ["date"]), ("LIST WITHOUT ID list[1].year WHERE list", ["2021"]), ("LIST WITHOUT ID m FLATTEN mood AS m WHERE m", ["3", "good", "true"]),
    ("LIST WITHOUT ID span + dur(1 day) WHERE span", ["1 day, 3 hours", "2 months, 1 day"]), ("LIST WITHOUT ID -span WHERE span > dur(50 days)", ["-2 months"]), ("LIST WITHOUT ID date(2024-01-31) - span WHERE span AND span < dur(1 day)", ["2024-01-30T21:00:00"]),
    ('LIST WITHOUT ID default(author, "none")', ["2024-05-06", "5", "none", "x"]), ('LIST WITHOUT ID choice(author, author, "no")', ["2024-05-06", "5", "no", "x"]), ('LIST WITHOUT ID upper(author) WHERE typeof(author) = "string"', ["X"]),
    ("LIST WITHOUT ID author WHERE author < 6", ["2024-05-06", "5", None]), ('LIST WITHOUT ID contains(list, 1) WHERE list', [True]), ("LIST WITHOUT ID string(max(list)) WHERE list", ["1"]), ("LIST WITHOUT ID join(sort(mood, \"desc\"), \"|\") WHERE mood", ["good|3|true"]),
    ("LIST WITHOUT ID owner.name WHERE owner.name", ["bob", "cleo"]), ("LIST WITHOUT ID owner.owner.name WHERE owner.owner.name", ["cleo"]), ("LIST WITHOUT ID [[b]].author LIMIT 1", ["5"]),
    ("LIST WITHOUT ID a.author SORT path LIMIT 1", [None]), ("LIST WITHOUT ID length(rows) GROUP BY typeof(author)", [1, 1, 1, 1]), ("LIST WITHOUT ID k GROUP BY author AS k", ["2024-05-06", "5", None, "x"]),
    ("LIST WITHOUT ID join(sort(map(rows, (r) => r.path)), \" \") GROUP BY length(mood) > 0 AS k", ["a.md", "b.md d.md sub/c.md"]),
])
def test_language_over_headers(engine, text, want):
    assert sorted((r[0] for r in engine.query(text).collect()), key=str) == sorted(want, key=str)


def test_names_that_nothing_defines_are_reported(engine, spark):
    assert engine.try_query("LIST autor")[1] == "unknown field autor"
    assert engine.try_query("LIST author + mood FLATTEN mood AS m WHERE m AND any(list, (x) => x = 1)")[1] is None
    plain = Engine(spark.createDataFrame([("a", True)], "path string, flag boolean"))
    assert plain.try_query("LIST nothing")[1] == "unknown field nothing"
    assert plain.try_query("LIST flag * dur(1 day)")[1] == "* is not defined for boolean and duration"
    assert plain.try_query("LIST sort(list(1), \"up\")")[1] == "sort goes asc or desc, not up"
    with pytest.raises(QueryError):
        plain.query("LIST flag + 1")


def test_a_path_is_taken_out_once(engine):
    plan = engine.query("LIST WITHOUT ID author WHERE author > 4 AND author < 9 SORT author")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count('$["author"]') == 1


def test_chain_has_one_join_a_hop(engine):
    plan = engine.query("LIST WITHOUT ID owner.owner.name + owner.name WHERE owner.author")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


def test_durations(spark):
    lit = lambda text: durations.duration(F.lit(text))
    row = spark.range(1).select(
        (durations.length(lit("1 month")) > durations.length(lit("40 days"))).alias("month"), (durations.length(lit("1 yr")) == durations.length(lit("365 d"))).alias("year"),
        durations.text(durations.times(lit("3 months"), F.lit(0.5))).alias("half"), durations.text(durations.add(lit("1 yr 2 h"), lit("1 mo 30 m"))).alias("sum"), durations.text(lit("0 s")).alias("zero"),
        durations.part(lit("400 days 5 h"), "weeks").alias("weeks"), durations.part(lit("400 days 5 h"), "hours").alias("hours"), durations.text(F.lit(None).cast("struct<months:int,micros:bigint>")).alias("none"),
    ).first()
    assert tuple(row) == (False, True, "1 month, 2 weeks, 1 day", "1 year, 1 month, 2 hours, 30 minutes", "0 seconds", 57, 5, None)


@pytest.fixture(scope="module")
def grouped(spark):
    rows = [(f"p{i}", "ab"[i % 2], [3, 1, None, 1, 2, 3][i], [2.0, None, 5.0, 1.0, 1.0, 7.0][i], "xyxzyx"[i], f"{i} h") for i in range(6)]
    df = spark.createDataFrame(rows, "path string, g string, n int, v double, w string, t string")
    return Engine(df.withColumn("d", durations.duration(F.col("t"))).withColumn("fields", F.parse_json(F.concat(F.lit('{"s": '), F.coalesce(F.col("n").cast("string"), F.lit('"x"')), F.lit("}")))))


FOLDED = [
    "minby(rows, (r) => r.n).path", "maxby(rows, (r) => r.n).path", "maxby(rows, (r) => r.w).path", "minby(filter(rows, (r) => r.v > 1), (r) => r.w).v", "length(filter(rows, (r) => r.n > 1))", "sum(map(rows, (r) => r.v * 2))",
    "sum(nonnull(rows.v))", "sum(map(filter(rows, (r) => r.n > 1), (r) => r.v))", "average(nonnull(rows.n))", "min(rows.n)", "max(map(rows, (r) => r.w))", "all(rows, (r) => r.n > 0)", "any(rows, (r) => r.w = \"z\")", "none(rows, (r) => r.n = 3)",
    "length(unique(rows.w))", "length(distinct(rows.n))", "length(filter(filter(rows, (r) => r.n), (r) => r.v))", "max(rows.d).hours", "sum(rows.d).micros", "string(min(rows.s))", "string(maxby(rows, (r) => r.s).s)", "sum(filter(rows, (r) => r.n > 9).v)",
]


@pytest.mark.parametrize("expression", FOLDED)
def test_aggregates_equal_the_list_form(grouped, expression):
    """The same expression with the list of rows at hand, from a query that must gather them."""
    direct = grouped.query(f"TABLE WITHOUT ID k, {expression} AS out GROUP BY g AS k")
    assert "collect_list" not in direct._jdf.queryExecution().optimizedPlan().toString()
    # `first(rows)` keeps the rows, and a name that a lambda catches keeps the expression from being folded
    listed = grouped.query(f"TABLE WITHOUT ID k, {expression.replace('rows', 'limit(rows, 99)')} AS out GROUP BY g AS k")
    assert "collect_list" in listed._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, direct.collect()), key=str) == sorted(map(tuple, listed.collect()), key=str)


def test_other_uses_of_rows_are_gathered_beside(grouped):
    found = grouped.query("TABLE WITHOUT ID k, length(rows) AS n, join(rows.path, \"+\") AS paths GROUP BY g AS k SORT sum(nonnull(rows.v)) DESC")
    assert [tuple(r) for r in found.collect()] == [("a", 3, "p0+p2+p4"), ("b", 3, "p1+p3+p5")]


def test_inline_values(spark):
    body = 'Basic Field:: Some random Value\n**Bold Field**:: Nice!\nI rate this a [rating:: 9]! It was [mood:: acceptable].\n(longKey:: key)\nNoël:: jeu\nx:: -80\ny:: "yes", "or", "no"\nz:: yes, or, no\nq:: "one"\nx:: true'
    row = spark.createDataFrame([(body,)], "body string").select(F.to_json(notes.metadata(F.parse_json(F.lit('{"rating": 8}')), F.col("body"))).alias("j")).first()
    import json

    found = json.loads(row.j)
    assert found["basic-field"] == "Some random Value" and found["bold-field"] == "Nice!" and found["rating"] == [8, 9] and found["longkey"] == "key" and found["noël"] == "jeu"
    assert found["x"] == [-80, True] and found["y"] == ["yes", "or", "no"] and found["z"] == "yes, or, no" and found["q"] == "one"


def test_headers_of_notes_without_any(spark):
    rows = spark.createDataFrame([("a", None, None)], "path string, json string, body string")
    found = rows.select("path", notes.metadata(F.parse_json("json"), F.col("body")).alias("metadata"))
    assert Engine(found).query("TABLE x, typeof(x) AS kind").collect()[0][1:] == (None, "null")


def test_queries_read_alike():
    assert read("LIST x").columns[0][1] == "x"


def test_keys_of_groups_are_computed_once_a_row(spark):
    """The sort below an aggregate evaluates an expression in each comparison; it must read a column."""
    rows = spark.createDataFrame([(i, f'{{"score": {j}, "big": {i % 2}}}') for i, j in enumerate(["2", '"b"', "-0.0", "0", "null"])], "key int, json string")
    engine = Engine(rows.select("key", F.parse_json("json").alias("fields")), ident="key", path="key")
    counts = engine.query("TABLE WITHOUT ID kind, length(distinct(rows.score)) AS n, min(rows.score) AS low GROUP BY typeof(score) AS kind")
    assert {r.kind: r.n for r in counts.collect()} == {"null": 1, "number": 2, "string": 1}
    sorts = [x for x in counts._jdf.queryExecution().executedPlan().toString().split("\n") if " Sort [" in x]
    assert sorts and not any("lambda" in x for x in sorts)


def test_rows_without_a_link_are_dealt_out(spark):
    """A join's null keys would all go to one task."""
    rows = spark.createDataFrame([(f"n{i}.md", f"N{i}", f"n{i % 2}" if i < 10 else None) for i in range(1000)], "path string, title string, target string")
    engine = Engine(rows.select("path", "title", values.link(F.col("target")).alias("up")))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = engine.query("TABLE WITHOUT ID title, up.title AS above, up.up.title AS top").withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.title, r.above, r.top) for r in found if r.above) == [(f"N{i}", f"N{i % 2}", f"N{i % 2 % 2}") for i in range(10)]
    assert len(found) == 1000 and max(Counter(r.part for r in found).values()) < 500


def test_inline_fields_are_read_once(spark):
    """An expression that is named several times is evaluated as often, and a list of one is copied and asked for its type in each row."""
    row = spark.createDataFrame([("a:: 1\n[b:: x, y] (c:: \"p\", \"q\")\n- A:: true",)], "body string")
    found = row.select(F.to_json(notes.metadata(F.parse_json(F.lit('{"a": 0}')), F.col("body"))).alias("j"))
    assert found.first().j == '{"A":true,"a":[0,1,true],"b":"x, y","c":["p","q"]}'
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract(") <= 6
    plan = row.select(dynamic.bind(F.length("body"), lambda n: n * n + n).alias("n"))
    assert "transform" not in plan._jdf.queryExecution().optimizedPlan().toString() and plan.first().n == 42 * 42 + 42
