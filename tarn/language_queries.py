"""Queries in the note query language: functions, literals, file fields, linked notes, groups, tasks and results as Markdown."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import values
from tarn.operators import commands, tasks
from tarn.plans.language import Engine, QueryError

QUERIES = {}
ORACLES = {}


def query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clock():
    return F.lit(datetime.datetime(1998, 6, 15, 13, 45)).cast("timestamp")


def part_notes(spark: SparkSession, sf_dir: str) -> Engine:
    df = table(spark, sf_dir, "part").select(
        F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("odd"),
    )
    return Engine(df, clock=clock())


def dated_orders(spark: SparkSession, sf_dir: str) -> Engine:
    day = F.to_date("o_orderdate")
    df = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("orders/"), F.col("o_orderstatus"), F.lit("/"), day.cast("string"), F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"),
        F.array(F.concat(F.lit("#prio/p"), F.substring("o_orderpriority", 1, 1)), F.lit("#order")).alias("tags"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("total"),
        F.col("o_orderdate").cast("timestamp").alias("day"), F.col("o_orderpriority").alias("priority"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 30 hours")).alias("mod_time"),
    )
    return Engine(df, clock=clock(), this={"path": "daily/1997-03-04 log.md", "limit": 200_000})


# ---- file fields, literals, dates ----


@query("""
SELECT o_orderkey AS key, strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderkey AS name, 'orders/' || o_orderstatus AS folder, 'md' AS ext, strftime(o_orderdate, '%Y-%m-%d') AS day,
       '#order|#prio|#prio/p' || left(o_orderpriority, 1) AS tags, 2 AS etags, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS changed,
       'orders/' || o_orderstatus || '/' || strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderkey || '.md' AS target
FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '2-%'
""")
def language_file_fields(spark, sf_dir):
    return dated_orders(spark, sf_dir).query(
        'TABLE WITHOUT ID key, file.name AS name, file.folder AS folder, file.ext AS ext, dateformat(file.day, "yyyy-MM-dd") AS day, join(file.tags, "|") AS tags, length(file.etags) AS etags, '
        'dateformat(file.mday, "yyyy-MM-dd") AS changed, file.link.path AS target FROM "orders/F" AND #prio/p2'
    )


@query("""
SELECT o_orderkey AS key, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS before, strftime(o_orderdate + INTERVAL 3 MONTH + INTERVAL 2 DAY, '%Y-%m-%d') AS later, '1 hours' AS spelled
FROM orders WHERE o_orderdate >= DATE '1996-01-31' AND o_orderdate < DATE '1997-02-01' AND o_totalprice > 200000
""")
def language_literals(spark, sf_dir):
    return dated_orders(spark, sf_dir).query(
        'TABLE WITHOUT ID key, dateformat(day - dur(1 day), "yyyy-MM-dd") AS before, dateformat(day + dur(3 months, 2 days), "yyyy-MM-dd") AS later, choice(dur(1h) = dur("60 min"), "1 hours", "no") AS spelled '
        'WHERE day >= date(1996-01-31) AND day < date(1997-02) AND total > this.limit'
    )


@query("""
SELECT o_orderkey AS key, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d, isodow(o_orderdate)::INTEGER AS weekday, week(o_orderdate)::INTEGER AS week,
       strftime(o_orderdate, '%d.%m.%y') AS short, '1998-06-15 00:00' AS today, '1998-06-14' AS yesterday, '1998-06-30' AS eom, '1998-06-15 15:45' AS there,
       '2024-02-29' AS given, true AS none, 'date' AS kind, o_orderdate < DATE '1997-03-04' AS earlier
FROM orders
""")
def language_dates(spark, sf_dir):
    return dated_orders(spark, sf_dir).query(
        'TABLE WITHOUT ID key, day.year AS y, day.month AS m, day.day AS d, day.weekday AS weekday, day.week AS week, dateformat(day, "dd.MM.yy") AS short, dateformat(striptime(date(now)), "yyyy-MM-dd HH:mm") AS today, '
        'dateformat(date(yesterday), "yyyy-MM-dd") AS yesterday, dateformat(date(eom), "yyyy-MM-dd") AS eom, dateformat(localtime(date(now), "Europe/Berlin"), "yyyy-MM-dd HH:mm") AS there, '
        'dateformat(date("2024-02-29"), "yyyy-MM-dd") AS given, date("no date") = null AS none, typeof(day) AS kind, day < this.file.day AS earlier'
    )


# ---- functions ----


@query(r"""
SELECT p_partkey AS key, contains(p_name, 'a') AS c1, contains(lower(p_brand), 'brand#1') AS c2, p_brand = 'Brand#11' AS c3, regexp_matches(p_type, '(?i)\bsteel\b') AS c4,
       p_partkey::VARCHAR AS text, 'number' AS k1, 'string' AS k2, 'boolean' AS k3, 'array' AS k4, 'object' AS k5, 'duration' AS k6, 'link' AS k7,
       regexp_full_match(p_brand, 'Brand#[0-9]+') AS whole, regexp_replace(p_brand, '#([0-9])([0-9])', '#\2\1', 'g') AS turned, ends_with(p_type, 'L') AS l, split_part(p_type, ' ', 1) AS first,
       regexp_replace(p_brand, '#.*', '') || '|#|' || substr(p_brand, 7) AS parts, length(p_name)::INTEGER AS n, substr(p_name, 4) AS tail, lpad(p_size::VARCHAR, 6, '0') AS padded,
       coalesce(CASE WHEN p_size % 3 <> 0 THEN p_size END, -1) AS filled, CASE WHEN p_size % 3 <> 0 THEN 'has' ELSE 'none' END AS chosen, p_size + 0.5::DOUBLE AS number
FROM part
""")
def language_text(spark, sf_dir):
    return part_notes(spark, sf_dir).query(
        'TABLE WITHOUT ID key, contains(name, "a") AS c1, icontains(brand, "brand#1") AS c2, econtains(list(brand, "x"), "Brand#11") AS c3, containsword(kind, "steel") AS c4, string(key) AS text, '
        'typeof(size) AS k1, typeof(name) AS k2, typeof(true) AS k3, typeof(list(1)) AS k4, typeof(object("a", 1)) AS k5, typeof(dur(1 day)) AS k6, typeof([[x]]) AS k7, '
        'regexmatch("Brand#[0-9]+", brand) AS whole, regexreplace(brand, "#([0-9])([0-9])", "#$2$1") AS turned, endswith(kind, "L") AS l, split(kind, " ", 1)[0] AS first, '
        'join(split(brand, "(#)"), "|") AS parts, length(name) AS n, substring(name, 3) AS tail, padleft(string(size), 6, "0") AS padded, ldefault(odd, -1) AS filled, '
        'choice(odd, "has", "none") AS chosen, number(string(size) + ".5 kg") AS number'
    )


@query("""
WITH l AS (SELECT p_partkey AS key, p_size AS s, [p_size, 7, p_size + 2] AS a FROM part)
SELECT key, list_sum(a)::DOUBLE AS total, (a[1] * a[2] * a[3])::DOUBLE AS product, round(list_sum(a) / 3.0::DOUBLE, 6) AS average, list_min(a) AS low, list_max(a) AS high, least(s, 9) AS low2, greatest(s, 9) AS high2,
       CASE WHEN abs(a[1] - 20) <= abs(a[2] - 20) AND abs(a[1] - 20) <= abs(a[3] - 20) THEN a[1] WHEN abs(a[2] - 20) <= abs(a[3] - 20) THEN a[2] ELSE a[3] END AS near,
       CASE WHEN abs(a[1] - 20) >= abs(a[2] - 20) AND abs(a[1] - 20) >= abs(a[3] - 20) THEN a[1] WHEN abs(a[2] - 20) >= abs(a[3] - 20) THEN a[2] ELSE a[3] END AS far,
       (s + 2) || ',7,' || s AS backwards, array_to_string(list_sort(a), ',') AS ordered, array_to_string(list_reverse_sort(a), ',') AS falling, s > 5 AS all_over, s < 10 OR s + 2 < 10 AS any_below, s <> 30 AND s <> 28 AS none_is,
       len(list_filter(a, lambda x: x > 10))::INTEGER AS over, array_to_string(list_transform(a, lambda x: x * 2), ',') AS doubled, s % 3 <> 0 AS kept
FROM l
""")
def language_lists(spark, sf_dir):
    return part_notes(spark, sf_dir).query(
        "TABLE WITHOUT ID key, sum(list(size, 7, size + 2)) AS total, product(list(size, 7, size + 2)) AS product, round(average(list(size, 7, size + 2)), 6) AS average, min(list(size, 7, size + 2)) AS low, "
        "max(list(size, 7, size + 2)) AS high, min(size, 9) AS low2, max(size, 9) AS high2, minby(list(size, 7, size + 2), (x) => choice(x > 20, x - 20, 20 - x)) AS near, "
        "maxby(list(size, 7, size + 2), (x) => choice(x > 20, x - 20, 20 - x)) AS far, join(reverse(list(size, 7, size + 2)), \",\") AS backwards, join(sort(list(size, 7, size + 2)), \",\") AS ordered, "
        "join(sort(list(size, 7, size + 2), (x) => 0 - x), \",\") AS falling, all(list(size, 7, size + 2), (x) => x > 5) AS all_over, any(list(size, size + 2), (x) => x < 10) AS any_below, "
        "none(list(size, size + 2), (x) => x = 30) AS none_is, length(filter(list(size, 7, size + 2), (x) => x > 10)) AS over, join(map(list(size, 7, size + 2), (x) => x * 2), \",\") AS doubled, "
        "length(nonnull(list(odd))) = 1 AS kept"
    )


@query("""
WITH l AS (SELECT p_partkey AS key, string_split(p_type, ' ') AS w, string_split(p_type, ' ') || ['X', 'y', 'x'] AS a FROM part)
SELECT key, array_to_string(a[2:], '|') AS s1, array_to_string(a[2:3], '|') AS s2, array_to_string(a[-2:], '|') AS s3, a[1] AS first, a[-1] AS last, len(w) AS at, -1::BIGINT AS nowhere, 'y' AS found, (len(w) + 1)::INTEGER AS place,
       (len(w) + 2)::INTEGER AS folded, array_to_string(a[:2], '|') AS two, len(w) > 0 AS every, len(list_filter(w, lambda x: x = 'STEEL')) > 0 AS some, array_to_string(list_transform(w, lambda x: x || '|' || lower(x)), '|') AS flat
FROM l
""")
def language_list_places(spark, sf_dir):
    a = 'flat(list(split(kind, " "), list("X", "y", "x")))'
    return part_notes(spark, sf_dir).query(
        f'TABLE WITHOUT ID key, join(slice({a}, 1), "|") AS s1, join(slice({a}, 1, 3), "|") AS s2, join(slice({a}, -2), "|") AS s3, first({a}) AS first, last({a}) AS last, indexof({a}, "X") AS at, indexof({a}, "none") AS nowhere, '
        f'find({a}, (x) => x = "y") AS found, findindex({a}, (x) => x = "y") AS place, length(distinct({a}, (x) => lower(x))) AS folded, join(limit({a}, 2), "|") AS two, every(split(kind, " "), (x) => length(x) > 0) AS every, '
        'some(split(kind, " "), (x) => x = "STEEL") AS some, join(flatmap(split(kind, " "), (x) => list(x, lower(x))), "|") AS flat'
    )


@query("""
SELECT p_partkey AS key, p_size AS a, p_brand AS b, 'file' AS kind, p_name AS shown, false AS embedded, true AS embed, 'top' AS part, '[' || p_name || '](http://x/' || p_partkey || ')' AS outer, p_partkey || '' AS path,
       (p_size * 60 + 5)::BIGINT AS minutes, 'Brand#' AS start
FROM part
""")
def language_objects(spark, sf_dir):
    engine = part_notes(spark, sf_dir)
    engine.notes = engine.notes.withColumn("header", values.link(F.lit("x"), subpath=F.lit("top"))).withColumn("times", F.array(F.concat("size", F.lit(" h")), F.lit("5 min")))
    found = engine.query(
        'TABLE WITHOUT ID key, object("a", size, "b", brand).a AS a, extract(object("a", size, "b", brand), "b").b AS b, meta(link(string(key), name)).type AS kind, meta(link(string(key), name)).display AS shown, '
        'meta(link(string(key))).embed AS embedded, meta(embed(link("x"))).embed AS embed, meta(header).subpath AS part, elink("http://x/" + string(key), name) AS outer, link(string(key)).path AS path, '
        'sum(map(times, (t) => dur(t))).micros / 60000000 AS minutes, object("k", "Brand#")["k"] AS start'
    )
    return found.withColumn("minutes", F.col("minutes").cast("bigint"))


# ---- groups ----


@query("""
SELECT p_brand AS brand, round(avg(p_size), 6) AS mean, max(p_size) - min(p_size) AS spread, round(sum(ln(p_size)), 4) AS logs, arg_min(p_partkey, lpad(p_size::VARCHAR, 3, '0') || p_partkey || '.md') AS least, count(DISTINCT p_type) AS kinds
FROM part GROUP BY 1 ORDER BY mean DESC
""")
def language_group_values(spark, sf_dir):
    engine = part_notes(spark, sf_dir)
    engine.notes = engine.notes.withColumn("log", F.ln("size"))  # the product itself leaves the range of doubles from some hundred parts on
    direct = engine.query("TABLE WITHOUT ID brand, average(rows.size) AS mean, max(rows.size) - min(rows.size) AS spread, sum(rows.log) AS logs GROUP BY brand SORT average(rows.size) DESC")
    listed = engine.query("TABLE WITHOUT ID brand AS b, minby(rows, (r) => r.size).key AS least, length(distinct(rows.kind)) AS kinds GROUP BY brand")
    joined = direct.join(listed, F.col("brand") == F.col("b")).drop("b")
    return joined.select("brand", F.round("mean", 6).alias("mean"), "spread", F.round("logs", 4).alias("logs"), "least", F.col("kinds").cast("bigint").alias("kinds"))


# ---- linked notes ----


def customer_notes(spark: SparkSession, sf_dir: str) -> Engine:
    """Customers and nations as notes of one vault; a customer's ``nation`` is a link."""
    none = F.lit(None).cast("string")
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("nations/"), "n_name", F.lit(".md")).alias("path"), F.col("n_name").alias("title"), F.col("n_regionkey").alias("region"), values.link(none).alias("nation"), F.lit("nation").alias("type"))
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    own = table(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey"))
    people = own.select(F.concat(F.lit("people/"), "c_name", F.lit(".md")).alias("path"), F.col("c_name").alias("title"), F.lit(None).cast(nations.schema["region"].dataType).alias("region"), values.link(F.concat(F.lit("nations/"), "n_name", F.lit(".md"))).alias("nation"), F.lit("person").alias("type"))
    return Engine(people.union(nations), clock=clock(), this={"path": "nations/FRANCE.md"})


@query("""
SELECT c_name AS title, n_name AS country, n_regionkey::BIGINT AS region, (SELECT n_regionkey::BIGINT FROM nation WHERE n_name = 'JAPAN') AS japan, n_name = 'FRANCE' AS here, 'FRANCE' AS name
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 3
""")
def language_linked(spark, sf_dir):
    found = customer_notes(spark, sf_dir).query('TABLE WITHOUT ID title, nation.title AS country, nation.region AS region, [[JAPAN]].region AS japan, nation.path = this.path AS here, this.file.name AS name WHERE type = "person" AND nation.region < 3')
    return found.withColumn("region", F.col("region").cast("bigint")).withColumn("japan", F.col("japan").cast("bigint"))


# ---- tasks and Markdown ----


def task_engine(spark: SparkSession, sf_dir: str) -> Engine:
    n = F.col("p_size")
    mark = lambda test: F.when(test, "x").otherwise(" ")
    body = F.concat(F.lit("- ["), mark(n % 2 == 0), F.lit("] top\n  - ["), mark(n % 3 == 0), F.lit("] child\n    - plain\n- [ ] alone"))
    notes = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), body.alias("body"))
    return Engine(tasks.items(notes))


@query("""
SELECT path, line FROM (SELECT p_partkey::VARCHAR AS path, p_size AS n, unnest([0, 1, 2]) AS line FROM part) WHERE n % 2 = 0 OR (n % 3 = 0 AND line > 0)
""")
def language_task(spark, sf_dir):
    return task_engine(spark, sf_dir).query("TASK WHERE completed").select("path", "line")


@query("""
WITH l AS (SELECT p_size AS n, unnest(['- [' || CASE WHEN p_size % 2 = 0 THEN 'x' ELSE ' ' END || '] top', '  - [' || CASE WHEN p_size % 3 = 0 THEN 'x' ELSE ' ' END || '] child', '    - plain']) AS line FROM part WHERE p_size % 2 = 0)
SELECT 'task' AS form, line, count(*) AS n FROM l GROUP BY ALL
UNION ALL SELECT 'list', '- ' || n_name || ': ' || n_regionkey, 1 FROM nation
UNION ALL SELECT 'table', '| ' || n_name || ' | ' || n_regionkey || ' |', 1 FROM nation
UNION ALL SELECT 'table', unnest(['| name | region |', '| --- | --- |']), 1
""")
def language_markdown(spark, sf_dir):
    nations = Engine(table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.col("n_regionkey").alias("region")))
    top = task_engine(spark, sf_dir).markdown('TASK WHERE completed AND text = "top"').withColumn("form", F.lit("task"))
    listed = nations.markdown("LIST region").withColumn("form", F.lit("list"))
    rows = nations.markdown('TABLE WITHOUT ID path AS name, region').withColumn("form", F.lit("table"))
    head = spark.createDataFrame([(line, "table") for line in commands.markdown_head(["name", "region"])], "line string, form string")
    return commands.union_all(top, listed, rows, head).groupBy("form", "line").agg(F.count(F.lit(1)).alias("n"))


# ---- one value, errors, scripts ----


@query("""
SELECT 'value' AS what, (SELECT min(p_partkey) * 2 FROM part)::VARCHAR AS got UNION ALL SELECT 'good', (SELECT count(*) FROM part WHERE p_size > 10)::VARCHAR
UNION ALL SELECT 'bad', 'unknown query type SHOW' UNION ALL SELECT 'field', 'unknown field file.nothing' UNION ALL SELECT 'two', 'LIST takes one expression' UNION ALL SELECT 'view', (SELECT count(*) FROM part WHERE p_brand = 'Brand#11')::VARCHAR
UNION ALL SELECT 'no view', 'unknown view other'
""")
def language_results(spark, sf_dir):
    engine = part_notes(spark, sf_dir)
    engine.views["by-brand"] = lambda e, given: e.notes.where(F.col("brand") == given)
    out = [("value", str(engine.value("key * 2", engine.notes.orderBy("key")).first()[0]))]
    for name, text in (("good", "LIST WHERE size > 10"), ("bad", "SHOW x"), ("field", "LIST file.nothing"), ("two", "LIST a, b")):
        found, error = engine.try_query(text)
        out.append((name, error if found is None else str(found.count())))
    out.append(("view", str(engine.view("by-brand", "Brand#11").count())))
    try:
        engine.view("other")
    except QueryError as error:
        out.append(("no view", str(error)))
    return spark.createDataFrame(out, "what string, got string")
