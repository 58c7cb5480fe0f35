"""Queries over lookups, links, tasks and classes that the other modules leave out."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import durations, paths, values
from tarn.operators import commands, links, lookups, tasks

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


DAY = datetime.date(1998, 6, 15)


# ---- lookups ----


@query("""
SELECT 'id' AS what, count(*) AS n FROM orders WHERE o_orderkey = 7 UNION ALL SELECT 'file', count(*) FROM orders WHERE o_orderkey = 7 AND o_orderstatus = 'F'
UNION ALL SELECT 'folder', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'class', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'prefix', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%' AND year(o_orderdate) IN (1995, 1996)
UNION ALL SELECT 'field', count(*) FROM orders WHERE o_totalprice > 100000 AND o_orderpriority LIKE '%LOW%' UNION ALL SELECT 'exists', (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0)
""")
def record_lookups(spark, sf_dir):
    key = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").select(
        key.cast("string").alias("id"), F.concat(F.lit("vault/"), "o_orderstatus", F.lit("/"), key.cast("string"), F.lit(".md")).alias("path"), F.col("o_orderpriority").alias("file_class"),
        F.year("o_orderdate").cast("string").alias("status"), F.col("o_totalprice").alias("total"), F.when(key % 3 != 0, key).alias("some"),
    )
    found = {
        "id": lookups.query(df, ("id", "=", "7")), "file": lookups.by_path(df, "vault/F/7.md"), "folder": lookups.by_path(df, "vault/F"), "class": lookups.query(df, ("file_class", "=", "1-urgent")),
        "prefix": lookups.by_class_prefix(df, "/F/", "1", ["1995", "1996"]), "field": lookups.query(df, ("total", ">", 100_000), ("file_class", "contains", "LOW")), "exists": lookups.query(df, ("some", "exists", True)),
    }
    return commands.union_all(*(d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("what"), "n") for k, d in found.items()))


@query("""
SELECT 0 AS nth, 'Null' AS name UNION ALL SELECT (row_number() OVER (ORDER BY lower(name)))::INTEGER, name FROM (SELECT min(n) AS name FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE p_brand END AS n FROM part) GROUP BY lower(n))
""")
def lookup_choices(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("brand"))
    return lookups.choices(df, "brand")


@query("""
SELECT c_custkey, coalesce(n, 0) AS count_all, most - least AS spread, early FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n, round(max(o_totalprice), 2) AS most, round(min(o_totalprice), 2) AS least, count(*) FILTER (WHERE o_orderdate < DATE '1995-01-01') AS early FROM orders GROUP BY 1) ON c_custkey = o_custkey
""")
def lookup_custom_summary(spark, sf_dir):
    related = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target"), F.round("o_totalprice", 2).alias("v"), "o_orderdate")
    early = F.count_if(F.col("o_orderdate") < F.lit(datetime.date(1995, 1, 1)))
    found = links.lookup_summary(table(spark, sf_dir, "customer").select("c_custkey"), related, "v", "c_custkey", more={"spread": F.max("v") - F.min("v"), "early": early})
    return found.select("c_custkey", "count_all", "spread", "early")


@query("SELECT count(*) AS records, count(*) FILTER (WHERE o_totalprice > 400000) AS warnings, true AS timed FROM orders")
def index_timing(spark, sf_dir):
    found = lookups.timed_statistics(table(spark, sf_dir, "orders"), F.col("o_totalprice") <= 400_000)
    return spark.createDataFrame([(found["records"], found["warnings"], 0 < found["seconds"] < 3600)], "records bigint, warnings bigint, timed boolean")


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'own' WHEN p_type LIKE 'STANDARD%' THEN 'standard' WHEN p_type LIKE '% STEEL' THEN 'steel' WHEN p_size > 25 THEN 'large' ELSE 'plain' END AS assigned_class FROM part
""")
def class_by_tag(spark, sf_dir):
    kind = F.split(F.col("p_type"), " ")
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_size") % 4 == 0, "own").alias("own"), F.transform(kind, lambda x: F.concat(F.lit("#kind/"), x)).alias("tags"))
    return lookups.assign_class(df, "own", "tags", {"#kind/STANDARD": "standard", "#kind/STEEL": "steel"}, [(F.col("p_size") > 25, "large")], "plain").select("p_partkey", "assigned_class")


# ---- links ----


@query("""
WITH e AS (SELECT ps.s_suppkey AS a, ps.s_nationkey AS b FROM supplier ps)
SELECT 'from' AS what, n_nationkey::BIGINT AS n FROM nation WHERE n_nationkey IN (SELECT b FROM e WHERE a = 5) UNION ALL SELECT 'to', a FROM e WHERE b = 3
""")
def linked_sections(spark, sf_dir):
    edges = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("n"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("path"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("n"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"))
    return commands.union_all(links.linked_from(nations, edges, "s5").select(F.lit("from").alias("what"), "n"), links.linking_to(suppliers, edges, "n3").select(F.lit("to").alias("what"), "n"))


@query("""
WITH e AS (SELECT n_nationkey AS a, n_regionkey + 100 AS b, CASE WHEN n_nationkey % 2 = 0 THEN '1' ELSE '2' END AS color, CASE WHEN n_nationkey % 3 = 0 THEN 'left' ELSE 'right' END AS side FROM nation)
SELECT 'out' AS way, a::BIGINT AS node, b::BIGINT AS neighbour FROM e UNION ALL SELECT 'in', b, a FROM e UNION ALL SELECT 'both', a, b FROM e WHERE color = '1' UNION ALL SELECT 'both', b, a FROM e WHERE color = '1'
UNION ALL SELECT 'label', a, b FROM e WHERE a < 5 UNION ALL SELECT 'side', a, b FROM e WHERE side = 'left'
""")
def canvas_edges(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    n, to = F.col("n_nationkey").cast("bigint"), (F.col("n_regionkey") + 100).cast("bigint")
    edges = df.select(n.alias("from_node"), to.alias("to_node"), F.when(n % 2 == 0, "1").otherwise("2").alias("color"), F.when(n < 5, "near").alias("label"), F.when(n % 3 == 0, "left").otherwise("right").alias("from_side"), F.lit("top").alias("to_side"))
    nodes = df.select(n.alias("id")).union(df.select(to).distinct())
    found = {
        "out": links.canvas_neighbours(nodes, edges, "out"), "in": links.canvas_neighbours(nodes, edges, "in"), "both": links.canvas_neighbours(nodes, edges, color="1"),
        "label": links.canvas_neighbours(nodes, edges, "out", label="near"), "side": links.canvas_neighbours(nodes, edges, "out", side="left"),
    }
    return commands.union_all(*(d.select(F.lit(k).alias("way"), "node", "neighbour") for k, d in found.items()))


# ---- days ----


@query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS e FROM events GROUP BY ALL)
SELECT a.user_id, a.day, b.e AS before FROM d a LEFT JOIN d b ON a.user_id = b.user_id AND a.day = b.day + 1
""")
def day_before(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("event_id").alias("e"))
    return commands.day_before(days, ["user_id"], "day", "e").select("user_id", "day", "before")


@query("""
SELECT o_orderpriority, sum(o_orderkey % 90)::BIGINT AS minutes, (sum(o_orderkey % 90) // 60) || 'h ' || (sum(o_orderkey % 90) % 60) || 'm' AS shown FROM orders GROUP BY 1
""")
def duration_sums(spark, sf_dir):
    spent = durations.duration(F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit(" min")))
    grouped = table(spark, sf_dir, "orders").select("o_orderpriority", spent.alias("d")).groupBy("o_orderpriority").agg((F.sum("d.micros") / (60 * durations.SECOND)).cast("bigint").alias("minutes"))
    total = durations.total(F.array(F.struct(F.lit(0).alias("months"), (F.col("minutes") * 60 * durations.SECOND).alias("micros"))))
    hours = durations.minutes_text(total["micros"] / (60 * durations.SECOND))
    return grouped.select("o_orderpriority", "minutes", F.when(hours.contains(" "), hours).otherwise(F.concat(hours, F.lit(" 0m"))).alias("shown"))


# ---- tasks ----


def order_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, day, key = F.col("o_orderpriority"), F.to_date("o_orderdate"), F.col("o_orderkey")
    again = F.when(key % 5 == 0, " 🔁 every week").otherwise("")
    due = F.when(key % 7 == 0, "").otherwise(F.concat(F.lit(" 📅 "), day.cast("string")))
    done = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" ✅ "), F.date_add(day, 2).cast("string"))).otherwise("")
    text = F.concat(F.lit("pay #"), F.lower(F.substring(p, 3, 3)), again, F.lit(" 🛫 "), F.date_sub(day, 10).cast("string"), F.lit(" [scheduled:: "), F.date_sub(day, 5).cast("string"), F.lit("]"), due, done)
    found = tasks.enrich(table(spark, sf_dir, "orders").select(key.alias("key"), text.alias("text"), (F.col("o_orderstatus") == "F").alias("completed"), F.lit(" ").alias("status")))
    return found


SQL_TASKS = """
WITH t AS (SELECT o_orderkey AS key, o_orderstatus = 'F' AS done, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS due, lower(substr(o_orderpriority, 3, 3)) AS tag, o_orderkey % 5 = 0 AS again FROM orders)
"""


@query(SQL_TASKS + "SELECT key, CASE WHEN again THEN 'every week' END AS recurrence, day - 10 AS start, day - 5 AS scheduled, due, CASE WHEN done THEN day + 2 END AS completion FROM t")
def task_recurrence(spark, sf_dir):
    return order_tasks(spark, sf_dir).select("key", "recurrence", "start", "scheduled", "due", "completion")


@query(SQL_TASKS + """
SELECT 'not done' AS filter, count(*) AS n FROM t WHERE NOT done UNION ALL SELECT 'done', count(*) FROM t WHERE done UNION ALL SELECT 'due before', count(*) FROM t WHERE due < DATE '1998-06-15'
UNION ALL SELECT 'due after', count(*) FROM t WHERE due > DATE '1998-06-15' UNION ALL SELECT 'due on', count(*) FROM t WHERE due = DATE '1998-06-15' UNION ALL SELECT 'no due date', count(*) FROM t WHERE due IS NULL
UNION ALL SELECT 'done on', count(*) FROM t WHERE done AND day + 2 = DATE '1995-06-15'
UNION ALL SELECT 'query due', count(*) FROM t WHERE tag IN ('urg', 'low') AND due BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' UNION ALL SELECT 'query done', count(*) FROM t WHERE done AND day + 2 >= DATE '1995-01-01'
UNION ALL SELECT 'query scheduled', count(*) FROM t WHERE tag = 'hig' AND day - 5 <= DATE '1995-01-01'
""")
def task_filters(spark, sf_dir):
    found = order_tasks(spark, sf_dir)
    days = {"due before": DAY, "due after": DAY, "due on": DAY, "done on": datetime.date(1995, 6, 15)}
    tests = {name: test(days[name]) if name in days else test() for name, test in tasks.FILTERS.items()}
    counts = {name: found.where(test) for name, test in tests.items()}
    counts["query due"] = tasks.task_query(found, ["urg", "low"], "due", datetime.date(1995, 1, 1), datetime.date(1995, 12, 31))
    counts["query done"] = tasks.task_query(found, None, "done", datetime.date(1995, 1, 1))
    counts["query scheduled"] = tasks.task_query(found, ["hig"], "scheduled", None, datetime.date(1995, 1, 1))
    return commands.union_all(*(d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("filter"), "n") for k, d in counts.items()))


@query("""
WITH d AS (SELECT p_partkey AS key, '1998-06-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') AS day, p_size AS s, p_name AS item FROM part)
SELECT day, string_agg(key || ': ' || item, ' · ' ORDER BY key) AS items, count(*) AS n FROM d WHERE day BETWEEN '1998-06-05' AND '1998-06-20' GROUP BY 1
""")
def section_lists(spark, sf_dir):
    """List items below one heading of each note, by the day in the note's name and within a range of days."""
    day = F.concat(F.lit("1998-06-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"))
    body = F.concat(F.lit("# Other\n- no\n# Log\n- "), F.col("p_name"))
    notes = table(spark, sf_dir, "part").select(F.concat(day, F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), body.alias("body"))
    found = tasks.items(notes).where("section = 'Log'")
    from tarn.functions import dates

    found = found.select(dates.file_day(paths.basename(F.col("path"))).alias("d"), F.regexp_extract("path", r" (\d+)\.md$", 1).cast("bigint").alias("key"), "text")
    found = found.where(F.col("d").between(datetime.date(1998, 6, 5), datetime.date(1998, 6, 20)))
    grouped = commands.group_rows(found, F.col("d").cast("string"), "day")
    lines = F.transform(F.array_sort(F.transform("rows", lambda r: F.struct(r["key"], r["text"]))), lambda r: F.concat(r["key"].cast("string"), F.lit(": "), r["text"]))
    return grouped.select("day", F.array_join(lines, " · ").alias("items"), F.size("rows").cast("bigint").alias("n"))


@query("""
SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g')) AS slug, 'part-' || p_partkey AS id, '[[' || p_name || '#top|' || p_brand || ']]' AS shown, p_size::VARCHAR || '.' AS cut FROM part
""")
def identifiers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    link = values.link(F.col("p_name"), F.col("p_brand"), subpath=F.lit("top"))
    return p.select("p_partkey", paths.slug(F.col("p_name")).alias("slug"), paths.note_id(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")), F.col("p_name")).alias("id"), values.link_text(link).alias("shown"),
        values.truncate(F.concat(F.col("p_size").cast("string"), F.lit(".")), 9).alias("cut"))
