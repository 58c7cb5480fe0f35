"""The engine's queries over the driver's tables, with the SQL that each must agree with.

The tables hold no notes, so each operator runs on the nearest data: orders, parts and lines are records, events carry dynamic fields,
page urls are paths, links in pages are edges, labels index documents.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import dates, durations, numbers, paths, values
from tarn.operators import commands, inheritance, links, lookups, records, tasks
from tarn.operators.asof import as_of_join
from tarn.operators.definitions import Property, Schema, resolve_all
from tarn.plans.language import Engine
from tarn.plans.templates import render

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DAY = datetime.date(1998, 6, 15)
#: The types of events that have a schema.
EVENT_TYPES = ("click", "error", "signup", "view")


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- validation ----


def trade_schemas() -> dict[str, Schema]:
    """Schemas with inheritance: limits lie inside the data's ranges, so that rules fail."""
    base = Schema("record", (Property("status", enum=("F", "O"), required=True), Property("total", "number", min=10_000, max=400_000), Property("placed", "date", format="2006-01-02")))
    order = Schema("order", (Property("priority", pattern="^[1-3]-"), Property("total", "number", min=20_000, max=300_000)), extends="record")
    part = Schema("part", (Property("brand", pattern=r"^Brand#[1-3]\d$", required=True), Property("size", "number", min=1, max=40, step=3), Property("kind", required=True)), extends="record", excludes=("status", "total", "placed"))
    line = Schema("line", (Property("quantity", "number", min=0, step=5), Property("discount", "number", max=0.07), Property("flag", enum=("A", "N"))), extends="record", excludes=("status", "total", "placed"))
    return resolve_all([base, order, part, line])


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("o_orderpriority"))
    status = F.when(F.col("o_orderkey") % 13 == 0, F.lit(None)).otherwise(F.col("o_orderstatus"))
    placed = F.when(F.col("o_orderkey") % 17 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), F.col("o_totalprice").alias("total"), placed.alias("placed"), priority.alias("priority"))


@query("""
WITH o AS (
  SELECT CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS status, o_totalprice AS total,
         CASE WHEN o_orderkey % 17 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS placed,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders
), v AS (
  SELECT 'order' AS schema, 'status' AS field, CASE WHEN status IS NULL THEN 'is required but missing' WHEN status NOT IN ('F','O') THEN 'must be one of: [F O]' END AS reason FROM o
  UNION ALL SELECT 'order', 'total', CASE WHEN total < 20000 THEN 'minimum value is 20000' WHEN total > 300000 THEN 'maximum value is 300000' END FROM o
  UNION ALL SELECT 'order', 'placed', CASE WHEN NOT regexp_matches(placed, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'must be a valid date in format: 2006-01-02' END FROM o
  UNION ALL SELECT 'order', 'priority', CASE WHEN NOT regexp_matches(priority, '^[1-3]-') THEN 'must match pattern: ^[1-3]-' END FROM o
  UNION ALL SELECT 'part', 'brand', CASE WHEN p_brand IS NULL THEN 'is required but missing' WHEN NOT regexp_matches(p_brand, '^Brand#[1-3][0-9]$') THEN 'must match pattern: ^Brand#[1-3]\\d$' END FROM part
  UNION ALL SELECT 'part', 'size', CASE WHEN p_size < 1 THEN 'minimum value is 1' WHEN p_size > 40 THEN 'maximum value is 40' WHEN (p_size - 1) % 3 <> 0 THEN 'must be a multiple of 3' END FROM part
  UNION ALL SELECT 'part', 'kind', CASE WHEN p_type IS NULL THEN 'is required but missing' END FROM part
  UNION ALL SELECT 'line', 'quantity', CASE WHEN l_quantity < 0 THEN 'minimum value is 0' WHEN l_quantity % 5 <> 0 THEN 'must be a multiple of 5' END FROM lineitem
  UNION ALL SELECT 'line', 'discount', CASE WHEN l_discount > 0.07 THEN 'maximum value is 0.07' END FROM lineitem
  UNION ALL SELECT 'line', 'flag', CASE WHEN l_returnflag NOT IN ('A','N') THEN 'must be one of: [A N]' END FROM lineitem
) SELECT schema, field, reason, count(*) AS violations FROM v WHERE reason IS NOT NULL GROUP BY ALL
""".replace("\\\\d", "\\d"))
def record_validation_report(spark, sf_dir):
    schemas = trade_schemas()
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"))
    sources = {"order": order_records(spark, sf_dir).drop("o_orderkey"), "part": parts, "line": lines}
    reports = [records.report(records.validate(df, schemas, df.columns, schema=name).withColumn("schema", F.lit(name)), ["schema"]) for name, df in sources.items()]
    return commands.union_all(*reports)


@query("""
WITH o AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders
), v AS (
  SELECT o_orderkey, 'status' AS field, CASE WHEN status IS NULL THEN 'is required but missing' WHEN status NOT IN ('F','O') THEN 'must be one of: [F O]' END AS reason, CASE WHEN status IS NULL THEN 'required' ELSE 'validation' END AS "constraint", status AS value FROM o
  UNION ALL SELECT o_orderkey, 'priority', CASE WHEN NOT regexp_matches(priority, '^[1-3]-') THEN 'must match pattern: ^[1-3]-' END, 'validation', priority FROM o
) SELECT o_orderkey, field, reason, "constraint", value, 'field ''' || field || ''': ' || reason || CASE WHEN value IS NULL THEN '' ELSE ' (value: ' || value || ')' END AS message FROM v WHERE reason IS NOT NULL
""")
def record_violations(spark, sf_dir):
    df = order_records(spark, sf_dir).select("o_orderkey", "status", "priority")
    order = trade_schemas()["order"]
    checked = records.validate(df, {"order": Schema("order", tuple(p for p in order.effective if p.name in ("status", "priority")))}, ["status", "priority"], schema="order")
    return records.violation_rows(checked, ["o_orderkey"])


@query("""
WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
v AS (
  SELECT event_type, CASE event_id % 7 WHEN 0 THEN 'is required but missing' WHEN 1 THEN 'must be a number' WHEN 2 THEN 'must be a number' WHEN 3 THEN 'must be a single value'
    ELSE CASE WHEN k < 10 THEN 'minimum value is 10' WHEN k > 90 THEN 'maximum value is 90' WHEN (k - 10) % 5 <> 0 THEN 'must be a multiple of 5' END END AS reason FROM e
  WHERE event_type <> 'purchase'
  UNION ALL SELECT event_type, 'schema not found' FROM e WHERE event_type = 'purchase'
) SELECT event_type, reason, count(*) AS violations FROM v WHERE reason IS NOT NULL GROUP BY ALL
""")
def dynamic_field_validation(spark, sf_dir):
    spec = Schema("x", (Property("k", "number", required=True, min=10, max=90, step=5),))
    n = F.col("event_id") % 7
    text = F.when(n == 0, "{}").when(n == 1, '{"k": null}').when(n == 2, '{"k": "x"}').when(n == 3, '{"k": [1]}').otherwise(F.col("props"))
    df = table(spark, sf_dir, "events").select("event_type", F.parse_json(text).alias("fields"))
    checked = records.validate(df, {name: spec for name in EVENT_TYPES}, "fields", schema_column="event_type")
    return records.report(checked, ["event_type"]).drop("field")


@query("""
SELECT l_orderkey, l_linenumber, floor(l_quantity / 3) = l_quantity / 3 AS from_zero, floor((l_quantity - 1) / 3) = (l_quantity - 1) / 3 AS from_one,
       (l_quantity % 2.5) <= 1e-9 OR abs(l_quantity % 2.5 - 2.5) <= 1e-9 AS modulo
FROM lineitem
""")
def step_rules(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.step_from_min(q, 3).alias("from_zero"), numbers.step_from_min(q, 3, 1).alias("from_one"), numbers.step_mod(q, 2.5).alias("modulo"))


# ---- schema algebra ----

SCHEMA_ROWS = [("base", None), ("note", "base"), ("meeting", "note"), ("call", "meeting"), ("orphan", "nothing"), ("loop-a", "loop-b"), ("loop-b", "loop-a")]
PROPERTY_ROWS = [("base", "title", "string!"), ("base", "id", "number"), ("note", "tags", "string[]"), ("note", "created", "date"), ("meeting", "tags", "string[]!"), ("meeting", "agenda", "string"), ("call", "created", "date!"), ("orphan", "x", "bool"), ("loop-a", "y", "bool")]
EXCLUDE_ROWS = [("meeting", "created"), ("call", "id")]
SQL_SCHEMAS = """
WITH RECURSIVE s(name, extends) AS (VALUES ('base', NULL), ('note', 'base'), ('meeting', 'note'), ('call', 'meeting'), ('orphan', 'nothing'), ('loop-a', 'loop-b'), ('loop-b', 'loop-a')),
p(schema, property, definition) AS (VALUES ('base','title','string!'),('base','id','number'),('note','tags','string[]'),('note','created','date'),('meeting','tags','string[]!'),('meeting','agenda','string'),('call','created','date!'),('orphan','x','bool'),('loop-a','y','bool')),
x(schema, property) AS (VALUES ('meeting','created'),('call','id')),
up AS (SELECT name, name AS ancestor, 0 AS depth, [name] AS path, extends AS next FROM s
  UNION ALL SELECT up.name, s.name, up.depth + 1, list_append(up.path, s.name), s.extends FROM up JOIN s ON up.next = s.name WHERE NOT list_contains(up.path, s.name))
"""


def schema_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return spark.createDataFrame(SCHEMA_ROWS, "name string, extends string"), spark.createDataFrame(PROPERTY_ROWS, "schema string, property string, definition string"), spark.createDataFrame(EXCLUDE_ROWS, "schema string, property string")


@query(SQL_SCHEMAS + """
, near AS (SELECT up.name AS schema, p.property, p.definition, up.depth, row_number() OVER (PARTITION BY up.name, p.property ORDER BY up.depth) AS r FROM up JOIN p ON up.ancestor = p.schema),
hid AS (SELECT up.name AS schema, x.property, min(up.depth) AS hidden_at FROM up JOIN x ON up.ancestor = x.schema GROUP BY ALL)
SELECT near.schema, near.property, definition, depth FROM near LEFT JOIN hid ON near.schema = hid.schema AND near.property = hid.property WHERE r = 1 AND (hidden_at IS NULL OR hidden_at > depth)
""")
def schema_inheritance(spark, sf_dir):
    return inheritance.resolve(*schema_tables(spark))


@query(SQL_SCHEMAS + "SELECT name, ancestor, depth FROM up")
def schema_ancestors(spark, sf_dir):
    return inheritance.ancestors(schema_tables(spark)[0]).drop("path")


@query(SQL_SCHEMAS + "SELECT name, CASE name WHEN 'loop-a' THEN 'loop-a -> loop-b -> loop-a' ELSE 'loop-b -> loop-a -> loop-b' END AS cycle FROM up WHERE next IS NOT NULL AND list_contains(path, next)")
def schema_cycles(spark, sf_dir):
    return inheritance.cycles(schema_tables(spark)[0])


@query(SQL_SCHEMAS + "SELECT name, extends FROM s WHERE extends IS NOT NULL AND extends NOT IN (SELECT name FROM s)")
def schema_missing_parents(spark, sf_dir):
    return inheritance.missing_parents(schema_tables(spark)[0])


@query("""
SELECT r_name AS name, s AS schema, CASE WHEN r_name = 'ASIA' THEN 'shared-asia' WHEN r_name = 'EUROPE' THEN 'shared-europe' END AS definition
FROM region, (VALUES ('trade'), ('tax')) t(s)
""")
def reference_resolution(spark, sf_dir):
    props = table(spark, sf_dir, "region").select(F.explode(F.array(F.lit("trade"), F.lit("tax"))).alias("schema"), F.col("r_name").alias("property"), F.concat(F.lit("bank.json#/properties/"), F.col("r_name")).alias("ref"))
    bank = spark.createDataFrame([("ASIA", "shared-asia"), ("EUROPE", "shared-europe")], "name string, definition string")
    return inheritance.references(props, bank).select(F.col("target").alias("name"), "schema", "definition")


# ---- paths, filters, lookups ----


@query(r"""
WITH u AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS p FROM pages), n AS (SELECT page_id, p, regexp_extract(p, '([^/]*)/*$', 1) AS f FROM u)
SELECT page_id, regexp_replace(f, '\.[^.]*$', '') AS basename, regexp_extract(f, '(\.[^.]*)$', 1) AS extension, regexp_replace(p, '/*[^/]*$', '') AS folder FROM n
""")
def path_functions(spark, sf_dir):
    p = F.regexp_extract("url", "^[^?#]*", 0)
    return table(spark, sf_dir, "pages").select("page_id", paths.basename(p).alias("basename"), paths.extension(p).alias("extension"), paths.folder(p).alias("folder"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE lower(o_orderpriority) = '1-urgent' AND o_totalprice >= 300000 AND o_orderstatus IN ('F','P')")
def filter_query(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "fileClass")
    return lookups.query(df, ("fileClass", "=", "1-Urgent"), ("o_totalprice", ">=", 300_000), ("o_orderstatus", "in", ["F", "P"])).select("o_orderkey", "o_orderstatus", "o_totalprice")


def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return ids.select(F.concat(F.lit("labels/"), name, F.lit(".md")).alias("path"), name.alias("basename"), F.lit("labels").alias("folder"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("file_class"))


def document_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    value = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("[["), name, F.lit("|shown]]"))).otherwise(F.concat(F.lit("labels/"), name, F.lit(".md")))
    return table(spark, sf_dir, "documents").select("doc_id", value.alias("value"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '[[d' || doc_id || '|shown]]' ELSE 'labels/d' || doc_id || '.md' END AS value FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def file_reference(spark, sf_dir):
    return lookups.file_reference(document_references(spark, sf_dir), "value", label_index(spark, sf_dir), file_class="^bad", directory="lab")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def file_reference_missing(spark, sf_dir):
    return lookups.file_reference(document_references(spark, sf_dir), "value", label_index(spark, sf_dir), missing=True).select("doc_id")


@query("SELECT p_brand AS name, min(p_name) AS path FROM part GROUP BY 1")
def lookup_map(spark, sf_dir):
    return lookups.lookup_map(table(spark, sf_dir, "part"), "p_brand", "p_name")


@query("SELECT count(*) AS records, count(*) FILTER (WHERE o_totalprice > 400000) AS warnings FROM orders")
def index_statistics(spark, sf_dir):
    return lookups.index_statistics(table(spark, sf_dir, "orders"), F.col("o_totalprice") <= 400_000)


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderpriority LIKE '1-%' THEN 'urgent' WHEN o_totalprice > 200000 THEN 'large' ELSE 'plain' END AS assigned_class FROM orders
""")
def class_assignment(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("own", F.when(F.col("o_orderstatus") == "P", "pending"))
    rules = [(F.col("o_totalprice") > 200_000, "large"), (F.col("o_orderpriority").startswith("1-"), "urgent")]
    return lookups.assign_class(df, "own", None, {}, rules, "plain").select("o_orderkey", "assigned_class")


# ---- links ----


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("src"), targets.alias("dst"))


SQL_LINKS = "WITH e AS (SELECT page_id AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pages) "


@query(SQL_LINKS + "SELECT dst AS path, count(*) AS links, count(DISTINCT src) AS others FROM e GROUP BY 1")
def inlink_counts(spark, sf_dir):
    return links.degree(page_links(spark, sf_dir))


@query(SQL_LINKS + "SELECT src AS path, string_agg(dst, ' ' ORDER BY dst) AS outlinks FROM (SELECT DISTINCT src, dst FROM e) GROUP BY 1")
def outlinks(spark, sf_dir):
    return links.outlinks(page_links(spark, sf_dir)).select("path", F.array_join("outlinks", " ").alias("outlinks"))


@query(SQL_LINKS + ", p AS (SELECT page_id, '/' || regexp_extract(html, '<a href=\"/([^\"]*)\"', 1) AS path FROM pages) SELECT src, dst FROM e WHERE dst NOT IN (SELECT path FROM p)")
def unresolved_links(spark, sf_dir):
    notes = table(spark, sf_dir, "pages").select(F.concat(F.lit("/"), F.regexp_extract("html", '<a href="/([^"]*)"', 1)).alias("path"))
    return links.unresolved(page_links(spark, sf_dir), notes)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def unreferenced(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("dst"))
    return links.unreferenced(table(spark, sf_dir, "customer"), edges, "c_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, n_name AS c_nationkey_n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2")
def link_dereference(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_regionkey <> 2")
    return links.dereference(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", nations, ["n_name"], "n_nationkey").drop("c_nationkey")


@query("""
SELECT c_custkey, coalesce(count_all, 0) AS count_all, coalesce(c, 0) AS count, round(s, 2) AS sum, round(a, 7) AS average, mx AS max, mn AS min
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS count_all, count(v) AS c, sum(v) AS s, avg(v) AS a, max(v) AS mx, min(v) AS mn FROM (SELECT o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders) GROUP BY 1) ON c_custkey = o_custkey
""")
def lookup_summaries(spark, sf_dir):
    related = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("v"))
    found = links.lookup_summary(table(spark, sf_dir, "customer").select("c_custkey"), related, "v", "c_custkey")
    return found.select("c_custkey", "count_all", "count", F.round("sum", 2).alias("sum"), F.round("average", 7).alias("average"), "max", "min")


# ---- commands ----


@query("SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE trim(line) <> '') AS filled FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def flatten_lines(spark, sf_dir):
    lines = commands.flatten(table(spark, sf_dir, "documents").select("doc_id", "text"), F.split("text", "\n"), "line")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.trim("line") != "").alias("filled"))


@query("SELECT conv_id AS key, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS length FROM conversations GROUP BY 1")
def group_rows(spark, sf_dir):
    grouped = commands.group_rows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), F.col("conv_id"))
    return grouped.select("key", F.array_join("rows.role", ",").alias("roles"), F.size("rows").cast("bigint").alias("length"))


@query("SELECT p_brand, count(*) AS parts, round(sum(p_retailprice), 2) AS price FROM part GROUP BY 1 HAVING count(*) > 70")
def group_having(spark, sf_dir):
    grouped = commands.group_aggregate(table(spark, sf_dir, "part"), {"p_brand": F.col("p_brand")}, {"parts": F.count(F.lit(1)), "price": F.round(F.sum("p_retailprice"), 2)})
    return commands.where(grouped, F.col("parts") > 70)


@query("SELECT count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total, min(value) AS least, max(value) AS most FROM events")
def group_all(spark, sf_dir):
    return commands.group_aggregate(table(spark, sf_dir, "events"), None, {"events": F.count(F.lit(1)), "users": F.countDistinct("user_id"), "total": F.round(F.sum("value"), 2), "least": F.min("value"), "most": F.max("value")})


@query("SELECT status, count(*) AS years, max(n) AS most FROM (SELECT o_orderstatus AS status, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def group_twice(spark, sf_dir):
    first = commands.group_aggregate(table(spark, sf_dir, "orders"), {"status": F.col("o_orderstatus"), "y": F.year("o_orderdate")}, {"n": F.count(F.lit(1))})
    return commands.group_aggregate(first, {"status": F.col("status")}, {"years": F.count(F.lit(1)), "most": F.max("n")})


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_records(spark, sf_dir):
    return commands.limit(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 40) ORDER BY o_totalprice LIMIT 10")
def limit_before_sort(spark, sf_dir):
    from pyspark.sql.window import Window

    first = commands.limit(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 40, F.asc("o_orderkey"))
    ordered = first.withColumn("place", F.row_number().over(Window.orderBy("o_totalprice", "o_orderkey")).cast("bigint"))
    return commands.limit(commands.sort(ordered, (F.col("o_totalprice"), "asc")), 10, F.asc("o_totalprice"))


@query("""SELECT o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS rank, count(*) AS orders FROM orders GROUP BY ALL""")
def enum_rank(spark, sf_dir):
    grouped = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))
    ranked = grouped.withColumn("rank", commands.rank_by(F.col("o_orderpriority"), ["5-LOW", "1-URGENT", "3-MEDIUM"]))
    return commands.sort(ranked, (F.col("rank"), "asc"), (F.col("o_orderpriority"), "asc"))


@query("SELECT event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def previous_next(spark, sf_dir):
    return commands.previous_next(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_id").select("event_id", "previous", "next")


@query("SELECT event_id, ts FROM events WHERE ts < (SELECT ts FROM events WHERE event_id = 50) ORDER BY ts DESC LIMIT 1")
def previous_record(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    moment = events.where("event_id = 50").select("ts").scalar()  # a subquery of the plan
    return commands.as_of(events, "ts", moment)


SQL_MOMENTS = """
WITH e AS (SELECT event_id, event_type, user_id % 10 AS u, TIMESTAMP '1995-06-01' + to_days((event_id * 7919 % 1400)::INTEGER) + to_hours(event_id % 5) AS t FROM events),
o AS (SELECT o_orderkey, o_custkey % 10 AS u, o_orderdate AS t FROM orders)
"""


def moments(spark, sf_dir):
    """Events moved among the days of the orders, many at one moment, and orders, both by the last digit of their user."""
    n = F.col("event_id")
    moved = F.timestamp_micros(F.unix_micros(F.lit("1995-06-01 00:00:00").cast("timestamp")) + (n * 7919 % 1400 * 24 + n % 5) * F.lit(3_600_000_000)).cast("timestamp_ntz")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 10).alias("u"), moved.alias("happened"))
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("u"), F.col("o_orderdate").cast("timestamp_ntz").alias("t")), events


@query(SQL_MOMENTS + """
, last AS (SELECT t, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM e GROUP BY t)
SELECT o_orderkey, last.event_id, last.event_type FROM o ASOF LEFT JOIN last ON last.t < o.t
""")
def last_event_before(spark, sf_dir):
    orders, events = moments(spark, sf_dir)
    return as_of_join(orders, events, "t", "happened", values=("event_id", "event_type"), order=("event_id",)).select("o_orderkey", "event_id", "event_type")


@query(SQL_MOMENTS + """
, last AS (SELECT u, t, max(event_id) AS event_id FROM e GROUP BY u, t)
SELECT o_orderkey, last.event_id, last.t AS happened FROM o ASOF LEFT JOIN last ON o.u = last.u AND last.t <= o.t
""")
def last_event_of_user(spark, sf_dir):
    orders, events = moments(spark, sf_dir)
    return as_of_join(orders, events, "t", "happened", ("u",), values=("event_id", "happened"), order=("event_id",), strict=False).select("o_orderkey", "event_id", "happened")


SQL_RUNS = """
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d),
r AS (SELECT user_id, min(day) AS "start", max(day) AS "end", count(*) AS days FROM i GROUP BY user_id, island)
"""


@query(SQL_RUNS + 'SELECT user_id, "start", "end", days FROM r')
def day_runs(spark, sf_dir):
    return commands.day_runs(table(spark, sf_dir, "events"), ["user_id"], "ts")


@query(SQL_RUNS + 'SELECT user_id, "start", days, CAST(lead("start") OVER (PARTITION BY user_id ORDER BY "start") - "start" AS INTEGER) AS cycle_days FROM r')
def cycle_lengths(spark, sf_dir):
    return commands.cycle_lengths(commands.day_runs(table(spark, sf_dir, "events"), ["user_id"], "ts"), ["user_id"]).drop("end")


@query("SELECT year(o_orderdate) AS year, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def pivot_counts(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("bigint").alias("year"), F.lower("o_orderstatus").alias("status"))
    return commands.pivot_counts(df, "year", "status", ["f", "o", "p"])


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS rows FROM events GROUP BY 1")
def calendar(spark, sf_dir):
    return commands.calendar(table(spark, sf_dir, "events"), F.col("ts"))


@query("""
WITH g AS (SELECT p_brand AS brand, CAST(count(*) AS DOUBLE) AS parts, round(sum(p_retailprice), 2) AS price FROM part GROUP BY 1)
SELECT brand, parts, price, false AS is_total FROM g UNION ALL SELECT 'Total', sum(parts), round(sum(price), 2), true FROM g
""")
def total_row(spark, sf_dir):
    grouped = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("parts"), F.round(F.sum("p_retailprice"), 2).alias("price"))
    return commands.with_total(grouped, "brand").withColumn("price", F.round("price", 2))


@query("""
WITH g AS (SELECT p_brand AS brand, CAST(count(*) AS DOUBLE) AS parts FROM part GROUP BY 1)
SELECT brand, round(parts, 4) AS parts, false AS is_total FROM g UNION ALL SELECT 'Average', round(avg(parts), 4), true FROM g
""")
def average_row(spark, sf_dir):
    grouped = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("parts"))
    return commands.with_total(grouped, "brand", "Average", average=True).withColumn("parts", F.round("parts", 4))


@query("SELECT '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation")
def markdown_rows(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return df.select(commands.markdown_table(df).alias("line"))


@query("SELECT n_name AS name, 1 AS origin FROM nation UNION ALL SELECT r_name, 2 FROM region UNION ALL SELECT r_name, 3 FROM region")
def bag_union(spark, sf_dir):
    nations, regions = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit(1).alias("origin")), table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    return commands.union_all(nations, regions.withColumn("origin", F.lit(2)), regions.withColumn("origin", F.lit(3)))


@query("SELECT page_id, url FROM pages WHERE (url LIKE 'https://%/en/%' OR url LIKE '%.com/fr/%') AND NOT url LIKE '%?%'")
def source_algebra(spark, sf_dir):
    u = F.col("url")
    secure = commands.in_folder("https://", "url") & u.contains("/en/")
    return table(spark, sf_dir, "pages").where(commands.all_sources(commands.any_source(secure, u.contains(".com/fr/")), ~u.contains("?"))).select("page_id", "url")


@query("SELECT event_id, event_type FROM events WHERE value IS NOT NULL AND value <> 0 AND event_type <> '' AND user_id % 3 <> 0")
def truthiness(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return commands.where(commands.where(commands.where(df, F.col("value")), F.col("event_type")), F.col("user_id") % 3).select("event_id", "event_type")


# ---- tasks ----


@query("""
WITH t AS (SELECT o_orderkey, o_orderstatus = 'F' AS completed, CAST(o_orderdate AS DATE) AS due, CAST(o_orderdate AS DATE) - 10 AS start FROM orders), day AS (SELECT DATE '1998-06-15' AS d)
SELECT b AS bucket, count(*) AS tasks FROM (
  SELECT unnest(list_filter([CASE WHEN completed AND due = d THEN 'done' END, CASE WHEN NOT completed AND due = d THEN 'due' END, CASE WHEN NOT completed AND due < d THEN 'overdue' END,
    CASE WHEN NOT completed AND start = d THEN 'start' END, CASE WHEN NOT completed AND start < d AND due > d THEN 'process' END], lambda x: x IS NOT NULL)) AS b FROM t, day) GROUP BY 1
""")
def task_buckets(spark, sf_dir):
    due = F.to_date("o_orderdate")
    none = F.lit(None)
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("completed"), due.alias("due"), due.alias("completion"), F.date_sub(due, 10).alias("start"), none.cast("date").alias("scheduled"), none.cast("string").alias("recurrence"), F.lit(" ").alias("status"))
    return tasks.buckets(df, DAY).select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("tasks"))


@query("""
SELECT day, what, count(*) AS tasks FROM (
  SELECT CAST(o_orderdate AS DATE) AS day, 'due' AS what FROM orders UNION ALL SELECT CAST(o_orderdate AS DATE) + 3, 'completion' FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT CAST(o_orderdate AS DATE) - 10, 'start' FROM orders) GROUP BY ALL
""")
def task_timeline(spark, sf_dir):
    due = F.to_date("o_orderdate")
    df = table(spark, sf_dir, "orders").select(due.alias("due"), F.when(F.col("o_orderstatus") == "F", F.date_add(due, 3)).alias("completion"), F.date_sub(due, 10).alias("start"), F.lit(None).cast("date").alias("scheduled"))
    return tasks.timeline(df)


@query("""
WITH t AS (SELECT o_orderkey, 'pay ' || o_orderpriority || ' 📅 ' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderstatus = 'F' THEN ' ✅ ' || strftime(o_orderdate + INTERVAL 2 DAY, '%Y-%m-%d') ELSE '' END
  || CASE WHEN o_orderpriority LIKE '1-%' THEN ' ⏫' WHEN o_orderpriority LIKE '2-%' THEN ' 🔼' WHEN o_orderpriority LIKE '5-%' THEN ' 🔽' ELSE '' END AS text, o_orderdate, o_orderstatus, o_orderpriority FROM orders)
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS due, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate + INTERVAL 2 DAY AS DATE) END AS completion,
  CASE WHEN o_orderpriority LIKE '1-%' THEN 'A' WHEN o_orderpriority LIKE '2-%' THEN 'B' WHEN o_orderpriority LIKE '5-%' THEN 'D' ELSE 'C' END AS priority FROM t
""")
def task_marks(spark, sf_dir):
    p, day = F.col("o_orderpriority"), F.to_date("o_orderdate")
    mark = F.when(p.startswith("1-"), " ⏫").when(p.startswith("2-"), " 🔼").when(p.startswith("5-"), " 🔽").otherwise("")
    done = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" ✅ "), F.date_add(day, 2).cast("string"))).otherwise("")
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("pay "), p, F.lit(" 📅 "), day.cast("string"), done, mark).alias("text"))
    return tasks.enrich(df).select("o_orderkey", "due", "completion", "priority")


@query("SELECT o_orderpriority, round(count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0 / nullif(count(*), 0), 2) AS rate FROM orders GROUP BY 1")
def completion_rate(spark, sf_dir):
    grouped = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count(F.lit(1)).alias("due"))
    return grouped.select("o_orderpriority", tasks.completion_rate(F.col("done"), F.col("due")).alias("rate"))


# ---- functions ----


@query(r"""
SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, CASE WHEN length(p_name) >= 20 THEN p_name ELSE rpad(p_name, 20, '.') END AS padded, substr(p_name, 3, 4) AS middle,
  CASE WHEN length(p_name) > 12 THEN left(p_name, 9) || '...' ELSE p_name END AS cut, starts_with(p_brand, 'Brand#1') AS first, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits,
  TRY_CAST(regexp_extract(p_brand, '-?\d+(?:\.\d+)?') AS DOUBLE) AS number, replace(p_name, 'a', 'A') AS swapped, regexp_matches(p_type, 'STEEL|BRASS') AS metal
FROM part
""")
def text_functions(spark, sf_dir):
    n, b = F.col("p_name"), F.col("p_brand")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper(n).alias("up"), F.lower(b).alias("low"), values.pad(n, 20, ".", left=False).alias("padded"), values.substring(n, 2, 6).alias("middle"), values.truncate(n, 12).alias("cut"),
        F.startswith(b, F.lit("Brand#1")).alias("first"), values.regex_replace(b, "[^0-9]", "").alias("digits"), values.number(b).alias("number"), values.replace(n, F.lit("a"), F.lit("A")).alias("swapped"), values.regex_test("STEEL|BRASS", F.col("p_type")).alias("metal"),
    )


@query("""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS l FROM documents)
SELECT doc_id, len(l) AS n, array_to_string(list_sort(l), '|') AS sorted, array_to_string(list_reverse(l), '|') AS backwards, array_to_string(l[1:3], '|') AS head, list_contains(l, 'the') AS has_the,
  len(list_filter(l, lambda x: length(x) > 4)) AS long, array_to_string(list_transform(l, lambda x: length(x)), ' ') AS lengths FROM w
""")
def list_functions(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("l"))
    kind = df.schema["l"].dataType
    item = F.col("l")
    return df.select(
        "doc_id", F.size(item).cast("bigint").alias("n"), values.join(F.array_sort(item), "|").alias("sorted"), values.join(F.reverse(item), "|").alias("backwards"), values.join(F.slice(item, 1, 3), "|").alias("head"),
        values.contains(item, F.lit("the"), kind).alias("has_the"), F.size(F.filter(item, lambda x: F.length(x) > 4)).cast("bigint").alias("long"), values.join(values.each(item, F.length, True), " ").alias("lengths"),
    )


@query("""
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(isodow(o_orderdate) AS INTEGER) AS weekday, CAST(week(o_orderdate) AS INTEGER) AS week, strftime(o_orderdate, '%Y-%m-%d') AS iso,
  CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, CAST(last_day(o_orderdate) AS DATE) AS month_end, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS next_month FROM orders
""")
def date_functions(spark, sf_dir):
    d = F.col("o_orderdate").cast("timestamp")
    month = F.struct(F.lit(1).alias("months"), F.lit(0).cast("bigint").alias("micros"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.part(d, "year").alias("year"), dates.part(d, "weekday").alias("weekday"), dates.part(d, "week").alias("week"), dates.date_format(d, "yyyy-MM-dd").alias("iso"),
        F.to_date(dates.keyword("sow", d)).alias("monday"), F.to_date(dates.keyword("eom", d)).alias("month_end"), F.to_date(durations.plus(d, month)).alias("next_month"),
    )


@query("""
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) % 12 AS months, CAST(((CAST(l_quantity AS BIGINT) * 3600 + l_linenumber * 60) * 1000000) AS BIGINT) AS micros,
  CASE WHEN CAST(l_quantity AS BIGINT) // 60 = 0 THEN (CAST(l_quantity AS BIGINT) % 60) || 'm' ELSE 'x' END AS shown FROM lineitem
""")
def duration_functions(spark, sf_dir):
    q = F.col("l_quantity").cast("bigint").cast("string")
    text = F.concat((F.col("l_quantity").cast("bigint") % 12).cast("string"), F.lit(" months, "), q, F.lit("h "), F.col("l_linenumber").cast("string"), F.lit(" min"))
    d = durations.duration(text)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", d["months"].cast("bigint").alias("months"), d["micros"].alias("micros"), durations.minutes_text(F.col("l_quantity")).alias("shown"))


@query("SELECT p_partkey, '# ' || p_name || chr(10) || 'BRAND: ' || upper(p_brand) || CASE WHEN p_size > 25 THEN ' (large)' ELSE ' (small)' END || chr(10) || '2024-01-15' AS rendered FROM part")
def template_rendering(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    text = '# {{ .title }}\nBRAND: {{ .brand | toUpper }}{{ if gt .size 25 }} (large){{ else }} (small){{ end }}\n{{ now "2006-01-02" }}'
    return render(df, text, F.lit(datetime.datetime(2024, 1, 15, 12))).select("p_partkey", "rendered")


@query("""
WITH l AS (
  SELECT l_orderkey AS k, count(*) AS n, min(l_linenumber) AS first,
         string_agg(l_linenumber || ':' || l_quantity::BIGINT || CASE WHEN l_returnflag = 'R' THEN ' (BACK ' || o_orderkey || ')' ELSE '' END, ', ' ORDER BY l_linenumber, l_quantity, l_returnflag = 'R') AS lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey
)
SELECT o_orderkey, '# ' || o_orderkey || chr(10) || coalesce(lines, 'none') || chr(10) || CASE WHEN coalesce(n, 0) > 4 THEN 'many' WHEN coalesce(n, 0) = 0 THEN 'empty' ELSE 'few' END || ' of ' || coalesce(n, 0)
       || ' ' || coalesce(first || '', '<no value>') || ' -- ' || lower(o_orderpriority) || ' of ' || o_custkey || ' 012' AS rendered
FROM orders LEFT JOIN l ON o_orderkey = k
""")
def template_blocks(spark, sf_dir):
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("bigint").alias("quantity"), F.when(F.col("l_returnflag") == "R", "back").alias("note"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    df = orders.select("o_orderkey", F.col("o_orderkey").alias("key"), F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)).alias("lines"), F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("by")).alias("head"))
    text = """{{- define "foot" }}-- {{ toLower .priority }} of {{ .by }}{{ end -}}
# {{ .key }}
{{ range $i, $l := .lines }}{{ if $i }}, {{ end }}{{ .line }}:{{ $l.quantity }}{{ with .note }} ({{ . | toUpper }} {{ $.key }}){{ end }}{{ else }}none{{ end }}
{{ $n := len .lines }}{{ if gt $n 4 }}many{{ else if eq $n 0 }}empty{{ else }}few{{ end }} of {{ $n }} {{ (index .lines 0).line }} {{ template "foot" .head }} {{ range 3 }}{{ . }}{{ end }}"""
    return render(df, text).select("o_orderkey", "rendered")


# ---- query language ----


def order_notes(spark: SparkSession, sf_dir: str) -> Engine:
    df = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("orders/"), F.col("o_orderstatus"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), F.array(F.concat(F.lit("#prio/"), F.substring("o_orderpriority", 1, 1))).alias("tags"),
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").cast("timestamp").alias("day"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"),
    )
    return Engine(df, clock=F.lit(datetime.datetime(1998, 6, 15)).cast("timestamp"))


@query("SELECT o_orderkey AS key, round(o_totalprice, 1) AS total, CASE WHEN o_totalprice > 450000 THEN 'top' ELSE 'high' END AS band FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1-%' AND o_totalprice > 400000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def language_table(spark, sf_dir):
    return order_notes(spark, sf_dir).query('TABLE WITHOUT ID key, round(total, 1) AS total, choice(total > 450000, "top", "high") AS band FROM #prio/1 and "orders/F" WHERE total > 400000 SORT total DESC, key LIMIT 20')


@query("SELECT o_orderpriority AS p, count(*) AS n, round(sum(o_totalprice), 2) AS s, max(o_totalprice) AS top FROM orders WHERE o_orderdate < DATE '1998-06-15' GROUP BY 1 HAVING count(*) > 10")
def language_group(spark, sf_dir):
    return order_notes(spark, sf_dir).query("TABLE WITHOUT ID p, length(rows) AS n, round(sum(rows.total), 2) AS s, max(rows.total) AS top WHERE day < date(today) GROUP BY priority AS p WHERE length(rows) > 10")


@query("SELECT o_custkey AS customer, string_agg(o_orderkey::VARCHAR, ', ' ORDER BY o_orderkey) AS keys FROM orders WHERE o_totalprice > 300000 GROUP BY 1")
def language_rows(spark, sf_dir):
    return order_notes(spark, sf_dir).query('TABLE WITHOUT ID customer, join(sort(map(rows.key, (k) => k))) AS keys WHERE total > 300000 GROUP BY customer')


@query("SELECT o_orderkey AS key, part FROM (SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS part, o_totalprice FROM orders WHERE o_totalprice > 490000) WHERE length(part) > 1")
def language_flatten(spark, sf_dir):
    return order_notes(spark, sf_dir).query('TABLE WITHOUT ID key, part WHERE total > 490000 FLATTEN split(priority, "-") AS part WHERE length(part) > 1')


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS rows FROM orders WHERE NOT o_orderstatus = 'P' GROUP BY 1")
def language_calendar(spark, sf_dir):
    return order_notes(spark, sf_dir).query('CALENDAR day FROM -"orders/P"')


@query(SQL_LINKS + "SELECT page_id FROM pages WHERE page_id IN (SELECT src FROM e WHERE dst = '/the') AND url LIKE 'https://%'")
def language_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("path"), "url")
    return Engine(pages, links=page_links(spark, sf_dir)).query('LIST WITHOUT ID page_id FROM [[/the]] WHERE startswith(url, "https://")').select("page_id")


def _add_other_modules() -> None:
    from tarn import definition_queries, file_queries, header_queries, language_queries, lookup_queries, note_queries

    for module in (note_queries, language_queries, header_queries, definition_queries, lookup_queries, file_queries):
        QUERIES.update(module.QUERIES)
        ORACLES.update(module.ORACLES)


_add_other_modules()
