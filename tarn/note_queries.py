"""Queries over notes whose bodies are made from the tables' columns, so that SQL can state the expected rows from the columns themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import values
from tarn.operators import commands, links, tasks
from tarn.sources import notes

QUERIES = {}
ORACLES = {}


def query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return register


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def text(*pieces: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces))


@query("SELECT p_partkey AS path, 'size' AS name, p_size::VARCHAR AS value FROM part UNION ALL SELECT p_partkey, 'the-brand', p_brand FROM part UNION ALL SELECT p_partkey, 'size', 'x' FROM part WHERE p_size > 25")
def inline_fields(spark, sf_dir):
    body = text("intro\nSize:: ", F.col("p_size"), "\nsome [The Brand:: ", F.col("p_brand"), "] words", F.when(F.col("p_size") > 25, "\n- Size:: x").otherwise(""))
    found = notes.inline_fields(parts(spark, sf_dir).select(F.col("p_partkey").alias("path"), body.alias("body")))
    return commands.flatten(found, F.col("values"), "value").select("path", "name", "value")


@query("SELECT p_partkey, unnest(['#size', '#size/s' || p_size, '#x']) AS tag FROM part")
def tag_levels(spark, sf_dir):
    body = text("see #size/s", F.col("p_size"), " and #x, a#no #x")
    return commands.flatten(parts(spark, sf_dir).select("p_partkey", notes.tags(body).alias("t")), F.col("t"), "tag").select("p_partkey", "tag")


@query("SELECT p_partkey AS src, replace(p_brand, '#', '-') AS dst, p_type AS display, NULL::VARCHAR AS subpath, false AS embed FROM part UNION ALL SELECT p_partkey, 'n' || p_size, NULL, 'top', true FROM part")
def wiki_links(spark, sf_dir):
    body = text("a [[", F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")), "|", F.col("p_type"), "]] and ![[n", F.col("p_size"), "#top]]")
    return links.extract_links(parts(spark, sf_dir).select("p_partkey", body.alias("body")), "p_partkey").select("src", "dst", "display", "subpath", "embed")


def task_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = lambda test: F.when(test, "x").otherwise(" ")
    n = F.col("p_size")
    body = text("# One\n- [", mark(n % 2 == 0), "] top\n  - [", mark(n % 3 == 0), "] child\n    - plain\n  - [x] second\n## Two\n* [", mark(n % 5 == 0), "] alone")
    return tasks.items(parts(spark, sf_dir).select(F.col("p_partkey").alias("path"), body.alias("body")))


SQL_ITEMS = """
WITH i AS (
  SELECT p_partkey AS path, p_size AS n, unnest([{'line': 1, 'parent_line': NULL, 'text': 'top', 'section': 'One', 'k': 2}, {'line': 2, 'parent_line': 1, 'text': 'child', 'section': 'One', 'k': 3},
    {'line': 3, 'parent_line': 2, 'text': 'plain', 'section': 'One', 'k': 0}, {'line': 4, 'parent_line': 1, 'text': 'second', 'section': 'One', 'k': 1}, {'line': 6, 'parent_line': NULL, 'text': 'alone', 'section': 'Two', 'k': 5}]) AS r FROM part
)
"""


@query(SQL_ITEMS + "SELECT path, r.line, r.parent_line, r.text, r.section, r.k > 0 AS task, r.k > 0 AND n % (CASE WHEN r.k = 0 THEN 1 ELSE r.k END) = 0 AS completed FROM i")
def task_items(spark, sf_dir):
    return task_notes(spark, sf_dir).select("path", "line", "parent_line", "text", "section", "task", "completed")


@query(SQL_ITEMS + """
SELECT path, r.line AS line, CASE r.line WHEN 1 THEN n % 2 = 0 AND n % 3 = 0 WHEN 2 THEN n % 3 = 0 WHEN 6 THEN n % 5 = 0 ELSE true END AS fully_completed FROM i
""")
def task_trees(spark, sf_dir):
    return tasks.fully_completed(task_notes(spark, sf_dir))


@query(SQL_ITEMS + "SELECT path, count(*) AS items FROM i WHERE (r.line IN (2, 3) AND n % 3 = 0) OR (r.line = 6 AND n % 5 = 0) OR r.line = 4 OR (r.line IN (1, 2, 3) AND n % 2 = 0) GROUP BY 1")
def task_children(spark, sf_dir):
    items = task_notes(spark, sf_dir)
    return tasks.matching_with_children(items, F.col("completed")).groupBy("path").agg(F.count(F.lit(1)).alias("items"))


@query(SQL_ITEMS + """
SELECT path, r.line AS root, unnest(CASE r.line WHEN 1 THEN [1, 2, 3, 4] WHEN 2 THEN [2, 3] ELSE [r.line] END) AS line FROM i WHERE r.k > 0 AND n % r.k = 0
""")
def task_expand(spark, sf_dir):
    items = task_notes(spark, sf_dir)
    return tasks.expand(items, items.where("completed")).select("path", F.col("root_line").alias("root"), "line")


@query("""
SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'Brand#12' WHEN 'Brand#12' THEN 'Brand#13' ELSE 'Brand#11' END AS next, CASE WHEN p_size > 10 THEN 'big' ELSE 'small' END AS choice,
  coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, -1) AS filled, list_sum([p_size, 1, 2])::DOUBLE AS total, p_size * 2.0::DOUBLE AS product
FROM part
""")
def choice_functions(spark, sf_dir):
    n = F.col("p_size")
    kind = parts(spark, sf_dir).select((n > 10).alias("t")).schema[0].dataType
    return parts(spark, sf_dir).select(
        "p_partkey", values.cycle(["Brand#11", "Brand#12", "Brand#13"], F.col("p_brand")).alias("next"), values.choice(n > 10, kind, F.lit("big"), F.lit("small")).alias("choice"),
        values.default(F.when(n % 2 == 0, n), F.lit(-1)).alias("filled"), values.total(F.array(n, F.lit(1), F.lit(2))).alias("total"), values.product(F.array(n.cast("double"), F.lit(2.0))).alias("product"),
    )
