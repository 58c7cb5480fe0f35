"""Schema algebra as DataFrames, for definitions kept in tables (one row for each schema and property)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def settled(df: DataFrame) -> DataFrame:
    """Cuts lineage between the rounds of a loop by a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names; a temporary one in local mode without the setting."""
    context = df.sparkSession.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="tarn-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def missing_parents(schemas: DataFrame) -> DataFrame:
    """Schemas (name, extends) whose parent is not among them."""
    names = schemas.select(F.col("name").alias("known"))
    return schemas.where("extends is not null").join(names, F.col("extends") == F.col("known"), "left_anti")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ancestors(schemas: DataFrame) -> DataFrame:
    """(name, ancestor, depth, path), level by level until none is left; each schema is its own ancestor at depth 0. A path ends where it would meet
    a name again, so cycles end too; :func:`cycles` lists them."""
    above = settled(schemas.select(F.col("name").alias("s_name"), F.col("extends").alias("s_next")))
    level = settled(schemas.select("name", F.col("name").alias("ancestor"), F.lit(0).alias("depth"), F.array("name").alias("path"), F.col("extends").alias("next")))
    found = level
    while True:
        joined = level.join(above, (F.col("next") == F.col("s_name")) & ~F.array_contains("path", F.col("s_name")))
        level = settled(joined.select("name", F.col("s_name").alias("ancestor"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("s_name")).alias("path"), F.col("s_next").alias("next")))
        if level.isEmpty():
            return found.select("name", "ancestor", "depth", "path")
        found = found.union(level)


def cycles(schemas: DataFrame) -> DataFrame:
    """(name, cycle) of the schemas on or below a circular inheritance; the cycle is written ``a -> b -> a``."""
    last = ancestors(schemas).join(schemas.select(F.col("name").alias("n"), F.col("extends").alias("next")), F.col("ancestor") == F.col("n"))
    back = last.where(F.array_contains("path", F.col("next")))
    at = F.array_position("path", F.col("next")).cast("int")
    loop = F.array_append(F.slice("path", at, F.size("path") - at + 1), F.col("next"))
    return back.select("name", F.array_join(loop, " -> ").alias("cycle"))


def resolve(schemas: DataFrame, properties: DataFrame, excludes: DataFrame) -> DataFrame:
    """Resolved properties (schema, property, definition, depth): the nearest definition of a name wins, unless a schema between it and
    the one that inherits (that one included) excludes the name. A schema's own exclusion also hides its own definition.

    schemas (name, extends), properties (schema, property, definition), excludes (schema, property)."""
    up = ancestors(schemas).select("name", "ancestor", "depth")
    inherited = up.join(properties, F.col("ancestor") == F.col("schema")).select("name", "property", "definition", "depth")
    hidden = up.join(excludes, F.col("ancestor") == F.col("schema")).groupBy(F.col("name").alias("h_name"), F.col("property").alias("h_property")).agg(F.min("depth").alias("hidden_at"))
    rank = F.row_number().over(Window.partitionBy("name", "property").orderBy("depth"))
    nearest = inherited.withColumn("rank", rank).where("rank = 1").drop("rank")
    joined = nearest.join(hidden, (F.col("name") == F.col("h_name")) & (F.col("property") == F.col("h_property")), "left")
    return joined.where("hidden_at is null or hidden_at > depth").select(F.col("name").alias("schema"), "property", "definition", "depth")


def references(properties: DataFrame, bank: DataFrame) -> DataFrame:
    """Properties (schema, property, ref) joined with the bank (name, definition); ``definition`` is null where the target is missing."""
    name = reference_name(F.col("ref"))
    return properties.withColumn("target", name).join(bank.select(F.col("name").alias("bank_name"), "definition"), F.col("target") == F.col("bank_name"), "left").drop("bank_name")


def reference_name(reference: Column) -> Column:
    """The name in ``...#/properties/<name>``; empty if there is none."""
    return F.regexp_extract(reference, r"^[^#]*#/properties/(.*)$", 1)
