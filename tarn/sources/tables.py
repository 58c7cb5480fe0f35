"""Other tables: CSV, plain text, JSON and Parquet, and the cache of parsed notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_VERSION = 1


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true").option("mode", "PERMISSIVE")
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def spread(rows: DataFrame) -> DataFrame:
    """The rows in equal parts, three or more for each core, for steps that work long on each row: a small file with many rows is read as one partition or two."""
    spark = rows.sparkSession
    parts = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts)


def write_cache(notes: DataFrame, path: str) -> None:
    """Notes as Parquet by class, so lookups of one class read one folder. Fields are kept as JSON text."""
    rows = notes.withColumn("fields", F.to_json("fields")).withColumn("cache_version", F.lit(CACHE_VERSION))
    rows.repartition("file_class").write.mode("overwrite").partitionBy("file_class").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The cached notes; None if the cache was written by another version and must be built anew."""
    rows = spark.read.parquet(path)
    if "cache_version" not in rows.columns or rows.where(F.col("cache_version") != CACHE_VERSION).limit(1).count():
        return None
    return rows.drop("cache_version").withColumn("fields", F.parse_json("fields"))


def forget(cached: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """The cache without some notes."""
    return cached.join(gone.select(key).distinct(), key, "left_anti")


def merge(cached: DataFrame, fresh: DataFrame, key: str = "path", moment: str = "mod_time") -> DataFrame:
    """Newest row of each note; both tables have the same columns."""
    newest = F.max_by(F.struct(*(F.col(c) for c in cached.columns)), F.col(moment))
    return cached.unionByName(fresh).groupBy(F.col(key).alias("__k")).agg(newest.alias("r")).select("r.*")
