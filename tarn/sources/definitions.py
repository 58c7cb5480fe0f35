"""Schemas and the property bank, read from JSON files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.definitions import Bank, Property, Schema, SchemaError
from tarn.sources.guards import MOST_BYTES, check_directory

BANK_FOLDER = "properties"


def json_files(spark: SparkSession, directory: str) -> DataFrame:
    """path, size and text of the JSON files below a directory."""
    check_directory(directory)
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(directory, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))


def read_definitions(spark: SparkSession, directory: str, bank: bool) -> list[tuple[str, dict]]:
    """(path, JSON object) of schema files, or of the bank's files, in the order of their paths. Definitions are few and small (10 MB each at most), and the
    driver compiles rules from them."""
    in_bank = F.contains("path", F.lit(f"/{BANK_FOLDER}/"))
    out = []
    for row in json_files(spark, directory).where(in_bank if bank else ~in_bank).orderBy("path").collect():
        if row.size > MOST_BYTES:
            raise SchemaError(row.path, f"file is larger than {MOST_BYTES} bytes")
        try:
            out.append((row.path, json.loads(row.text)))
        except ValueError as error:
            raise SchemaError(row.path, f"malformed JSON: {error}") from error
    return out


def load_schemas(spark: SparkSession, directory: str) -> list[Schema]:
    """Schemas of a directory; one malformed file ends the load."""
    found = []
    for path, data in read_definitions(spark, directory, bank=False):
        try:
            found.append(Schema.from_json(data))
        except ValueError as error:
            raise SchemaError(data.get("name") or path, str(error)) from error
    return found


def load_bank(spark: SparkSession, directory: str) -> Bank:
    """Shared properties of ``<directory>/properties``; the last file that defines a name wins, by path."""
    merged: dict[str, Property] = {}
    for _, data in read_definitions(spark, directory, bank=True):
        for key, value in sorted((data.get("properties") or {}).items()):
            prop = Property.from_json(key, value)
            merged[prop.name] = prop
    bank = Bank(location=f"{directory.rstrip('/')}/{BANK_FOLDER}")
    for prop in merged.values():
        bank.register(prop)
    return bank


def malformed(spark: SparkSession, directory: str) -> DataFrame:
    """Files that are no JSON object, as rows instead of an error."""
    return json_files(spark, directory).where(F.try_parse_json("text").isNull() | ~F.coalesce(F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT"), F.lit(False))).select("path")


def property_table(spark: SparkSession, schemas: list[Schema]) -> DataFrame:
    """One row for each schema and property with its definition as JSON, for work with definitions as tables."""
    rows = [(s.name, p.name, json.dumps(p.to_json(), sort_keys=True)) for s in schemas for p in s.effective]
    return spark.createDataFrame(rows, "schema string, property string, definition string")
