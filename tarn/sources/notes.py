"""Notes: Markdown files with a YAML header, read as rows.

One row holds one note: path, basename, folder, mod_time, file_class, fields (VARIANT), body. Only the YAML step runs in Python (vectorised, one header for
each note); all else is native. Headers start with ``---`` on the first line; other delimiters are body text.
"""

from __future__ import annotations

import datetime
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions import dynamic, paths
from tarn.sources.guards import MOST_BYTES

HEADER = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n?^---[ \t]*(?:\r?\n|\z)"
INLINE = r"(?m)(?:^\s*(?:[-*+]\s+)?([^\s\[\](){}:`|][^\[\](){}:`|\n]*?)::[ \t]*(.*?)[ \t]*$|\[([^\[\]:]+)::[ \t]*([^\[\]]*?)[ \t]*\]|\(([^():]+)::[ \t]*([^()]*?)[ \t]*\))"


def scan(spark: SparkSession, root: str, pattern: str = "*.md", since: datetime.datetime | None = None, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Files below the root: path, mod_time, size, content (text). Files over the size limit have null content and ``too_large``."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if since is not None:
        reader = reader.option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S"))
    files = reader.text(root, wholetext=True).select("value", "_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size")
    large = F.col("file_size") > MOST_BYTES
    found = files.select(
        F.regexp_replace(F.url_decode(F.replace(F.col("file_path"), F.lit("+"), F.lit("%2B"))), "^file:(//)?", "").alias("path"), F.col("file_modification_time").alias("mod_time"),
        F.col("file_size").alias("size"), F.when(~large, F.col("value")).alias("content"), large.alias("too_large"),
    )
    for name in ignore:
        found = found.where(~F.contains("path", F.lit(f"/{name}/")))
    return found


def scan_bytes(spark: SparkSession, root: str) -> DataFrame:
    """All files of a vault with their bytes and type."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.withColumn("mime_type", paths.mime_type(F.col("path")))


def yaml_to_json(text: str | None) -> tuple[str | None, str | None]:
    """(JSON, error) of a YAML header; an empty header is an empty object."""
    import yaml

    if text is None:
        return "{}", None
    try:
        data = yaml.safe_load(text)
        if data is None:
            return "{}", None
        if not isinstance(data, dict):
            return None, "header is not a mapping"
        return json.dumps(data, default=lambda x: x.isoformat() if hasattr(x, "isoformat") else str(x), ensure_ascii=False), None
    except (yaml.YAMLError, TypeError, ValueError, RecursionError) as error:
        return None, str(error).split("\n")[0]


def headers_of(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([yaml_to_json(t) for t in texts], columns=["json", "error"])


def parse_headers(header: str) -> Column:
    """Struct (json, error) of a column of YAML headers; the one step that runs in Python, a batch at a time."""
    schema = T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())])
    return F.pandas_udf(headers_of, schema)(F.col(header))


def with_frontmatter(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds header, body, fields (VARIANT), file_class and header_error. Without a header fields are an empty object."""
    header = F.nullif(F.regexp_extract(content, "(?m)" + HEADER, 0), F.lit(""))
    inner = F.regexp_extract(content, "(?m)" + HEADER, 1)
    split = files.withColumn("header", F.when(header.isNotNull(), inner)).withColumn("body", F.when(header.isNotNull(), F.substr(F.col(content), F.length(header) + 1)).otherwise(F.col(content)))
    parsed = split.withColumn("__p", parse_headers("header"))
    fields = F.try_parse_json(F.col("__p.json"))
    return parsed.withColumn("fields", fields).withColumn("file_class", file_class(F.col("fields"))).withColumn("header_error", F.col("__p.error")).drop("__p", "header")


def file_class(fields: Column, key: str = "fileClass") -> Column:
    """The class that a note names, if it is a text; else the empty string."""
    value = F.variant_get(fields, f"$['{key}']", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.lit(""))


def notes(spark: SparkSession, root: str, **options) -> DataFrame:
    found = with_frontmatter(scan(spark, root, **options))
    p = F.col("path")
    return found.select("path", paths.basename(p).alias("basename"), paths.folder(p).alias("folder"), "mod_time", "size", "file_class", "fields", metadata(F.col("fields"), F.col("body")).alias("metadata"), "body", "header_error", "too_large")


def clean_key(key: Column) -> Column:
    """Name of an inline field as it is used in queries: lower case, without formatting, blanks as dashes."""
    plain = F.regexp_replace(F.lower(F.trim(key)), r"[*_~`]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}\s/-]", ""), r"\s+", "-")


def inline_fields(rows: DataFrame, key: str = "path", body: str = "body") -> DataFrame:
    """(key, name, values) of ``Name:: value`` lines and bracketed fields; a name that repeats has several values, in order."""
    whole = F.regexp_extract_all(body, F.lit(INLINE), F.lit(0))
    part = lambda g: F.regexp_extract("raw", INLINE, g)
    first = lambda *g: F.coalesce(*(F.nullif(part(i), F.lit("")) for i in g), F.lit(""))
    found = rows.select(key, F.posexplode(whole).alias("nth", "raw"))
    found = found.select(key, "nth", clean_key(first(1, 3, 5)).alias("name"), first(2, 4, 6).alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("nth", "value")))
    return found.groupBy(key, "name").agg(F.transform(ordered, lambda x: x["value"]).alias("values"))


NUMBERS = r"^\s*-?\d+(?:\.\d+)?(?:\s*,\s*-?\d+(?:\.\d+)?)+\s*$"
QUOTED = r"""^\s*"(?:[^"\\]|\\.)*"(?:\s*,\s*"(?:[^"\\]|\\.)*")*\s*,?\s*$"""


def inline_value(text: Column) -> Column:
    """VARIANT of an inline field's text: a number, true or false, a list of numbers or of quoted texts, else the text itself. Dates, durations and links stay texts, which the
    query language reads by their form."""
    return dynamic.bind(F.trim(text), trimmed_value, "inline_value")


def trimmed_value(whole: Column) -> Column:
    listed = F.try_parse_json(F.concat(F.lit("["), F.regexp_replace(whole, r",\s*$", ""), F.lit("]")))
    quoted = F.contains(whole, F.lit('"')) & F.regexp_like(whole, F.lit(QUOTED))
    return (
        F.when(F.regexp_like(whole, F.lit(r"^-?\d+(?:\.\d+)?$")), F.try_parse_json(whole))
        .when(F.length(whole).between(4, 5) & F.lower(whole).isin("true", "false"), F.try_parse_json(F.lower(whole)))
        .when(F.contains(whole, F.lit(",")) & (F.regexp_like(whole, F.lit(NUMBERS)) | quoted), listed)
        .when(quoted, F.get(F.try_variant_get(listed, "$", "array<variant>"), F.lit(0)))
        .otherwise(whole.cast("variant"))
    )


def clean_name(key: Column) -> Column:
    """A key in the form in which queries may also name it: lower case, dashes for what no name has."""
    return F.regexp_replace(F.lower(F.trim(key)), r"[^\p{L}\p{N}_]+", "-")


def metadata(fields: Column, body: Column) -> Column:
    """All fields of a note as one VARIANT object: the header's and the inline fields' of its text. A key that occurs more than once has the list of its values, in
    order, header first; keys are there as they are written and in their cleaned form. All inside the row: nothing is shuffled."""
    found = F.regexp_extract_all(body, F.lit(INLINE), F.lit(0))
    # the first sign tells which form of INLINE a field has, so one group is asked for
    part = lambda raw, line, square, round_: F.when(raw.startswith("["), F.regexp_extract(raw, INLINE, square)).when(raw.startswith("("), F.regexp_extract(raw, INLINE, round_)).otherwise(F.regexp_extract(raw, INLINE, line))
    named = lambda key, value: F.struct(key.alias("key"), clean_name(key).alias("clean"), value.alias("value"))
    key = lambda raw: F.regexp_replace(F.trim(part(raw, 1, 3, 5)), r"[*_~`]", "")
    entry = "array<struct<key: string, clean: string, value: variant>>"
    written = F.transform(found, lambda raw: dynamic.bind(key(raw), lambda k: named(k, inline_value(part(raw, 2, 4, 6)))))
    header = F.transform(F.map_entries(F.try_variant_get(fields, "$", "map<string,variant>")), lambda e: named(e["key"], e["value"]))
    every = F.concat(F.coalesce(header.cast(entry), F.array().cast(entry)), F.coalesce(written.cast(entry), F.array().cast(entry)))

    def gathered(every: Column) -> Column:
        keys = F.array_distinct(F.concat(F.transform(every, lambda e: e["key"]), F.transform(every, lambda e: e["clean"])))
        own = lambda k: F.filter(every, lambda e: (e["key"] == k) | (e["clean"] == k))
        value = lambda k: dynamic.bind(own(k), lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))["value"]).otherwise(F.transform(v, lambda e: e["value"]).cast("variant")))
        return F.to_variant_object(F.map_from_arrays(keys, F.transform(keys, value)))

    return dynamic.bind(every, gathered)


def tags(body: str = "body") -> Column:
    """Tags of a text, each with the tags above it."""
    found = F.regexp_extract_all(body, F.lit(r"(?:^|\s)(#[\p{L}\p{N}_/-]+)"), F.lit(1))
    levels = F.transform(found, lambda t: F.transform(F.sequence(F.lit(1), F.size(F.split(t, "/"))), lambda n: F.array_join(F.slice(F.split(t, "/"), 1, n), "/")))
    return F.array_sort(F.array_distinct(F.flatten(levels)))
