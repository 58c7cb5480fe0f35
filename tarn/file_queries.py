"""Queries over files: notes, definitions, templates, settings, caches and registries that are written first and then read back.

The files are made from the rows of small tables in a scratch folder, so SQL can state what reading them must give."""

from __future__ import annotations

import datetime
import functools
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.plans import templates
from tarn.sources import definitions, guards, notes, settings, sinks, tables
from tarn.sources.cache import NoteCache
from tarn.sources.note_source import read_notes

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


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: below the checkpoint folder if it is a file system path, else (local mode only) a temporary one."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if not base.startswith("/"):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a mounted folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="tarn-files-")
    folder = os.path.join(base, "files-" + uuid.uuid4().hex)
    os.makedirs(folder)
    return folder


def attempt(work) -> str:
    try:
        return str(work())
    except ValueError as error:
        return str(error.args[0])


def write_notes(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """A note for each nation, with a header of its own or none, below a folder for each region."""
    n, name = F.col("n_nationkey"), F.col("n_name")
    head = F.when(n % 5 == 0, "").when(n % 5 == 1, F.concat(F.lit("+++\ntitle: x\n+++\n"))).when(n % 5 == 2, "---\n: [bad\n---\n").otherwise(
        F.concat(F.lit("---\ntitle: "), name, F.lit("\nfileClass: region-"), F.col("n_regionkey").cast("string"), F.lit("\nsize: "), n.cast("string"), F.lit("\n---\n")))
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/n"), n.cast("string")).alias("name"), F.concat(head, F.lit("body of "), name).alias("content"))
    sinks.write_rows_as_files(rows, f"{folder}/vault")
    sinks.write_file(f"{folder}/vault/tool/hidden.md", b"hidden")
    sinks.write_file(f"{folder}/vault/r0/picture.png", b"\x89PNG")


@query("""
SELECT 'r' || n_regionkey || '/n' || n_nationkey || '.md' AS path, 'n' || n_nationkey AS basename, 'r' || n_regionkey AS folder,
  CASE WHEN n_nationkey % 5 > 2 THEN 'region-' || n_regionkey ELSE '' END AS file_class, CASE WHEN n_nationkey % 5 > 2 THEN n_name END AS title, CASE WHEN n_nationkey % 5 > 2 THEN n_nationkey::BIGINT END AS size,
  CASE n_nationkey % 5 WHEN 1 THEN '+++' || chr(10) || 'title: x' || chr(10) || '+++' || chr(10) ELSE '' END || 'body of ' || n_name AS body, n_nationkey % 5 = 2 AS bad_header
FROM nation
""")
def note_files(spark, sf_dir):
    folder = scratch(spark)
    write_notes(spark, sf_dir, folder)
    found = notes.notes(spark, f"{folder}/vault", ignore=("tool",))
    field = lambda k, t: F.try_variant_get("fields", f"$.{k}", t)
    below = lambda c: F.regexp_replace(c, ".*/vault/", "")
    return found.select(below("path").alias("path"), "basename", below("folder").alias("folder"), "file_class", field("title", "string").alias("title"), field("size", "bigint").alias("size"), "body", F.col("header_error").isNotNull().alias("bad_header"))


@query("""
SELECT 'all files' AS what, (SELECT count(*) FROM nation) + 2 AS n UNION ALL SELECT 'pictures', 1 UNION ALL SELECT 'notes', (SELECT count(*) FROM nation) + 1 UNION ALL SELECT 'since', (SELECT count(*) FROM nation)
UNION ALL SELECT 'too large', 0 UNION ALL SELECT 'text', 1
""")
def vault_scans(spark, sf_dir):
    folder = scratch(spark)
    write_notes(spark, sf_dir, folder)
    old = datetime.datetime(2001, 1, 1, tzinfo=datetime.timezone.utc).timestamp()
    os.utime(f"{folder}/vault/tool/hidden.md", (old, old))
    every = notes.scan_bytes(spark, f"{folder}/vault")
    counts = {
        "all files": every.count(), "pictures": every.where("mime_type = 'image/png'").count(), "notes": notes.scan(spark, f"{folder}/vault").count(),
        "since": notes.scan(spark, f"{folder}/vault", since=datetime.datetime(2020, 1, 1)).count(), "too large": notes.scan(spark, f"{folder}/vault").where("too_large").count(),
        "text": tables.read_text(spark, f"{folder}/vault/tool/hidden.md").where("value = 'hidden'").count(),
    }
    return spark.createDataFrame(list(counts.items()), "what string, n bigint")


@query("""
SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'new ' ELSE 'old ' END || n_name AS body, 'region-' || n_regionkey AS file_class, n_nationkey::BIGINT AS size, true AS same_version, true AS rebuilt
FROM nation WHERE n_nationkey % 3 <> 0
""")
def note_cache(spark, sf_dir):
    """Write, read, bring up to date and forget; a cache of another version is none."""
    folder = scratch(spark)
    n = F.col("n_nationkey").cast("bigint")
    base = table(spark, sf_dir, "nation").select(n.alias("k"), F.concat(F.lit("n"), n.cast("string"), F.lit(".md")).alias("path"), F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp").alias("mod_time"),
        F.concat(F.lit("old "), "n_name").alias("body"), F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("file_class"), F.parse_json(F.concat(F.lit('{"size": '), n.cast("string"), F.lit("}"))).alias("fields"))
    tables.write_cache(base, f"{folder}/cache")
    cached = tables.read_cache(spark, f"{folder}/cache").select(*base.columns)
    plain = lambda d: d.withColumn("fields", F.to_json("fields"))
    fresh = plain(base).where("k % 2 = 0").withColumn("body", F.replace("body", F.lit("old"), F.lit("new"))).withColumn("mod_time", F.col("mod_time") + F.expr("interval 1 day"))
    current = tables.forget(tables.merge(plain(cached), fresh), fresh.sparkSession.range(100).where("id % 3 = 0").select(F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(".md")).alias("path")))
    base.withColumn("fields", F.to_json("fields")).withColumn("cache_version", F.lit(tables.CACHE_VERSION + 1)).write.parquet(f"{folder}/other")
    none = tables.read_cache(spark, f"{folder}/other") is None
    return current.select("k", "body", "file_class", F.get_json_object("fields", "$.size").cast("bigint").alias("size"), F.lit(cached is not None).alias("same_version"), F.lit(none).alias("rebuilt"))


@query("""
SELECT s_suppkey AS key, 'nation-' || s_nationkey AS file_class, s_suppkey * 2 AS twice, 'about ' || s_name AS body, 'all' AS what FROM supplier
UNION ALL SELECT s_suppkey, 'nation-' || s_nationkey, s_suppkey * 2, 'about ' || s_name, 'class' FROM supplier WHERE s_nationkey = 3
UNION ALL SELECT s_suppkey, 'nation-' || s_nationkey, s_suppkey * 2, 'about ' || s_name, 'folder' FROM supplier WHERE s_suppkey % 4 = 1
""")
def notes_format(spark, sf_dir):
    """Files of all suppliers through the notes format: whole, by class, by folder."""
    folder = scratch(spark)
    key = F.col("s_suppkey")
    text = F.concat(F.lit("---\nfileClass: nation-"), F.col("s_nationkey").cast("string"), F.lit("\ntwice: "), (key * 2).cast("string"), F.lit("\n---\nabout "), F.col("s_name"))
    for n in range(4):
        sinks.write_rows_as_files(table(spark, sf_dir, "supplier").where(key % 4 == n).select(key.cast("string").alias("name"), text.alias("content")), f"{folder}/f{n}")
    rows = read_notes(spark, folder)
    shown = lambda df, what: df.select(
        F.regexp_extract("path", r"(\d+)\.md$", 1).cast("bigint").alias("key"), "file_class", F.try_variant_get("fields", "$.twice", "bigint").alias("twice"), "body", F.lit(what).alias("what")
    )
    return shown(rows, "all").union(shown(read_notes(spark, folder, file_class="nation-3"), "class")).union(shown(read_notes(spark, folder, under="f1/"), "folder"))


@query("""
WITH p AS (SELECT p_partkey AS k, p_name AS name, p_size AS n FROM part),
v AS (
  SELECT 1 AS version, k, 'old ' || name AS body, n FROM p UNION ALL SELECT 2, k, CASE WHEN k % 2 = 0 THEN 'new ' ELSE 'old ' END || name, n FROM p
  UNION ALL SELECT 2, -1, 'added', 0 UNION ALL SELECT 3, k, CASE WHEN k % 2 = 0 THEN 'new ' ELSE 'old ' END || name, n FROM p WHERE k % 3 <> 0 UNION ALL SELECT 3, -1, 'added', 0
)
SELECT version, k, body, n FROM v UNION ALL SELECT 4, k, body, n FROM v WHERE version = 3 UNION ALL SELECT 5, k, 'back ' || name, n FROM p WHERE k % 9 = 0 UNION ALL SELECT 5, k, body, n FROM v WHERE version = 3 AND k % 5 <> 0
""")
def cache_versions(spark, sf_dir):
    """Written, rewritten, deleted, compacted and written again; every version as it was."""
    cache = NoteCache(spark, "file://" + scratch(spark))
    key = F.col("p_partkey")
    path = F.concat(F.lit("parts/"), key.cast("string"), F.lit(".md"))
    parts = table(spark, sf_dir, "part").select(path.alias("path"), key.alias("k"), F.concat(F.lit("old "), "p_name").alias("body"), F.to_variant_object(F.struct(F.col("p_size").alias("n"))).alias("fields"))
    anew = lambda word: F.concat(F.lit(word), F.substring("body", 5, 1000))
    extra = parts.limit(1).select(F.lit("added.md").alias("path"), F.lit(-1).cast("bigint").alias("k"), F.lit("added").alias("body"), F.parse_json(F.lit('{"n": 0}')).alias("fields"))
    cache.write(parts)
    cache.write(parts.where("k % 2 = 0").withColumn("body", anew("new ")).unionByName(extra))
    cache.write(gone=parts.where("k % 3 = 0"))
    cache.compact()
    cache.write(parts.where("k % 9 = 0").withColumn("body", anew("back ")), gone=parts.where("k % 5 = 0 AND k % 9 <> 0"))
    size = F.get_json_object("fields", "$.n").cast("int")
    shown = [cache.read(v).select(F.lit(v).alias("version"), "k", "body", size.alias("n")) for v in cache.versions()]
    return functools.reduce(DataFrame.unionByName, shown)


@query("""
SELECT n_nationkey::BIGINT AS k, n_name AS name, n_regionkey::BIGINT AS region FROM nation
""")
def csv_files(spark, sf_dir):
    path = scratch(spark) + "/nations.csv"
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).write.option("header", "true").csv(path)
    return tables.read_csv(spark, path, "k bigint, name string, region bigint")


@query("""
SELECT n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::BIGINT ELSE -1 END AS value, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::BIGINT ELSE -1 END AS indexed FROM nation
""")
def registries(spark, sf_dir):
    """Loading puts saved entries over those that are there; as a JSON file and as a table."""
    folder = scratch(spark)
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()
    saved = {r.n_name: r.n_nationkey for r in rows if r.n_nationkey % 2 == 0}
    sinks.save_registry(saved, f"{folder}/registry.json")
    merged = sinks.load_registry(f"{folder}/registry.json", {r.n_name: -1 for r in rows})
    sinks.save_index(spark.createDataFrame(list(saved.items()), "key string, indexed bigint"), f"{folder}/index")
    over = spark.createDataFrame([(r.n_name, -1) for r in rows], "key string, indexed bigint")
    table_ = sinks.load_index(spark, f"{folder}/index", "key string, indexed bigint", over)
    return spark.createDataFrame(list(merged.items()), "key string, value bigint").join(table_, "key")


@query("""
SELECT 'schema' AS kind, replace(lower(n_name), ' ', '-') AS name, n_regionkey::BIGINT + 1 AS size FROM nation WHERE n_nationkey % 5 <> 0
UNION ALL SELECT 'bank', 'p' || r_regionkey, CASE WHEN r_regionkey = 0 THEN 2 ELSE 1 END FROM region UNION ALL SELECT 'malformed', 'bad.json', 1 UNION ALL SELECT 'stops', 'malformed JSON', 1
""")
def definition_files(spark, sf_dir):
    folder = scratch(spark)
    for r in table(spark, sf_dir, "nation").collect():
        name = r.n_name.lower().replace(" ", "-")
        spec = {"name": name, "properties": {f"x{i}": {"type": "string"} for i in range(r.n_regionkey + 1)}}
        place = "notes.txt" if r.n_nationkey % 5 == 0 else f"below/{name}.json"
        sinks.write_file(f"{folder}/good/{place}", json.dumps(spec).encode())
    for r in table(spark, sf_dir, "region").collect():
        sinks.write_file(f"{folder}/good/properties/{r.r_regionkey}.json", json.dumps({"properties": {f"p{r.r_regionkey}": {"type": "number", "min": 1}}}).encode())
    sinks.write_file(f"{folder}/good/properties/z.json", json.dumps({"properties": {"p0": {"type": "number", "min": 2}}}).encode())
    sinks.write_file(f"{folder}/bad/ok.json", b'{"name": "a"}')
    sinks.write_file(f"{folder}/bad/bad.json", b"{")
    out = [("schema", s.name, len(s.properties)) for s in definitions.load_schemas(spark, f"{folder}/good")]
    out += [("bank", p.name, int(p.min)) for p in definitions.load_bank(spark, f"{folder}/good").properties.values()]
    out += [("malformed", r.path.rsplit("/", 1)[1], 1) for r in definitions.malformed(spark, f"{folder}/bad").collect()]
    try:
        definitions.load_schemas(spark, f"{folder}/bad")
    except ValueError as error:
        out.append(("stops", error.reason.split(":")[0], 1))
    return spark.createDataFrame(out, "kind string, name string, size bigint")


@query("""
SELECT 'up' AS what, '''a/../b'' leaves its directory' AS outcome UNION ALL SELECT 'outside', '''/x/z'' is outside ''/x/y''' UNION ALL SELECT 'inside', '/x/y/z' UNION ALL SELECT 'alike', '''/x/yz'' is outside ''/x/y'''
UNION ALL SELECT 'empty', 'directory cannot be empty' UNION ALL SELECT 'ending', '''a.txt'' does not end with .json' UNION ALL SELECT 'file', 'a/b.json' UNION ALL SELECT 'file up', '''../b.json'' leaves its directory'
""")
def path_guards(spark, sf_dir):
    out = {
        "up": lambda: guards.check_directory("a/../b"), "outside": lambda: guards.check_directory("/x/z", "/x/y"), "inside": lambda: guards.check_directory("/x/y/z", "/x/y"), "alike": lambda: guards.check_directory("/x/yz", "/x/y"),
        "empty": lambda: guards.check_directory(" "), "ending": lambda: guards.check_file("a.txt", ".json"), "file": lambda: guards.check_file("a/b.json", ".json"), "file up": lambda: guards.check_file("../b.json", ".json"),
    }
    return spark.createDataFrame([(k, attempt(f)) for k, f in out.items()], "what string, outcome string")


@query("""
SELECT 'defaults' AS what, 'v|v/templates|v/schemas|v/schemas/properties|info' AS outcome UNION ALL SELECT 'file', 'w|w/own|w/schemas|w/schemas/properties|warn' UNION ALL SELECT 'environment', 'e|e/own|/s|/s/properties|warn'
UNION ALL SELECT 'missing', 'vault ''/no/vault'' does not exist' UNION ALL SELECT 'no folder', 'is not a directory' UNION ALL SELECT 'level', 'log level ''loud'' is none of debug, info, warn, error' UNION ALL SELECT 'good', 'None'
""")
def settings_sources(spark, sf_dir):
    folder = scratch(spark)
    sinks.write_file(f"{folder}/tarn.yaml", b"vaultPath: w\ntemplatesDir: own\nlogLevel: warn\n")
    shown = lambda s: "|".join((s.vault, s.templates, s.schemas, s.properties, s.log_level))
    out = {
        "defaults": lambda: shown(settings.load([], {"TARN_VAULT": "v"})), "file": lambda: shown(settings.load([folder], {})), "environment": lambda: shown(settings.load([folder], {"TARN_VAULT": "e", "TARN_SCHEMAS": "/s"})),
        "missing": lambda: settings.Settings.of("/no/vault").check(), "no folder": lambda: settings.Settings.of(f"{folder}/tarn.yaml").check(), "level": lambda: settings.Settings.of(folder, log_level="loud").check(), "good": lambda: settings.Settings.of(folder).check(),
    }
    rows = [(k, attempt(f)) for k, f in out.items()]
    return spark.createDataFrame([(k, "is not a directory" if k == "no folder" and v.endswith("is not a directory") else v) for k, v in rows], "what string, outcome string")


@query("""
SELECT 'rendered' AS what, lower(n_name) || '-' || upper(n_name) || ' has ' || n_nationkey AS outcome FROM nation UNION ALL SELECT 'listed', unnest(['empty', 'note']) UNION ALL SELECT 'by name', 'note'
UNION ALL SELECT 'empty', 'content is empty' UNION ALL SELECT 'unclosed', 'line 1' UNION ALL SELECT 'now', '2024-01-15 12:00:00'
""")
def template_files(spark, sf_dir):
    folder = scratch(spark)
    sinks.write_file(f"{folder}/note.md", b"{{ .name | toLower }}-{{ toUpper .name }} has {{ .k }}")
    sinks.write_file(f"{folder}/empty.md", b" ")
    name, text = templates.load_template(spark, f"{folder}/note.md")
    df = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    clock = F.lit(datetime.datetime(2024, 1, 15, 12))
    rendered = templates.render(df, text, clock).select(F.lit("rendered").alias("what"), F.col("rendered").alias("outcome"))
    listed = templates.load_templates(spark, folder).select(F.lit("listed").alias("what"), F.col("name").alias("outcome"))

    def unclosed() -> None:
        templates.render(df, "{{ if .name }}x", clock)

    try:
        unclosed()
        line = "none"
    except templates.TemplateError as error:
        line = f"line {error.line}"
    moment = templates.render(df.limit(1), '{{ now "" }}', clock).first().rendered
    out = [("by name", name), ("empty", attempt(lambda: templates.load_template(spark, f"{folder}/empty.md"))), ("unclosed", line), ("now", moment)]
    return rendered.union(listed).union(spark.createDataFrame(out, "what string, outcome string"))
