"""The cache of parsed notes in numbered versions: rewrites and deletions add a table of changes, and a reader sees one version, whatever is written meanwhile.

Each change is one Parquet table of rows, with ``deleted`` rows for notes that are gone. A version is a small JSON file that lists the tables that make it up, oldest first; it is
written beside the others and published by a rename that never replaces a file. A writer that dies before the rename leaves a table that no version names, and :func:`vacuum` removes
it; of two writers with the same number the second is refused and may try again. The newest row of a path counts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources.tables import CACHE_VERSION

#: Tables of a version beyond which a writer should compact.
MOST_TABLES = 20


class CacheError(ValueError):
    """A version that can't be read or written."""


class NoteCache:
    """The cache in a folder of any file system that Spark reads. ``key`` is the column with a note's path; VARIANT columns are kept as JSON text."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "path"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.paths = spark._jvm.org.apache.hadoop.fs
        self.files = self.paths.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- versions ----

    def versions(self) -> list[int]:
        """Numbers of the published versions, rising."""
        where = self.paths.Path(f"{self.folder}/versions")
        if not self.files.exists(where):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """The content of a version, the newest by default; an empty one before the first write."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "cache_version": CACHE_VERSION, "columns": None, "tables": []}
        version = known[-1] if version is None else version
        if version not in known:
            raise CacheError(f"no version {version}")
        text = self.spark.read.text(f"{self.folder}/versions/{version}.json", wholetext=True).first()[0]
        return json.loads(text)

    def publish(self, version: int, schema: str, tables: list[str]) -> int:
        """Name the tables of a version, in one step."""
        data = json.dumps({"version": version, "cache_version": CACHE_VERSION, "columns": schema, "tables": tables}).encode()
        temporary = self.paths.Path(f"{self.folder}/versions/.{uuid.uuid4().hex}.tmp")
        out = self.files.create(temporary)
        out.write(data)
        out.close()
        context = self.paths.FileContext.getFileContext(self.files.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)  # none: never replace a file
        try:
            context.rename(temporary, self.paths.Path(f"{self.folder}/versions/{version}.json"), options)
        except Exception as error:
            self.files.delete(temporary, False)
            raise CacheError(f"version {version} was published by another writer") from error
        return version

    # ---- reading ----

    def read(self, version: int | None = None) -> DataFrame | None:
        """The notes of a version; None if there is none or it was written for another layout and must be built anew."""
        found = self.manifest(version)
        if not found["tables"] or found["cache_version"] != CACHE_VERSION:
            return None
        schema = f"{found['columns']}, deleted boolean"
        tables = [self.spark.read.schema(schema).parquet(f"{self.folder}/tables/{t}").withColumn("__at", F.lit(i)) for i, t in enumerate(found["tables"])]
        if len(tables) == 1:  # compacted: a path has one row
            return tables[0].where("NOT deleted").drop("deleted", "__at")
        rows = tables[0]
        for t in tables[1:]:
            rows = rows.unionByName(t)
        columns = [c for c in rows.columns if c != "__at"]
        newest = rows.groupBy(F.col(self.key).alias("__key")).agg(F.max_by(F.struct(*columns), "__at").alias("row"))
        return newest.select("row.*").where("NOT deleted").drop("deleted")

    # ---- writing ----

    def write(self, notes: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """Add or replace ``notes`` and delete the paths of ``gone`` in one new version; its number. A path in both is deleted."""
        before = self.manifest()
        plain = None if notes is None else as_text(notes)
        schema = before["columns"] or (None if plain is None else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema))
        if schema is None:
            raise CacheError("the first version needs notes")
        rows = self.spark.createDataFrame([], f"{schema}, deleted boolean")
        if plain is not None:
            kept = plain.select(*[c for c in rows.columns if c != "deleted"], F.lit(False).alias("deleted"))
            kept = kept if gone is None else kept.join(gone.select(F.col(self.key).alias("__key")), F.col(self.key) == F.col("__key"), "left_anti")
            rows = rows.unionByName(kept)
        if gone is not None:
            rows = rows.unionByName(gone.select(self.key).distinct().withColumn("deleted", F.lit(True)), allowMissingColumns=True)
        tables = before["tables"] if before["cache_version"] == CACHE_VERSION else []
        return self.publish(before["version"] + 1, schema, [*tables, self.save(rows)])

    def save(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/tables/{name}")
        return name

    def compact(self) -> int:
        """A version of one table with the same notes, so that reading needs no comparison of rows."""
        before = self.manifest()
        rows = self.read()
        if rows is None:
            raise CacheError("nothing to compact")
        return self.publish(before["version"] + 1, before["columns"], [self.save(rows.withColumn("deleted", F.lit(False)))])

    def vacuum(self, keep: int = 1) -> list[str]:
        """Forget all versions but the newest ``keep`` and delete the tables that no version names (of dead writers too; don't run it beside a writer). The tables that went."""
        known = self.versions()
        for version in known[: max(0, len(known) - keep)]:
            self.files.delete(self.paths.Path(f"{self.folder}/versions/{version}.json"), False)
        used = {t for v in known[max(0, len(known) - keep) :] for t in self.manifest(v)["tables"]}
        where = self.paths.Path(f"{self.folder}/tables")
        found = [s.getPath().getName() for s in self.files.listStatus(where)] if self.files.exists(where) else []
        gone = sorted(t for t in found if t not in used)
        for t in gone:
            self.files.delete(self.paths.Path(f"{self.folder}/tables/{t}"), True)
        return gone


def as_text(notes: DataFrame) -> DataFrame:
    """VARIANT columns as JSON text, which every reader of Parquet knows."""
    return notes.select(*(F.to_json(f"`{f.name}`").alias(f.name) if f.dataType.simpleString() == "variant" else F.col(f"`{f.name}`") for f in notes.schema))
