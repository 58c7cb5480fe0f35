"""``spark.read.format("notes")`` and ``spark.readStream.format("notes")``: Markdown notes below a folder as rows.

The folder is listed once, on the driver, in the order of its path elements, and files are dealt to partitions by their size. A stream's offset is the moment and path of the last
file taken in; files that are new or changed since make up the next batch. Files may be in any file system that Arrow reads.

Options: ``pattern`` (``*.md``), ``partitionBytes`` (32 MB), ``errors``: ``keep`` gives a file that can't be read as a row with its ``error``, ``stop`` ends the job at the first in the
order of the listing. ``under`` (a folder or the beginning of a path below the root), ``changedAfter`` and ``changedBefore`` (ISO moments, exclusive) are settled in the listing, so files that
they exclude are never opened; ``class`` is settled after a file's header. They are options, not filters pushed by Spark: Spark 4.1 keeps what it has pushed to a source in Python
for later queries over the same DataFrame, which then lack rows. Empty folders give no rows. A file that is put into the folder later with an older time of change is not seen by a stream that has passed that moment.
"""

from __future__ import annotations

import datetime
import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, datasource
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarn.sources.guards import MOST_BYTES
from tarn.sources.notes import yaml_to_json

SCHEMA = "path string, mod_time timestamp, size bigint, file_class string, header string, body string, error string"
HEADER = re.compile(r"---[ \t]*\r?\n(.*?)\r?\n?^---[ \t]*(?:\r?\n|\Z)", re.DOTALL | re.MULTILINE)
CLASS_KEY = "fileClass"


class NoteError(ValueError):
    """A note that can't be read."""


@dataclass(frozen=True)
class File:
    path: str
    micros: int
    size: int

    @property
    def moment(self) -> datetime.datetime:
        return datetime.datetime.fromtimestamp(0, datetime.timezone.utc) + datetime.timedelta(microseconds=self.micros)


@dataclass
class Files(datasource.InputPartition):
    """Files that one task reads, in order."""

    files: list[File]


def micros(moment: str | None) -> int | None:
    """Microseconds since 1970 of an ISO moment; UTC where it names no zone."""
    if moment is None:
        return None
    found = datetime.datetime.fromisoformat(moment)
    found = found if found.tzinfo else found.replace(tzinfo=datetime.timezone.utc)
    return round(found.timestamp() * 1_000_000)


def file_system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.rstrip("/") or "/")


def listed(root: str, pattern: str) -> list[File]:
    """The files below a folder, a folder's entries in lexical order, as a walk meets them."""
    from pyarrow import fs

    system, base = file_system(root)
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    files = [File(f.path, f.mtime_ns // 1000, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern)]
    return sorted(files, key=lambda f: f.path.split("/"))


def dealt(files: list[File], most: int) -> list[Files]:
    """Partitions of at most ``most`` bytes, or one larger file; each file counts 4 KB at least, for opening it."""
    out: list[list[File]] = []
    size = most
    for f in files:
        cost = max(f.size, 4096)
        if size + cost > most:
            out.append([])
            size = 0
        out[-1].append(f)
        size += cost
    return [Files(part) for part in out]


def rows_of(root: str, files: list[File], errors: str, wanted: str | None) -> Iterator[tuple]:
    """A row for each file; ``wanted`` is the class that matters, if not all do."""
    system, _ = file_system(root)
    for f in files:
        header = body = error = None
        file_class = ""
        try:
            if f.size > MOST_BYTES:
                raise NoteError(f"{f.path} is larger than {MOST_BYTES} bytes")
            with system.open_input_stream(f.path) as stream:
                text = stream.read().decode("utf-8")
            found = HEADER.match(text)
            header, reason = yaml_to_json(found[1]) if found else ("{}", None)
            if reason:
                raise NoteError(f"{f.path}: {reason}")
            file_class = class_of(header)
            body = text[found.end() :] if found else text
        except (OSError, UnicodeDecodeError, NoteError) as problem:
            if errors == "stop":
                raise NoteError(f"{f.path}: {problem}") from problem
            error = str(problem)
        if wanted is None or file_class == wanted:
            yield f.path, f.moment, f.size, file_class, header, body, error


def class_of(header: str) -> str:
    import json

    value = json.loads(header).get(CLASS_KEY)
    return value if isinstance(value, str) else ""


class Reader(datasource.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.pattern = options["path"], options.get("pattern", "*.md")
        self.most, self.errors = int(options.get("partitionbytes", options.get("partitionBytes", 32 << 20))), options.get("errors", "keep")
        moment = lambda name: options.get(name.lower(), options.get(name))
        self.after, self.before = (micros(moment(n)) for n in ("changedAfter", "changedBefore"))
        self.under, self.file_class = options.get("under", ""), options.get("class")
        if self.errors not in ("keep", "stop"):
            raise NoteError(f"errors are kept or stop the job, not {self.errors!r}")

    def files(self) -> list[File]:
        """The files that the options leave, in the order of the walk."""
        base = file_system(self.root)[1].rstrip("/") + "/" + self.under
        found = [f for f in listed(self.root, self.pattern) if f.path.startswith(base)]
        return [f for f in found if (self.after is None or f.micros > self.after) and (self.before is None or f.micros < self.before)]

    def partitions(self) -> list[Files]:
        return dealt(self.files(), self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(self.root, partition.files, self.errors, self.file_class)


class StreamReader(datasource.DataSourceStreamReader):
    """Batches of files by (time of change, path)."""

    def __init__(self, options: dict[str, str]):
        self.reader = Reader(options)

    def initialOffset(self) -> dict:
        return {"micros": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((f.micros, f.path) for f in self.reader.files()), default=(-1, ""))
        return {"micros": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((o["micros"], o["path"]) for o in (start, end))
        return dealt([f for f in self.reader.files() if low < (f.micros, f.path) <= high], self.reader.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.reader.read(partition)


class NoteSource(datasource.DataSource):
    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(NoteSource)


def read_notes(spark: SparkSession, root: str, file_class: str | None = None, **options: str) -> DataFrame:
    """The notes with their headers as VARIANT (``fields``)."""
    register(spark)
    options |= {} if file_class is None else {"class": file_class}
    rows = spark.read.format("notes").options(**options).load(root)
    return rows.withColumn("fields", F.coalesce(F.try_parse_json("header"), F.parse_json(F.lit("{}"))))
