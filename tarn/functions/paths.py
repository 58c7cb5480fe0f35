"""Path columns: name, folder and extension of a file, and identifiers made from titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def basename(path: Column) -> Column:
    """Last element without its last extension: ``a.b.md`` gives ``a.b``, ``.md`` gives the empty string."""
    return F.regexp_replace(file_name(path), r"\.[^.]*\z", "")


def extension(path: Column) -> Column:
    """Last extension with its dot, or the empty string."""
    return F.regexp_extract(file_name(path), r"(\.[^.]*)\z", 1)


def folder(path: Column) -> Column:
    """Parent directory: ``.`` for a bare name, ``/`` for a file in the root."""
    parent = F.regexp_replace(path, r"/*[^/]*\z", "")
    return F.when(~path.contains("/"), F.lit(".")).when(parent == "", F.lit("/")).otherwise(parent)


def join_path(*parts: Column | str) -> Column:
    """Non-empty parts joined by single slashes."""
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.regexp_replace(F.array_join(F.filter(F.array(*columns), lambda p: p != ""), "/"), "/+", "/")


def is_under(path: Column, directory: str) -> Column:
    """Whether the path is the directory itself or lies below it, by whole path elements."""
    directory = directory.rstrip("/")
    return (path == directory) | path.startswith(directory + "/")


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def note_id(filename: Column, title: Column) -> Column:
    """File name, else the slug of the title, else a random identifier."""
    return F.coalesce(F.nullif(filename, F.lit("")), F.nullif(slug(title), F.lit("")), F.uuid())


#: MIME types by extension (fixed values).
MIME_TYPES = {".md": "text/markdown", ".json": "application/json", ".yaml": "application/yaml", ".yml": "application/yaml", ".txt": "text/plain", ".png": "image/png", ".jpg": "image/jpeg", ".pdf": "application/pdf"}


def mime_type(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for item in MIME_TYPES.items() for x in item))
    return F.coalesce(F.try_element_at(known, F.lower(extension(path))), F.lit("application/octet-stream"))
