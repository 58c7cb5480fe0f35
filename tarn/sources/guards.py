"""Checks of paths before anything is read; by whole path elements, not by text."""

from __future__ import annotations

import posixpath

MOST_BYTES = 10 * 1024 * 1024


class PathError(ValueError):
    """A path that must not be read or written."""


def elements(path: str) -> list[str]:
    return [p for p in path.split("/") if p not in ("", ".")]


def check_directory(path: str, vault: str | None = None) -> str:
    if not path.strip():
        raise PathError("directory cannot be empty")
    if ".." in elements(path):
        raise PathError(f"'{path}' leaves its directory")
    if vault is not None and not inside(path, vault):
        raise PathError(f"'{path}' is outside '{vault}'")
    return path


def check_file(path: str, suffix: str, base: str | None = None) -> str:
    if not path.endswith(suffix):
        raise PathError(f"'{path}' does not end with {suffix}")
    if ".." in elements(path):
        raise PathError(f"'{path}' leaves its directory")
    if base is not None and not inside(path, base):
        raise PathError(f"'{path}' is outside '{base}'")
    return path


def inside(path: str, directory: str) -> bool:
    """Whether the path is the directory or lies below it."""
    a, b = elements(posixpath.normpath(path)), elements(posixpath.normpath(directory))
    return a[: len(b)] == b
