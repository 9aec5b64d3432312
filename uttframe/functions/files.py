"""Files that tasks open themselves, by ranges: local or mounted paths, and the stores that Arrow's file systems know (hdfs, s3, gs, ...)."""

from __future__ import annotations

import io
import os
import re

from pyarrow import fs

BUFFER = 1 << 20


def system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    local = re.sub(r"^file:/+", "/", path)
    if "://" not in local:
        return fs.LocalFileSystem(), os.path.abspath(local)
    return fs.FileSystem.from_uri(local)


def open_range(path: str, buffer: int = BUFFER) -> io.BufferedReader:
    """A file that is read from where it is sought, a buffer at a time; seeking within the buffer reads nothing."""
    where, name = system(path)
    return io.BufferedReader(where.open_input_file(name), buffer)


def size_of(path: str) -> int:
    where, name = system(path)
    return where.get_file_info(name).size or 0


def listed(path: str, *suffixes: str) -> list[str]:
    """A file, or the files of a folder that end in one of the suffixes (of the first that any file has)."""
    where, name = system(path)
    if where.get_file_info(name).type == fs.FileType.File:
        return [path]
    base = path.rstrip("/")
    names = sorted(x.base_name for x in where.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
    return next((found for s in suffixes if (found := [f"{base}/{n}" for n in names if n.endswith(s)])), [])
