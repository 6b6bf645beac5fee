"""Byte files in the shared folder, for tasks that write formats of their own."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path on it of a URI; a path without a scheme, or with file:, is a local one."""
    if m := re.match(r"file:/+(?=[^/])(.*)", uri):
        return pafs.LocalFileSystem(), "/" + m[1]
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def fresh(folder: str, name: str) -> str:
    """A name that no other attempt at the same task takes; only names that a finished task reports are ever read."""
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def create(uri: str):
    """A stream that writes a new file."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path)


def open_ranges(uri: str):
    """A file for range reads: read_at(length, offset), size()."""
    fs, path = filesystem(uri)
    return fs.open_input_file(path)
