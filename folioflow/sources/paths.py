"""File systems of paths, and keys that stay inside their root."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import quote


def opened(path: str):
    """The file system of a path as Spark writes it (letters are not escaped), and the path within."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"\Afile:(//[^/]*)?(?=/)", "", path)
    if m := re.match(r"([a-z][a-z0-9+.-]*://[^/]*)(/.*)?", path, re.S):
        return fs.FileSystem.from_uri(m[1] + quote(m[2] or "/"))
    return fs.LocalFileSystem(), path


def contained(key: str) -> str:
    """A key that stays inside the root; anything else is an error."""
    clean = posixpath.normpath(key)
    if clean.startswith(("/", "..")) or ":" in clean.split("/")[0] or "\\" in clean:
        raise ValueError("the key leaves the output folder")
    return clean
