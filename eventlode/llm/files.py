"""Files in a folder that driver and executors share, local or in a remote store."""

from __future__ import annotations

import re

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    if m := re.match(r"file:/+(.*)", uri):
        return fs.LocalFileSystem(), "/" + m[1]
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)
