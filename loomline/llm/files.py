"""Files of the shared folder, from Python on executors: local and mounted paths, or any store that Arrow reaches."""

from __future__ import annotations

import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path there of a URI; ``file:`` and plain paths are local or mounted."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)
