"""Files that Python opens on executors, on local and mounted paths or in any store that Arrow reaches."""

from __future__ import annotations

import pyarrow.fs as pafs


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path there of a URI; ``file:`` and plain paths are local or mounted."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
