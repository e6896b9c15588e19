"""Files in a store that all executors share, by URI."""

from __future__ import annotations

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder's URI, as Spark writes it."""
    if uri.startswith("s3a://"):
        uri = "s3://" + uri[len("s3a://"):]
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)
