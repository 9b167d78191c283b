"""Files that workers open themselves, on any file system that has a URI."""

from __future__ import annotations

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it of a URI (``hdfs://``, ``s3://``, ``file://``) or of a path on a shared mount."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")
