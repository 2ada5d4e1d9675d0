"""Files that tasks read themselves, on whatever store holds them."""

from __future__ import annotations


def filesystem(uri: str):
    """A pyarrow file system and the path in it, for the driver and tasks alike."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)
