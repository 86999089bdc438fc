"""Files that tasks write or read themselves, in any store that pyarrow reaches by URI."""

from __future__ import annotations

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    store, path = filesystem(uri)
    store.create_dir(path, recursive=True)
