"""Single files of any store, read and written by the task that needs them."""

from __future__ import annotations

import urllib.request

from pyarrow import fs

TIMEOUT_SECONDS = 30


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or uri, and the path on it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def read_bytes(path: str) -> bytes:
    if path.startswith(("http://", "https://")):
        with urllib.request.urlopen(path, timeout=TIMEOUT_SECONDS) as answer:
            return answer.read()
    system, plain = file_system(path)
    with system.open_input_stream(plain) as stream:
        return stream.read()


def write_bytes(path: str, data: bytes) -> None:
    system, plain = file_system(path)
    system.create_dir(plain.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(plain) as stream:
        stream.write(data)
