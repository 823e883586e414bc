"""Writing and reading files of the shared file system from inside tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs

from .common import file_uri


def open_input(path: str):
    """A seekable file, opened for reading."""
    system, name = fs.FileSystem.from_uri(file_uri(path))
    return system.open_input_file(name)


@contextmanager
def new_file(folder: str, stem: str, suffix: str) -> Iterator[tuple[str, object]]:
    """(path, stream) of a file that no other attempt of a task writes. Only files that a successful task names in its rows
    count; what a lost or repeated attempt leaves behind is read by no one."""
    path = f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex[:12]}{suffix}"
    system, name = fs.FileSystem.from_uri(file_uri(path))
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(name, compression=None) as stream:
        yield path, stream
