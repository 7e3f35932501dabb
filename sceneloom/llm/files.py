"""Binary files in a shared folder, written and read by tasks through pyarrow's file systems."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it. Hadoop writes local URIs with one slash, pyarrow with three."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def make_folder(uri: str) -> None:
    system, path = opened(uri)
    system.create_dir(path, recursive=True)


@contextmanager
def writing(uri: str) -> Iterator[BinaryIO]:
    """A stream to a file that appears under its name only when complete, so a task can be tried again."""
    system, path = opened(uri)
    partial = f"{path}.{uuid.uuid4().hex[:8]}.partial"
    try:
        with system.open_output_stream(partial, compression=None) as out:
            yield out
        system.move(partial, path)
    except BaseException:
        try:
            system.delete_file(partial)
        except OSError:
            pass
        raise


@contextmanager
def reading(uri: str) -> Iterator[BinaryIO]:
    system, path = opened(uri)
    with system.open_input_file(path) as found:
        yield found


def delete(uri: str) -> None:
    system, path = opened(uri)
    system.delete_file(path)


def delete_folder(uri: str) -> None:
    system, path = opened(uri)
    system.delete_dir(path)
