"""Files that tasks write and read: any address that pyarrow's file systems open, committed by renaming."""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Iterator

from pyarrow import fs


def open_fs(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url) if "://" in url or url.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(url))


@contextlib.contextmanager
def committed(url: str) -> Iterator:
    """A stream to a temporary name beside url, renamed to url when the block ends well and deleted when it does not.

    Two attempts of a task write the same bytes, so it does not matter which of them renames last.
    """
    system, path = open_fs(url)
    folder, name = os.path.split(path)
    system.create_dir(folder, recursive=True)
    temp = f"{folder}/_{name}.{uuid.uuid4().hex}.tmp"
    try:
        with system.open_output_stream(temp, compression=None) as out:
            yield out
        system.move(temp, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            system.delete_file(temp)
        raise


def put_json(url: str, value) -> None:
    with committed(url) as out:
        out.write(json.dumps(value, sort_keys=True).encode())


def get_json(url: str):
    system, path = open_fs(url)
    with system.open_input_stream(path, compression=None) as f:
        return json.loads(f.read())
