"""Binary files in the shared folder, written and range-read by tasks."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file URI; a bare path is local (tests)."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def written(uri: str):
    """Output stream whose file appears under ``uri`` only when it is complete.

    A lost or repeated attempt leaves its own partial file under another name,
    never a broken one under the final name; equal attempts replace each other.
    """
    system, path = opened(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    attempt = f"{os.path.dirname(path)}/_attempt-{uuid.uuid4().hex}"
    with system.open_output_stream(attempt) as out:
        yield out
    system.move(attempt, path)
