"""Writing whole binary files from tasks to the shared folder; Spark's binaryFile source reads them back."""

from __future__ import annotations

import os
import re
import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "file://" + re.sub(r"^file:/*", "/", uri)
    elif "://" not in uri:
        uri = os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    store, path = opened(uri)
    store.create_dir(path, recursive=True)


def write_file(folder: str, name: str, parts: list[bytes]) -> int:
    """Write under another name first, then move: readers never see half a file, and a task that runs
    again puts the same bytes in the same place."""
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    store.move(draft, f"{path}/{name}")
    return sum(map(len, parts))
