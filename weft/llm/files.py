"""Whole files in the shared folder, from Python workers.

Paths are URIs.  ``file:`` is opened directly (the folder is mounted on every
machine); other schemes go through pyarrow's file systems.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse


def _local(path: str) -> str | None:
    url = urlparse(path)
    return unquote(url.path) if url.scheme in ("", "file") else None


def write(folder: str, name: str, data: bytes) -> str:
    """Writes a file at once under its final name; its path."""
    path = f"{folder.rstrip('/')}/{name}"
    local = _local(path)
    if local is None:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        system.create_dir(os.path.dirname(inner), recursive=True)
        with system.open_output_stream(inner) as out:
            out.write(data)
        return path
    os.makedirs(os.path.dirname(local), exist_ok=True)
    part = f"{local}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, local)
    return path


def read(path: str) -> bytes:
    local = _local(path)
    if local is None:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        with system.open_input_stream(inner) as source:
            return source.read()
    with open(local, "rb") as source:
        return source.read()
