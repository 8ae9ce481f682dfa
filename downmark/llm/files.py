"""Binary files in the shared folder, read and written by tasks.

Paths are as Spark names them.  ``file:`` paths and plain ones are a mounted folder
and can be memory-mapped; any other scheme goes through pyarrow's file systems.
"""

from __future__ import annotations

import mmap
import os

import pyarrow.fs as pafs


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    return path if "://" not in path else None


def write_whole(path: str, data: bytes) -> None:
    """Write under a name of its own first, so that no reader meets half a file."""
    local = _local(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(f"{local}.part", "wb") as out:
            out.write(data)
        os.replace(f"{local}.part", local)
        return
    system, inner = pafs.FileSystem.from_uri(path)
    with system.open_output_stream(f"{inner}.part") as out:
        out.write(data)
    system.move(f"{inner}.part", inner)


def open_mapped(path: str) -> memoryview:
    """The file's bytes, memory-mapped where the folder is mounted."""
    local = _local(path)
    if local is not None:
        with open(local, "rb") as f:
            return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    system, inner = pafs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as f:
        return memoryview(f.read_buffer())
