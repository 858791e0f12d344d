"""Files in the shared folder, written by tasks.

A task writes under a name of its own attempt and reports that name; only names that a
successful task reported are ever read, so a lost executor leaves at most an orphan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs

from .common import local_path


def _system(path: str) -> tuple[fs.FileSystem, str]:
    local = local_path(path)
    return (fs.LocalFileSystem(), local) if local else fs.FileSystem.from_uri(path)


def write(folder: str, stem: str, parts: list[bytes], suffix: str = "") -> str:
    """Write the parts one after another to a new file of the folder; returns its path."""
    name = f"{folder}/{stem}-{uuid.uuid4().hex[:12]}{suffix}"
    system, path = _system(name)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        for part in parts:
            out.write(part)
    return name


@contextmanager
def writer(folder: str, stem: str, suffix: str = "") -> Iterator[tuple[str, pa.NativeFile]]:
    """(path, stream) of a new file of the folder, to be written part by part."""
    name = f"{folder}/{stem}-{uuid.uuid4().hex[:12]}{suffix}"
    system, path = _system(name)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        yield name, out


def opened(path: str) -> pa.NativeFile:
    """The file for reads at places of its own; nothing else of it is fetched."""
    system, at = _system(path)
    return system.open_input_file(at)


def replace(path: str, data: bytes) -> None:
    """Write a file of the driver under its name, in place of what was there; readers see the old or the new one."""
    system, at = _system(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    new = f"{at}-{uuid.uuid4().hex[:12]}"
    with system.open_output_stream(new, compression=None) as out:
        out.write(data)
    system.move(new, at)


def view(path: str) -> pa.Buffer:
    """The file's bytes: memory-mapped if the folder is mounted, else read."""
    local = local_path(path)
    if local:
        return pa.memory_map(local).read_buffer()
    system, at = _system(path)
    with system.open_input_file(at) as f:
        return f.read_buffer()
