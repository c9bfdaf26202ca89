"""Files in shared folders, from the driver and from Python workers.

Local and mounted folders are opened directly; any other scheme goes through
``pyarrow.fs``. A file appears under its name only when it is complete, so a
task that is lost and repeated leaves either nothing or the same file.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    if parsed.scheme == "":
        return uri
    return unquote(parsed.path) if parsed.scheme == "file" else None


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextmanager
def new_file(uri: str):
    """A binary file to write to, which appears at ``uri`` at the end; after an error nothing does."""
    path, part = _local(uri), f".{uuid.uuid4().hex}.part"
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        try:
            with open(path + part, "wb") as f:
                yield f
            os.replace(path + part, path)
        except BaseException:
            if os.path.exists(path + part):
                os.remove(path + part)
            raise
        return
    system, path = _remote(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(path + part) as f:
        yield f
    system.move(path + part, path)


def write_file(uri: str, chunks) -> int:
    """Write ``chunks`` (bytes) to a file that appears at ``uri`` when all are written; returns its size."""
    size = 0
    with new_file(uri) as f:
        for c in chunks:
            f.write(c)
            size += len(c)
    return size


def open_file(uri: str):
    """A seekable binary file."""
    path = _local(uri)
    if path is not None:
        return open(path, "rb")
    system, path = _remote(uri)
    return system.open_input_file(path)


def read_file(uri: str) -> bytes:
    with open_file(uri) as f:
        return f.read()


def rename(old: str, new: str) -> None:
    path = _local(old)
    if path is not None:
        os.replace(path, _local(new))
    else:
        system, path = _remote(old)
        system.move(path, _remote(new)[1])


def remove(uri: str) -> None:
    path = _local(uri)
    if path is not None:
        if os.path.exists(path):
            os.remove(path)
    else:
        system, path = _remote(uri)
        system.delete_file(path)


def list_files(uri: str) -> list[tuple[str, int]]:
    """(uri, size) of the files in a folder, or of the one file at ``uri``, by name."""
    path = _local(uri)
    if path is not None:
        if os.path.isfile(path):
            return [(uri, os.path.getsize(path))]
        names = sorted(os.listdir(path)) if os.path.isdir(path) else []
        return [(f"{uri.rstrip('/')}/{n}", os.path.getsize(os.path.join(path, n))) for n in names if os.path.isfile(os.path.join(path, n))]
    from pyarrow import fs

    system, path = _remote(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    found = system.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else []
    return sorted((f"{uri.rstrip('/')}/{x.base_name}", x.size) for x in found if x.type == fs.FileType.File)


def walk_files(uri: str) -> Iterator[tuple[str, int]]:
    """(uri, size) of the files in a folder and all below it, or of the one file at ``uri``; hidden ones are left out."""
    path = _local(uri)
    if path is not None:
        if os.path.isfile(path):
            yield uri, os.path.getsize(path)
        for folder, below, names in os.walk(path):
            below[:] = sorted(b for b in below if b[0] not in "._")
            inside = os.path.relpath(folder, path)
            for n in sorted(n for n in names if n[0] not in "._"):
                yield "/".join([uri.rstrip("/"), *([] if inside == "." else [inside]), n]), os.path.getsize(os.path.join(folder, n))
        return
    from pyarrow import fs

    system, path = _remote(uri)
    if system.get_file_info(path).type == fs.FileType.File:
        yield uri, system.get_file_info(path).size
        return
    for x in sorted(system.get_file_info(fs.FileSelector(path, recursive=True)), key=lambda x: x.path):
        inside = x.path[len(path) :].strip("/")
        if x.type == fs.FileType.File and not any(p[0] in "._" for p in inside.split("/")):
            yield f"{uri.rstrip('/')}/{inside}", x.size
