"""Files in the shared folder: temporary names, renames and manifests, on a shared disk or any store pyarrow opens."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyarrow import fs


def of(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(use_mmap=True), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def temporary(folder: str) -> str:
    """A name of its own for each attempt of a task, so that attempts never write to one file."""
    return f"{folder}/_tmp/{uuid.uuid4().hex}"


def create(path: str):
    where, name = of(path)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    return where.open_output_stream(name)


def finish(folder: str, temporary_name: str, name: str) -> None:
    """Gives a file that a task has written its final name. A second attempt at the same task has written the same bytes, so that
    it does no harm if it replaces the file."""
    where, base = of(folder)
    if where.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:  # some stores don't rename over a file
        where.delete_file(f"{base}/{name}")
    where.move(of(temporary_name)[1], f"{base}/{name}")


def commit(folder: str, manifest: dict[str, Any]) -> None:
    """Deletes what unfinished attempts left and writes the manifest last: a folder without a manifest isn't complete, and nothing
    reads it; a file that isn't in the manifest isn't part of it. May be repeated."""
    where, base = of(folder)
    where.create_dir(base, recursive=True)
    if where.get_file_info(f"{base}/_tmp").type != fs.FileType.NotFound:
        where.delete_dir(f"{base}/_tmp")
    with where.open_output_stream(f"{base}/_manifest.tmp") as f:
        f.write(json.dumps(manifest).encode())
    where.move(f"{base}/_manifest.tmp", f"{base}/manifest.json")


def manifest(folder: str) -> dict[str, Any]:
    where, base = of(folder)
    with where.open_input_file(f"{base}/manifest.json") as f:
        return json.loads(f.read())


def read(path: str):
    """The bytes of a file: memory-mapped where it lies on a disk."""
    where, name = of(path)
    with where.open_input_file(name) as f:
        return f.read_buffer()
