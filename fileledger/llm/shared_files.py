"""Small files in the folder all executors share, on whatever file system it is."""

from __future__ import annotations

import uuid

import pyarrow.fs
from pyspark.sql import SparkSession

from fileledger.session import shared_folder


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder name not used before; the folder belongs to whoever owns the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def open_folder(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def write_file(folder: str, name: str, attempt: int, content: bytes) -> None:
    """Write under a name of the attempt's own, then rename: a task run twice leaves one whole file."""
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/.{name}.{attempt}") as file:
        file.write(content)
    system.move(f"{path}/.{name}.{attempt}", f"{path}/{name}")


def read_file(folder: str, name: str) -> bytes:
    system, path = open_folder(folder)
    with system.open_input_file(f"{path}/{name}") as file:
        return file.read()
