"""Files that tasks write to the shared folder, and reading them back with Spark.

A file is written under a name of its own and renamed when complete; the final name depends on the partition only, so a task that runs
again after a lost executor, or twice, replaces a file by an equal one and leaves no half file behind.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

FILE_BYTES = 16 << 20  # a file is read back as one row


def uri(path: str) -> str:
    return path if "://" in path or path.startswith("/") else f"/{path.removeprefix('file:').lstrip('/')}"


def write_file(folder: str, name: str, data: bytes) -> None:
    store, root = fs.FileSystem.from_uri(uri(folder))
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{root}/{name}")


def make_folder(folder: str) -> str:
    """The folder itself, so that it can be read even if no task has anything to write."""
    store, root = fs.FileSystem.from_uri(uri(folder))
    store.create_dir(root, recursive=True)
    return folder


def read_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, content) of the files, one row each."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
