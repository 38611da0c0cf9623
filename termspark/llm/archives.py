"""Archive folders that tasks write: each task attempt writes files of its own, and a commit lists those that count.

Files go through pyarrow's file systems, so a folder may be a path or any URI they know. A lost or repeated attempt leaves
files that no commit names; readers look at committed files only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from termspark.llm.common import cut

COMMIT = "_COMMITTED"
#: Schemes that Hadoop and pyarrow name differently.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI, resolved as Spark resolves its paths: a path without a scheme belongs to the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a folder given as a path or URI."""
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    scheme, rest = folder.split("://", 1)
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def new_file(folder: str, suffix: str) -> tuple[str, pafs.FileSystem, str]:
    """(name, file system, path) of a file that no other attempt writes."""
    fs, path = store(folder)
    fs.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return name, fs, f"{path}/{name}"


def commit(folder: str, written: DataFrame, column: str = "archive") -> DataFrame:
    """Run the writing job `written` once, then list the files named in its column; returns its rows, written and reread.

    One name per file passes the driver, as planning a scan of the folder would need as well.
    """
    rows = cut(written)
    fs, path = store(folder)
    fs.create_dir(path, recursive=True)
    names: Iterator[str] = (r[0] for r in rows.select(column).distinct().toLocalIterator())
    with fs.open_output_stream(f"{path}/{COMMIT}") as out:
        for name in names:
            out.write(f"{name}\n".encode())
    return rows


def committed(folder: str) -> list[tuple[str, int]]:
    """(name, bytes) of the files that count, by name."""
    fs, path = store(folder)
    with fs.open_input_stream(f"{path}/{COMMIT}") as f:
        names = sorted(f.read().decode().split())
    sizes = {i.base_name: i.size for i in fs.get_file_info(pafs.FileSelector(path))}
    return [(n, sizes[n]) for n in names]
