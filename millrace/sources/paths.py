"""One way from a folder name to a file system, for driver and tasks alike."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority Spark's own readers would use for it."""
    jvm = spark._jvm
    name = jvm.org.apache.hadoop.fs.Path(path)
    system = name.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(name).toString()


def shared(spark: SparkSession, path: str) -> str:
    """The qualified path; one that means a local disk only by default is refused on a cluster.

    What lies below ``spark.checkpoint.dir`` is taken: that folder is shared, however it is written.
    """
    full = qualified(spark, path)
    master = spark.conf.get("spark.master", "")
    local = full.startswith("file:") and not path.startswith("file:") and not master.startswith("local")
    if local and not _in_checkpoints(spark, full):
        raise ValueError(f"{full} is local to each machine; name a folder all executors share")
    return full


def _in_checkpoints(spark: SparkSession, full: str) -> bool:
    root = spark.conf.get("spark.checkpoint.dir", None)
    return bool(root) and full.startswith(qualified(spark, root).rstrip("/") + "/")


def arrow_uri(path: str) -> str:
    """The URI Arrow's file systems know for a path qualified by Hadoop's."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    if scheme in ("s3a", "s3n"):
        scheme = "s3"
    if scheme == "file":
        rest = "///" + rest.lstrip("/")
    return f"{scheme}:{rest}"


def open_fs(path: str):
    """Arrow file system and path in it, for plain paths and URIs."""
    path = arrow_uri(path)
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def replace_file(path: str, text: str) -> None:
    """Writes a small file so that readers see the old or the new content, never a part of it."""
    fs, name = open_fs(path)
    folder, _, base = name.rpartition("/")
    fs.create_dir(folder, recursive=True)
    draft = f"{folder}/.{base}-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        f.write(text.encode())
    try:
        fs.move(draft, name)
    except OSError:  # stores that do not rename onto a file
        fs.delete_file(name)
        fs.move(draft, name)
