"""File listings: which files lie below a folder, and which shards are complete."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.paths import qualified

# Folders left out of a manifest at any depth.
IGNORED_FOLDERS = ["locks", "logs", "state"]


def folders_of(rel_path: Column) -> Column:
    """The folder names on a relative path, without the file name."""
    parts = F.split(rel_path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def prune_ignored(files: DataFrame, ignored: list[str] = IGNORED_FOLDERS) -> DataFrame:
    """Drops files with an ignored folder anywhere on ``rel_path``."""
    names = F.array(*[F.lit(n) for n in ignored])
    return files.filter(~F.arrays_overlap(folders_of(F.col("rel_path")), names))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(rel_path, length)`` of all files below ``root``; no content is read.

    A listed file that is not below ``root`` is an error.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "length")
    )
    store = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    base = re.sub(store, "", qualified(spark, root)).rstrip("/") + "/"
    path = F.regexp_replace("path", store, "")
    below = path.substr(F.lit(len(base) + 1), F.length(path))
    stray = F.raise_error(F.concat(F.lit(f"not below {base}: "), "path"))
    return listing.select(F.when(path.startswith(base), below).otherwise(stray).alias("rel_path"), "length")


def manifest(spark: SparkSession, root: str, ignored: list[str] = IGNORED_FOLDERS) -> DataFrame:
    """Files to publish from ``root``."""
    return prune_ignored(list_files(spark, root), ignored)


def shard_triples(files: DataFrame, prefix: str = "shard") -> DataFrame:
    """Per ``.bin`` file: whether its ``.idx`` and ``.meta`` are there too.

    ``files`` has ``rel_path``.  One aggregation by stem, three files per key.
    """
    stem = F.regexp_extract("rel_path", rf"^((?:.*/)?{prefix}_[^/]*)\.(bin|idx|meta)$", 1)
    suffix = F.regexp_extract("rel_path", r"\.(bin|idx|meta)$", 1)
    return (
        files.select(stem.alias("stem"), suffix.alias("suffix"))
        .filter(F.col("stem") != "")
        .groupBy("stem")
        .agg(
            F.bool_or(F.col("suffix") == "bin").alias("_bin"),
            F.bool_or(F.col("suffix") == "idx").alias("has_index"),
            F.bool_or(F.col("suffix") == "meta").alias("has_meta"),
        )
        .filter("_bin")
        .drop("_bin")
    )
