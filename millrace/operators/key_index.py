"""Exact duplicates across runs, by an index of text keys that grows run by run.

The index has a folder per run: the 32-byte keys of the run's texts, sorted by bucket (the first byte) and key, so that
files and row groups of other buckets are skipped by their statistics, and for each bucket a bitmap over a hash of the keys.  A later run looks its own distinct keys up: first
in the merged bitmaps (a bit per key and a few more), then what may be there, in the buckets concerned.  Texts take no part.
Runs that no ledger names are ignored, so one that died leaves nothing behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.dedup import text_key
from millrace.session import materialize

FILTER_BITS = 26  # log2 of the bits of a bucket's bitmap; fuller ones pass more keys on to the exact lookup
KEYS = "scope string, key binary, bucket int"
FILTERS = "bucket int, word long, bits long"


def with_key(docs: DataFrame, scope: str, text: str = "text_norm") -> DataFrame:
    """Adds ``scope`` (the domain, or empty for ``global``) and ``key``, the text's SHA-256."""
    if scope not in ("domain", "global"):
        raise ValueError(f"scope must be 'domain' or 'global', not {scope!r}")
    return docs.withColumns({"scope": F.col("domain") if scope == "domain" else F.lit(""), "key": text_key(text)})


def _placed(keys: DataFrame) -> DataFrame:
    """Adds the key's ``bucket`` and its ``word`` and ``bit`` in the bucket's bitmap."""
    place = F.xxhash64("scope", "key").bitwiseAND((1 << FILTER_BITS) - 1)
    bucket = F.conv(F.hex(F.substring("key", 1, 1)), 16, 10).cast("int")
    placed = keys.withColumns({"bucket": bucket, "_place": place})
    bit = F.expr("shiftleft(1L, CAST(_place & 63 AS INT))")
    return placed.withColumns({"word": F.shiftright("_place", 6), "bit": bit}).drop("_place")


def _folders(path: str, part: str, runs: list[int]) -> list[str]:
    return [f"{path}/{part}/run={run:06d}" for run in runs]


def append_keys(keys: DataFrame, path: str, run: int) -> None:
    """Writes the run's distinct ``(scope, key)`` rows and their bitmaps; replaces what an earlier attempt wrote."""
    placed = materialize(_placed(keys.select("scope", "key").distinct()), "run-keys")
    order = ["bucket", "key"]
    dealt = placed.select("scope", "key", "bucket").repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").parquet(_folders(path, "keys", [run])[0])
    bits = placed.groupBy("bucket", "word").agg(F.bit_or("bit").alias("bits"))
    bits.write.mode("overwrite").parquet(_folders(path, "filters", [run])[0])


def indexed(spark: SparkSession, path: str, run: int) -> bool:
    """Whether the run wrote keys; runs without ``dedup`` have none."""
    name = spark._jvm.org.apache.hadoop.fs.Path(f"{_folders(path, 'filters', [run])[0]}/_SUCCESS")
    return name.getFileSystem(spark._jsc.hadoopConfiguration()).exists(name)


def seen(keys: DataFrame, path: str, runs: list[int]) -> DataFrame:
    """Those of the ``(scope, key)`` rows that the index has from the given runs."""
    spark: SparkSession = keys.sparkSession
    if not runs:
        return keys.limit(0)
    words = spark.read.schema(FILTERS).parquet(*_folders(path, "filters", runs))
    merged = words.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    set_there = F.col("bits").bitwiseAND(F.col("bit")) != 0
    maybe = _placed(keys).join(merged, ["bucket", "word"]).filter(set_there).select("scope", "key", "bucket")
    maybe = materialize(maybe, "maybe-seen")
    buckets = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]  # one byte: 256 rows at most
    if not buckets:
        return keys.limit(0)
    return maybe.join(_index(spark, path, runs, buckets), ["bucket", "scope", "key"], "left_semi").drop("bucket")


def _index(spark: SparkSession, path: str, runs: list[int], buckets: list[int]) -> DataFrame:
    """The keys of the buckets; row groups of others are not read."""
    return spark.read.schema(KEYS).parquet(*_folders(path, "keys", runs)).filter(F.col("bucket").isin(buckets))


def first_unseen(docs: DataFrame, path: str, runs: list[int], order: list[Column]) -> DataFrame:
    """``(domain, doc_seq, scope, key)`` of the first document, in ``order``, of each text no earlier run has.

    ``docs`` comes from :func:`with_key`.
    """
    place = [o.alias(f"_order{k}") for k, o in enumerate(order)]
    first = F.min(F.struct(*place, "domain", "doc_seq")).alias("_first")
    firsts = materialize(docs.groupBy("scope", "key").agg(first), "first-copies")
    fresh = firsts.join(seen(firsts.select("scope", "key"), path, runs), ["scope", "key"], "left_anti")
    return fresh.select("_first.domain", "_first.doc_seq", "scope", "key")
