"""Shard folders: catalog, writing, reading and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.pack import HEADER_BYTES, out_of_range
from millrace.sources.manifest import list_files, shard_triples
from millrace.sources.paths import shared
from millrace.sources.tokshard import DIGITS, PREFIX, TokshardDataSource, current_shards

TASK_BYTES = 256 << 20
META_SCHEMA = "num_sequences long, seq_length long, source string"


def register(spark: SparkSession) -> None:
    """Makes the ``tokshard`` format known to the session."""
    spark.dataSource.register(TokshardDataSource)


def read_shards(spark: SparkSession, path: str, **options) -> DataFrame:
    """``(shard_id, shard, seq_in_shard, tokens)``, or headers or index entries by ``part``."""
    register(spark)
    return spark.read.format("tokshard").options(**options).load(shared(spark, path))


def write_shards(
    sequences: DataFrame, path: str, n_shards: int, shard_bytes: int, mode: str = "append", **options
) -> None:
    """Writes ``(shard_id, seq_in_shard, tokens, num_sequences)`` as shard files.

    Pieces of shards, ``(shard_id, first, tokens, num_sequences, seq_length)``, are written as well;
    this is the one shuffle of their ids.  Shard ids run from 0 to ``n_shards - 1``.  Rows go straight to the partition
    of their shard, so that no two shards fall together by hash.  A task writes
    one shard, or neighbouring ones as long as they stay below ``TASK_BYTES``.
    """
    spark = sequences.sparkSession
    register(spark)
    by_size = -(-n_shards * shard_bytes // TASK_BYTES)
    tasks = max(1, min(n_shards, max(by_size, 2 * spark.sparkContext.defaultParallelism)))
    place = "first" if "first" in sequences.columns else "seq_in_shard"
    columns = ["shard_id", place, "tokens", "num_sequences", *(["seq_length"] if place == "first" else [])]
    task = F.floor(F.col("shard_id").cast("long") * tasks / max(1, n_shards)).cast("int")
    (
        sequences.select(*columns)
        .repartitionById(tasks, task)
        .sortWithinPartitions("shard_id", place)
        .write.format("tokshard")
        .options(**{"digits": max(DIGITS, len(str(n_shards - 1))), **options})
        .mode(mode)
        .save(shared(spark, path))
    )


def read_metas(spark: SparkSession, path: str, prefix: str = PREFIX) -> DataFrame:
    """The ``.meta`` files with their shard name."""
    return (
        spark.read.schema(META_SCHEMA)
        .option("multiLine", True)
        .option("pathGlobFilter", f"{prefix}_*.meta")
        .json(path)
        .select(
            F.regexp_extract("_metadata.file_name", r"^(.*)\.meta$", 1).alias("shard"),
            "num_sequences",
            "seq_length",
            "source",
        )
    )


def _listed_triples(spark, path, prefix):
    """The shard files of a folder; those of its latest generation if it has generations (one name per shard)."""
    triples = shard_triples(list_files(spark, path), prefix).filter(~F.col("stem").contains("/"))
    names = current_shards(shared(spark, path), prefix)
    if names is None:
        return triples
    listed = spark.createDataFrame([(n,) for n in names], "stem string")
    return listed.join(triples, "stem", "left").fillna(False, ["has_index", "has_meta"])


def shard_catalog(spark: SparkSession, path: str, prefix: str = PREFIX) -> DataFrame:
    """``(shard_id, shard, num_sequences, seq_length, source)`` in name order.

    Fails if there is no shard or a shard lacks its index or meta file.  The
    numbering window sees one short row per shard.
    """
    triples = _listed_triples(spark, path, prefix)
    state = triples.agg(
        F.count("*").alias("n"),
        F.min(F.when(~(F.col("has_index") & F.col("has_meta")), F.col("stem"))).alias("bad"),
    ).first()
    if state["n"] == 0:
        raise FileNotFoundError(f"no shards {prefix}_*.bin in {path}")
    if state["bad"] is not None:
        raise FileNotFoundError(f"index or meta file missing for {state['bad']}.bin")
    metas = triples.select(F.col("stem").alias("shard")).join(
        read_metas(spark, path, prefix), "shard"
    )
    return number_shards(metas)


def number_shards(shards: DataFrame) -> DataFrame:
    """Adds ``shard_id``, the place of ``shard`` in name order."""
    place = F.row_number().over(Window.orderBy("shard")) - 1
    return shards.withColumn("shard_id", place)


def validate_shards(
    spark: SparkSession, path: str, vocab_size: int | None = None, **options
) -> DataFrame:
    """One row per shard and rule: ``(shard, rule, ok)``.

    Headers, index entries, metas and ids are four scans, each reduced to one row
    per shard before they meet.  A shard that cannot be read at all fails the
    rules that need it.  ``vocab_size`` adds a scan of the bodies.
    """
    prefix = options.get("prefix", PREFIX)
    files = _listed_triples(spark, path, prefix)
    headers = read_shards(spark, path, part="header", **options).drop("shard_id")
    metas = read_metas(spark, path, prefix).select(
        "shard",
        F.col("num_sequences").alias("meta_n"),
        F.col("seq_length").alias("meta_length"),
    )
    base = (
        files.withColumnRenamed("stem", "shard")
        .join(headers, "shard")
        .join(metas, "shard", "left")
    )
    base = base.join(_index_facts(spark, path, options), "shard", "left")
    if vocab_size is not None:
        base = base.join(_id_facts(spark, path, vocab_size, options), "shard", "left")
    ids = F.try_multiply(F.col("num_sequences"), F.col("seq_length"))
    expected = F.try_add(F.lit(HEADER_BYTES).cast("long"), F.try_multiply(F.lit(4).cast("long"), ids))
    checks = {
        "magic": F.col("magic_ok"),
        "header_size": F.col("header_bytes") == HEADER_BYTES,
        "index_present": F.col("has_index"),
        "meta_present": F.col("has_meta"),
        "file_size": F.col("file_bytes") == expected,
        "index_entries": (F.col("entries") == F.col("index_n"))
        & (F.col("bad_entries") == 0)
        & (F.col("index_length") == F.col("seq_length")),
        "counts_agree": (F.col("num_sequences") == F.col("index_n"))
        & (F.col("num_sequences") == F.col("meta_n"))
        & (F.col("seq_length") == F.col("meta_length")),
    }
    if vocab_size is not None:
        none = F.lit(0)
        checks["id_range"] = (F.coalesce("bad_ids", none) == 0) & (
            F.coalesce("rows_read", none) == F.col("num_sequences")
        )
    return base.select(
        "shard",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(r).alias("rule"), F.coalesce(c, F.lit(False)).alias("ok"))
                    for r, c in checks.items()
                ]
            )
        ),
    )


def _index_facts(spark, path, options):
    """Per shard: what the index says, its entries, and entries in the wrong place.

    Entries are judged by the index's own sequence length, so they are reduced
    to a row per shard in the task that reads them.
    """
    length = F.col("index_seq_length")
    before = F.try_multiply(F.lit(4).cast("long"), F.try_multiply(length, F.col("seq_in_shard")))
    place = F.try_add(F.lit(HEADER_BYTES).cast("long"), before)
    wrong = ~F.col("offset").eqNullSafe(place) | (F.col("length") != length)
    return (
        read_shards(spark, path, part="index", tolerant="true", **options)
        .groupBy("shard")
        .agg(
            F.max("index_n").alias("index_n"),
            F.max(length).alias("index_length"),
            F.count("*").alias("entries"),
            F.count_if(wrong).alias("bad_entries"),
        )
    )


def _id_facts(spark, path, vocab_size, options):
    """Per shard: sequences that could be read and ids outside the vocabulary.

    The body is read as bigint so that ids from 2**31 show.
    """
    return (
        read_shards(spark, path, wide="true", tolerant="true", **options)
        .groupBy("shard")
        .agg(
            F.sum(out_of_range(F.col("tokens"), vocab_size)).alias("bad_ids"),
            F.count("*").alias("rows_read"),
        )
    )
