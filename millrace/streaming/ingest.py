"""Incremental ingest with Structured Streaming.

Each query reads a folder that grows, runs to the end of what is there, and goes
on from its checkpoint next time.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.clean import clean, count_tokens, drop_uncounted
from millrace.operators.dedup import text_key
from millrace.sources.corpora import Corpus, open_corpus

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_corpus(
    spark: SparkSession, corpus: Corpus, files_per_trigger: int | None = None
) -> DataFrame:
    """Streaming ``(domain, doc_seq, text)``; the corpus needs a schema."""
    options = dict(corpus.options)
    if files_per_trigger:
        options["maxFilesPerTrigger"] = files_per_trigger
    return open_corpus(spark, dataclasses.replace(corpus, options=options), stream=True)


def cleaned_stream(raw: DataFrame, tokenizer) -> DataFrame:
    """Clean, count and drop what has no tokens: all per document, batch or stream."""
    return drop_uncounted(count_tokens(clean(raw), tokenizer))


def ingest(
    spark: SparkSession, corpus: Corpus, tokenizer, mode: str = "batch",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Cleaned and counted documents of a corpus, as a table or as a stream."""
    if mode == "batch":
        return cleaned_stream(open_corpus(spark, corpus), tokenizer)
    if mode == "stream":
        return cleaned_stream(stream_corpus(spark, corpus, files_per_trigger), tokenizer)
    raise ValueError(f"mode must be 'batch' or 'stream', not {mode!r}")


def start_ingest(
    docs: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Writes a document stream to parquet, exactly once.

    Runs until the input ends, or for good with a micro-batch ``every`` interval
    (such as ``"120 seconds"``), which is then the cadence of snapshots.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        docs.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(path)
    )


def distinct_texts(docs: DataFrame, scope: str = "domain", text: str = "text_norm") -> DataFrame:
    """The first-arriving document of every text, for a stream of any length.

    The state is one 32-byte hash per distinct text, spread over the shuffle
    partitions by hash; a repeated text adds none.  Use the RocksDB state store
    (``use_rocksdb``) so that the state need not fit in memory.
    """
    hashed = docs.withColumn("text_key", text_key(text))
    return hashed.dropDuplicates(["domain", "text_key"] if scope == "domain" else ["text_key"])


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def text_hex(key: str = "text_key"):
    return F.lower(F.hex(key))
