"""Streaming queries: run to the end of the input, then the stored result."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.clean import measure
from millrace.plans.documents import BATCH, KEPT, MEASURED, QUOTA, WORDS, raw_documents, scanned_sql
from millrace.plans.logs import PROGRESS, STALL_SECONDS, progress_log
from millrace.plans.mixture import plan_from_documents
from millrace.plans.registry import query
from millrace.session import materialize, scratch_path
from millrace.sources.corpora import Corpus
from millrace.streaming.ingest import (
    cleaned_stream,
    distinct_texts,
    start_ingest,
    stream_corpus,
    text_hex,
    use_rocksdb,
)
from millrace.streaming.quota import start_quota
from millrace.streaming.stall import stall_warnings

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
FILES = 3


def by_ranges(df, order: str, files: int):
    """The rows of ``files`` ranges of ``order``, one after the other."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    width = (high - low) / files
    for i in range(files):
        after = F.col(order) >= low + i * width
        before = F.col(order) < low + (i + 1) * width if i + 1 < files else F.lit(True)
        yield df.filter(after & before)


def landed(spark, df, order: str, files: int = FILES) -> str:
    """A small table as a folder of files that arrive one after the other, by ranges of ``order``."""
    path = scratch_path(spark, "landed")
    for part in by_ranges(df, order, files):
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def on_arrivals(spark, df, order: str, start, arrivals: int = FILES) -> None:
    """Lands the table by ranges of ``order`` and runs the query ``start(path)`` to its end after each.

    The query goes on from its checkpoint, so a range is a micro-batch.  A range is written by as many
    tasks as the table is read by, a file each, whose order within the micro-batch does not count.
    """
    path = scratch_path(spark, "landed")
    for part in by_ranges(df, order, arrivals):
        part.write.mode("append").parquet(path)
        finish(start(path))


def on_documents(spark, sf_dir, start) -> None:
    """Runs the query ``start(stream)`` on documents that arrive by ranges of their id."""

    def run(path):
        corpus = Corpus("source", [path], seq="doc_id", schema=DOCUMENTS, domain_is_expr=True)
        return start(stream_corpus(spark, corpus))

    on_arrivals(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", run)


def finish(query):
    query.awaitTermination()


@query(f"WITH {MEASURED} SELECT domain, doc_seq, n_tokens, md5(text_norm) AS text_md5 FROM m WHERE survivor")
def stream_ingest(spark, sf_dir):
    out, checkpoint = scratch_path(spark, "ingested"), scratch_path(spark, "checkpoint")
    on_documents(spark, sf_dir, lambda raw: start_ingest(cleaned_stream(raw, WORDS), out, checkpoint))
    return spark.read.parquet(out).select(
        "domain", "doc_seq", F.col("n_tokens").cast("long").alias("n_tokens"),
        F.md5("text_norm").alias("text_md5"),
    )


@query(f"WITH {MEASURED} SELECT DISTINCT domain, sha256(text_norm) AS text_sha FROM m WHERE survivor")
def stream_dedup(spark, sf_dir):
    use_rocksdb(spark)
    out, checkpoint = scratch_path(spark, "distinct"), scratch_path(spark, "checkpoint")
    on_documents(
        spark, sf_dir, lambda raw: start_ingest(distinct_texts(cleaned_stream(raw, WORDS)), out, checkpoint)
    )
    return spark.read.parquet(out).select("domain", text_hex().alias("text_sha"))


@query(f"WITH {scanned_sql(BATCH)} {KEPT}")
def stream_quota(spark, sf_dir):
    plan = materialize(plan_from_documents(raw_documents(spark, sf_dir), QUOTA, BATCH), "plan")
    out, ledger, checkpoint = (scratch_path(spark, name) for name in ("kept", "ledger", "checkpoint"))
    on_documents(spark, sf_dir, lambda raw: start_quota(measure(raw, WORDS), plan, out, ledger, checkpoint))
    return spark.read.parquet(out).select("domain", "doc_seq", "n_tokens")


@query(f"""WITH RECURSIVE {PROGRESS},
warned AS (
  SELECT domain, total_tokens, last_gain, min(ts) AS warned_at FROM gains
  WHERE ts - last_gain > {STALL_SECONDS} GROUP BY ALL
  UNION ALL
  SELECT domain, total_tokens, last_gain, warned_at FROM (
    SELECT g.domain, g.total_tokens, g.last_gain, g.ts AS warned_at, w.warned_at AS before,
      row_number() OVER (PARTITION BY g.domain, g.total_tokens ORDER BY g.ts) AS r
    FROM warned w JOIN gains g USING (domain, total_tokens)
    WHERE g.ts - w.warned_at > {STALL_SECONDS}) WHERE r = 1)
SELECT domain, total_tokens, last_gain, warned_at FROM warned""")
def stream_stalls(spark, sf_dir):
    """All warnings of a pause, the timer starting again after each."""
    log = materialize(progress_log(spark, sf_dir), "progress-log")
    out, checkpoint = scratch_path(spark, "warnings"), scratch_path(spark, "checkpoint")

    def run(path):
        stream = spark.readStream.schema(log.schema).parquet(path)
        return start_ingest(stall_warnings(stream, STALL_SECONDS), out, checkpoint)

    on_arrivals(spark, log, "ts", run)
    return spark.read.parquet(out)
