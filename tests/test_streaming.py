"""Streams against the batch operators, with restarts and failures in between."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions.tokenizers import WordTokenizer
from millrace.operators.clean import clean, measure
from millrace.operators.quota import apply_quota
from millrace.plans import streams
from millrace.plans.registry import QUERIES
from millrace.plans.streams import landed
from millrace.session import scratch_path
from millrace.sources.corpora import Corpus
from millrace.streaming import quota as stream_quota
from millrace.streaming.ingest import (
    cleaned_stream,
    distinct_texts,
    ingest,
    start_ingest,
    stream_corpus,
)
from millrace.streaming.stall import stall_warnings

WORDS = WordTokenizer()
SCHEMA = "domain string, doc_seq long, text string"


def documents(spark, low, high):
    rows = []
    for i in range(low, high):
        text = "short" if i % 11 == 0 else f"text {i % 17} " + "word " * (50 + i % 23)
        rows.append((f"d{i % 3}", i, text))
    return spark.createDataFrame(rows, SCHEMA)


def corpus(path):
    return Corpus("domain", [path], schema=SCHEMA, domain_is_expr=True)


def land(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for low, high in ((0, 40), (40, 70), (70, 120)):
        land(documents(spark, low, high), source)
        docs = ingest(spark, corpus(source), WORDS, "stream", 1)
        start_ingest(docs, out, check).awaitTermination()
    got = spark.read.parquet(out).select("domain", "doc_seq", "n_tokens").collect()
    whole = ingest(spark, corpus(source), WORDS)
    want = whole.select("domain", "doc_seq", "n_tokens").collect()
    assert whole.count() == clean(documents(spark, 0, 120)).count()
    assert sorted(got) == sorted(want)


def test_dedup_across_restarts(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for low, high in ((0, 40), (40, 200)):
        land(documents(spark, low, high), source)
        docs = distinct_texts(cleaned_stream(stream_corpus(spark, corpus(source), 1), WORDS))
        start_ingest(docs, out, check).awaitTermination()
    got = spark.read.parquet(out).select("domain", "text_norm").collect()
    want = clean(documents(spark, 0, 200)).select("domain", "text_norm").distinct().collect()
    assert sorted(got) == sorted(want)


def test_quota_survives_a_crash_between_documents_and_ledger(spark, tmp_path, monkeypatch):
    source, out, ledger, check = (str(tmp_path / n) for n in ("in", "out", "ledger", "check"))
    all_docs = documents(spark, 0, 200)
    path = landed(spark, all_docs, "doc_seq", files=4)
    plan = spark.createDataFrame(
        [("d0", 0, 1500, 5), ("d1", 1, 700, 1), ("d2", 2, 10**6, 7)],
        "domain string, plan_order int, quota long, batch int",
    )

    def run():
        docs = measure(stream_corpus(spark, corpus(path), 1), WORDS)
        stream_quota.start_quota(docs, plan, out, ledger, check).awaitTermination()

    real = stream_quota.append_ledger

    def dying(rows, where, batch_id):
        if batch_id == 2:
            raise RuntimeError("executor lost")
        real(rows, where, batch_id)

    monkeypatch.setattr(stream_quota, "append_ledger", dying)
    with pytest.raises(Exception, match="executor lost"):
        run()
    monkeypatch.setattr(stream_quota, "append_ledger", real)
    run()

    table = measure(all_docs, WORDS)
    want = apply_quota(table, table, plan).select("domain", "doc_seq", "n_tokens").collect()
    got = spark.read.parquet(out).select("domain", "doc_seq", "n_tokens").collect()
    assert sorted(got) == sorted(want)
    books = spark.read.parquet(ledger).groupBy("domain").agg(F.sum("tokens_added").alias("t"))
    totals = {}
    for r in want:
        totals[r["domain"]] = totals.get(r["domain"], 0) + r["n_tokens"]
    assert {r["domain"]: r["t"] for r in books.collect()} == totals


def test_stall_warnings_repeat_and_survive_micro_batches(spark, tmp_path):
    rows = [("a", float(t), 5 if t < 300 else 6) for t in range(0, 500, 20)]
    df = spark.createDataFrame(rows, "domain string, ts double, total_tokens long")
    path = landed(spark, df, "ts", files=3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    start_ingest(stall_warnings(stream, 60), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = [(r["last_gain"], r["warned_at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [(0.0, 80.0), (0.0, 160.0), (0.0, 240.0), (300.0, 380.0), (300.0, 460.0)]


def test_stall_warnings_do_not_depend_on_arrow_batches(spark, tmp_path):
    rows = [(d, float(t), 5 + t // 300) for t in range(0, 3000, 7) for d in ("a", "b")]
    df = spark.createDataFrame(rows[::-1], "domain string, ts double, total_tokens long")
    path = landed(spark, df, "ts", files=2)
    found = []
    for size in (20, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
            out = str(tmp_path / f"out{size}")
            start_ingest(stall_warnings(stream, 60), out, str(tmp_path / f"check{size}")).awaitTermination()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        found.append(sorted(tuple(r) for r in spark.read.parquet(out).collect()))
    want = []
    for domain in ("a", "b"):
        total = None
        for t in range(0, 3000, 7):
            if 5 + t // 300 != total:
                total, timer, gain = 5 + t // 300, t, t
            elif t - timer > 60:
                want.append((domain, total, float(gain), float(t)))
                timer = t
    assert found == [sorted(want)] * 2


def test_silent_source_is_reported(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 5)], "domain string, ts double, total_tokens long")
    land(df, str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        stall_warnings(stream, 1, watch_silence=True)
        .writeStream.format("memory").queryName("silence").outputMode("append")
        .trigger(processingTime="500 milliseconds")
        .option("checkpointLocation", str(tmp_path / "check"))
        .start()
    )
    try:
        for _ in range(60):
            query.awaitTermination(0.5)
            rows = spark.sql("SELECT * FROM silence").collect()
            if rows:
                break
    finally:
        query.stop()
    assert (rows[0]["domain"], rows[0]["total_tokens"], rows[0]["last_gain"]) == ("a", 5, 1.0)


@pytest.mark.parametrize("name", ["stream_ingest", "stream_dedup", "stream_quota"])
def test_no_task_lands_a_range_of_a_large_table(spark, tmp_path, monkeypatch, name):
    """Twelve files that are read by a task each; the results are those of one small file."""
    rows = documents(spark, 0, 240).selectExpr(
        "doc_seq AS doc_id", "text", "'en' AS lang", "domain AS source", "length(text) AS n_chars"
    )
    folders = []

    def named(session, what):
        folders.append((what, scratch_path(session, what)))
        return folders[-1][1]

    monkeypatch.setattr(streams, "scratch_path", named)
    found = []
    for files in (12, 1):
        sf_dir = tmp_path / str(files)
        rows.withColumn("n_chars", F.col("n_chars").cast("long")).repartition(files).write.parquet(str(sf_dir / "documents.parquet"))
        spark.conf.set("spark.sql.files.openCostInBytes", 128 << 20)
        try:
            found.append(sorted(map(tuple, QUERIES[name](spark, str(sf_dir)).collect())))
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found[0] == found[1] and found[0]
    places = [path for what, path in folders if what == "landed"]
    held = spark.read.parquet(places[0]).groupBy(F.input_file_name()).count()
    assert held.agg(F.max("count")).first()[0] < 40  # of 80 rows a range
    assert spark.read.parquet(places[0]).count() == 240
