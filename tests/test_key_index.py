"""Duplicates across runs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.tokenizers import WordTokenizer
from millrace.operators import key_index as ki
from millrace.operators.ledger import read_ledger
from millrace.plans import jobs
from millrace.plans.jobs import collect, committed_runs
from millrace.plans.mixture import Domain
from millrace.sources.corpora import Corpus, read_line_docs

SCHEMA = "domain string, doc_seq long, text string"


def texts(seed, low, high):
    """Texts of which many repeat, within a domain, across domains and across runs; one is a third of all."""
    r = random.Random(seed)
    pick = lambda: 0 if r.random() < 0.3 else r.randrange(60)
    return [(d, k, f"text number {pick()} " + "word " * 60) for d in ("web", "code") for k in range(low, high)]


def kept(spark, out, ledger):
    found = read_line_docs(spark, committed_runs(spark, out, ledger))
    return sorted((r["domain"], r["text"]) for r in found.collect())


def store(spark, rows, folder):
    for name in ("web", "code"):
        own = [r for r in rows if r[0] == name]
        spark.createDataFrame(own, SCHEMA).write.mode("append").parquet(f"{folder}/{name}")
    return [Corpus(n, [f"{folder}/{n}"]) for n in ("web", "code")]


@pytest.mark.parametrize("scope", ["domain", "global"])
def test_two_runs_equal_one_over_both_inputs(spark, tmp_path, scope, monkeypatch):
    domains = [Domain("web", 10**9), Domain("code", 10**9)]
    first, second = texts(1, 0, 90), texts(2, 90, 160)
    whole = store(spark, first + second, tmp_path / "all")
    collect(spark, domains, whole, WordTokenizer(), str(tmp_path / "o1"), str(tmp_path / "l1"), dedup=scope)
    out, ledger, index = (str(tmp_path / x) for x in ("o2", "l2", "index"))
    collect(spark, domains, store(spark, first, tmp_path / "two"), WordTokenizer(), out, ledger, dedup=scope, key_index=index)

    # A second run that dies before its ledger row leaves its keys behind; they do not count.
    catalog = store(spark, second, tmp_path / "two")
    with monkeypatch.context() as m:
        m.setattr(jobs, "append_ledger", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            collect(spark, domains, catalog, WordTokenizer(), out, ledger, dedup=scope, key_index=index)
    collect(spark, domains, catalog, WordTokenizer(), out, ledger, dedup=scope, key_index=index)
    assert sorted(t for _, t in kept(spark, out, ledger)) == sorted(t for _, t in kept(spark, str(tmp_path / "o1"), str(tmp_path / "l1")))
    assert {r["batch_id"] for r in read_ledger(spark, ledger).collect()} == {1, 2}


def test_full_bitmaps_and_few_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ki, "FILTER_BITS", 6)
    docs = spark.range(3000).select(
        F.lit("d").alias("domain"), F.col("id").alias("doc_seq"), F.concat(F.lit("t"), F.col("id") % 700).alias("text_norm")
    )
    keyed = ki.with_key(docs, "domain")
    path = str(tmp_path)
    first = ki.first_unseen(keyed.filter("doc_seq < 500"), path, [], [F.col("doc_seq")])
    assert sorted(r["doc_seq"] for r in first.collect()) == list(range(500))
    ki.append_keys(first, path, 4)
    rest = ki.first_unseen(keyed.filter("doc_seq >= 500"), path, [4], [F.col("doc_seq")])
    assert sorted(r["doc_seq"] for r in rest.collect()) == list(range(500, 700))
    ki.append_keys(rest, path, 7)
    assert ki.first_unseen(keyed, path, [4, 7], [F.col("doc_seq")]).count() == 0
    assert ki.first_unseen(keyed, path, [7], [F.col("doc_seq")]).count() == 500
    assert ki.indexed(spark, path, 7) and not ki.indexed(spark, path, 5)


def test_only_buckets_that_may_match_are_read(spark, tmp_path):
    docs = spark.range(400).select(F.lit("d").alias("domain"), F.col("id").alias("doc_seq"), F.concat(F.lit("x"), "id").alias("text_norm"))
    keyed = ki.with_key(docs, "global").select("scope", "key")
    ki.append_keys(keyed, str(tmp_path), 1)
    one = keyed.limit(1)
    found = ki.seen(one, str(tmp_path), [1])
    assert [bytes(r["key"]) for r in found.collect()] == [bytes(one.first()["key"])]
    few = ki._index(spark, str(tmp_path), [1], [7])
    assert "PushedFilters: [" in (plan := few._jdf.queryExecution().executedPlan().toString())
    assert "bucket" in plan.split("PushedFilters: [")[1].split("]")[0]
    stored = spark.read.parquet(f"{tmp_path}/keys/run=000001").withColumn("file", F.input_file_name())
    ranges = sorted(tuple(r)[1:] for r in stored.groupBy("file").agg(F.min("bucket"), F.max("bucket")).collect())
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    none = ki.seen(ki.with_key(docs.withColumn("text_norm", F.lit("new")), "global").select("scope", "key").limit(1), str(tmp_path), [1])
    assert none.count() == 0
    with pytest.raises(ValueError, match="scope"):
        ki.with_key(docs, "corpus")


def test_an_empty_run_can_be_added(spark, tmp_path):
    none = spark.createDataFrame([], "scope string, key binary")
    ki.append_keys(none, str(tmp_path), 1)
    some = spark.createDataFrame([("", b"k" * 32)], "scope string, key binary")
    assert ki.seen(some, str(tmp_path), [1]).count() == 0
