from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.operators.dedup import dedup_exact, skip_ingested
from millrace.operators.order import with_doc_seq
from millrace.operators.prefix import previous_row, running_totals


def sparse_rows(seed, groups=5, n=300, top=100_000):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        size = n if g else 3 * n  # one group holds most rows
        for seq in rng.sample(range(top), size):
            rows.append((f"g{g}", seq, rng.randint(0, 9)))
    return rows


def test_running_totals_over_many_levels(spark):
    rows = sparse_rows(1)
    df = spark.createDataFrame(rows, "g string, seq long, w long")
    got = {(r["g"], r["seq"]): r["w_before"] for r in running_totals(df, ["g"], "seq", ["w"], bits=3).collect()}
    total = defaultdict(int)
    for g, seq, w in sorted(rows):
        assert got[g, seq] == total[g]
        total[g] += w
    assert len(got) == len(rows)


def test_running_totals_without_group_and_when_empty(spark):
    df = spark.createDataFrame([(i * 7, 1) for i in range(50)], "seq long, w long")
    got = sorted(r["w_before"] for r in running_totals(df, [], "seq", ["w"], bits=2).collect())
    assert got == list(range(50))
    assert running_totals(df.filter("seq < 0"), [], "seq", ["w"]).count() == 0


def test_previous_row_across_chunks(spark):
    rows = sparse_rows(2)
    df = spark.createDataFrame(rows, "g string, seq long, w long")
    got = {(r["g"], r["seq"]): r["prev_w"] for r in previous_row(df, ["g"], "seq", ["w"], bits=3).collect()}
    last = {}
    for g, seq, w in sorted(rows):
        assert got[g, seq] == last.get(g)
        last[g] = w


def test_no_window_spans_a_whole_group(spark):
    df = spark.range(100_000).select(F.lit("g").alias("g"), F.col("id").alias("seq"), F.lit(1).alias("w"))
    plan = running_totals(df, ["g"], "seq", ["w"], bits=10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 2  # rows within chunks, chunks within the group
    assert "_chunk2" in plan and "_chunk1" in plan


def test_document_ordinals_with_a_hot_domain(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"d{i % 7}", f"f{rng.randint(0, 20)}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "domain string, file string, line long")
    got = {(r["domain"], r["file"], r["line"]): r["doc_seq"] for r in with_doc_seq(df, ["file", "line"], partitions=6).collect()}
    place = defaultdict(int)
    for key in sorted(rows):
        assert got[key] == place[key[0]]
        place[key[0]] += 1


def test_dedup_keeps_the_first_of_a_hot_text(spark):
    rows = [(f"d{i % 3}", i % 3, i, "same" if i % 2 else f"t{i % 40}") for i in range(400)]
    df = spark.createDataFrame(rows, "domain string, plan_order int, doc_seq long, text_norm string")
    by_domain, overall = {}, {}
    for domain, order, seq, text in sorted(rows, key=lambda r: (r[1], r[2])):
        by_domain.setdefault((domain, text), (domain, seq))
        overall.setdefault(text, (domain, seq))
    keys = lambda out: {(r["domain"], r["doc_seq"]) for r in out.collect()}
    assert keys(dedup_exact(df)) == set(by_domain.values())
    assert keys(dedup_exact(df, "global")) == set(overall.values())


def test_skip_ingested(spark):
    docs = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "domain string, doc_seq long")
    ledger = spark.createDataFrame([("a", 2), ("c", 9)], "domain string, resume_seq long")
    assert sorted(map(tuple, skip_ingested(docs, ledger).collect())) == [("a", 3), ("a", 4), ("b", 0)]
