"""One shuffle from stored ids to shard files, against packing by sequences."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from test_pack import DOCS, cut, make_docs, stream_of

from millrace.operators.pack import sequence_counts, shard_plan
from millrace.operators.scatter import sequences_per_shard, shard_pieces, store_runs, token_starts
from millrace.sources.shards import read_shards, validate_shards, write_shards

LENGTHS = {"a": [5, 6, 7, 24, 1, 1, 1, 0, 3], "b": [6, 6], "c": [0], "d": [100], "e": [1] * 20}


def placed(df, framed=True):
    return token_starts(store_runs(df.withColumn("framed_len", (F.col("n_tokens") + (2 if framed else 0)).cast("long")), "t"))


def written(spark, df, path, seq_len, per_shard, framed=True, tail="pad"):
    counts = sequence_counts(df, seq_len, framed, tail).withColumn("source_order", F.col("source"))
    plan = shard_plan(counts, per_shard)
    pieces = shard_pieces(placed(df, framed), plan, seq_len, per_shard, framed)
    n = int(plan.agg(F.sum(F.ceil(F.col("n_sequences") / per_shard))).first()[0])
    write_shards(pieces, path, n, 4 * seq_len * per_shard)
    return pieces


@pytest.mark.parametrize("tail", ["pad", "drop"])
@pytest.mark.parametrize("framed", [True, False])
@pytest.mark.parametrize("per_shard", [1, 3])
def test_shards_hold_the_packed_streams(spark, tmp_path, tail, framed, per_shard):
    rows, df = make_docs(spark, LENGTHS)
    written(spark, df.repartition(5), str(tmp_path), 8, per_shard, framed, tail)
    want = []
    for domain in LENGTHS:
        want += cut(stream_of([r for r in rows if r[0] == domain], framed), 8, tail)
    got = read_shards(spark, str(tmp_path)).orderBy("shard_id", "seq_in_shard").collect()
    assert [list(r["tokens"]) for r in got] == want
    assert validate_shards(spark, str(tmp_path), 100).filter("NOT ok").count() == 0


def test_starts_in_any_stored_order(spark):
    rng = random.Random(3)
    rows = [("ab"[k % 2], 0, k, rng.randrange(9), []) for k in range(400)]
    starts, total = {}, {"a": 0, "b": 0}
    for d, _, k, n, _ in rows:
        starts[d, k] = total[d]
        total[d] += n + 2
    shuffled = rng.sample(rows, len(rows))
    for given, parts in ((rows, 1), (rows, 7), (shuffled, 4)):
        df = spark.createDataFrame(spark.sparkContext.parallelize(given, parts), DOCS)
        assert {(r["domain"], r["doc_seq"]): r["start"] for r in placed(df).collect()} == starts


def test_documents_in_order_make_few_runs_across_batches(spark):
    df = spark.range(0, 30_000, 1, 3).select(
        F.when(F.col("id") < 17_000, "a").otherwise("b").alias("domain"), F.col("id").alias("doc_seq"),
        F.lit(1).alias("n_tokens"), F.array(F.lit(7)).alias("ids"),
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        stored = store_runs(df.withColumn("framed_len", F.lit(3).cast("long")), "t")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert stored.select("run").distinct().count() == 4
    wrong = token_starts(stored).filter(F.col("start") != 3 * F.when(F.col("domain") == "a", F.col("doc_seq")).otherwise(F.col("doc_seq") - 17_000))
    assert wrong.count() == 0


def test_ids_are_shuffled_once(spark, tmp_path):
    _, df = make_docs(spark, LENGTHS)
    plan = shard_plan(sequence_counts(df, 8).withColumn("source_order", F.col("source")), 3)
    pieces = shard_pieces(placed(df), plan, 8, 3)
    dealt = pieces.repartitionById(4, F.col("shard_id"))
    nodes = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in nodes.split("Join")[0] and "Aggregate" not in nodes.split("Join")[0]
    physical = dealt._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    exchanges = [line for line in physical.splitlines() if re.search(r"(?<!Broadcast)Exchange", line)]
    # The broadcast sides are narrow; the only shuffle on the way of the ids is the last one.
    above_join = physical[: physical.index("BroadcastHashJoin")]
    assert len([x for x in above_join.splitlines() if re.search(r"(?<!Broadcast)Exchange", x)]) == 1
    assert len(exchanges) >= 1


def test_a_missing_piece_is_an_error(spark, tmp_path):
    _, df = make_docs(spark, {"a": [9] * 20})
    plan = shard_plan(sequence_counts(df, 8).withColumn("source_order", F.col("source")), 100)
    pieces = shard_pieces(placed(df), plan, 8, 100)
    for bad in (pieces.filter("first <> 22"), pieces.filter("first < 150")):
        with pytest.raises(Exception, match="not in order|announced"):
            write_shards(bad, str(tmp_path), 1, 1)
        assert list(tmp_path.iterdir()) == []


def test_shards_do_not_grow_with_the_sequence_length():
    assert sequences_per_shard(4_096) == 100_000
    assert 4 * 131_072 * sequences_per_shard(131_072) <= 4 * 4_096 * 100_000
    assert sequences_per_shard(1 << 31) == 1
