from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.pack import (
    assign_shards,
    corpus_stats,
    out_of_range,
    pack,
    sequence_counts,
    sequence_offset,
    shard_plan,
    to_examples,
    token_offsets,
)

DOCS = "domain string, plan_order int, doc_seq long, n_tokens int, ids array<int>"


def make_docs(spark, lengths_by_domain, seed=0):
    rng = random.Random(seed)
    rows = []
    for k, (domain, lengths) in enumerate(lengths_by_domain.items()):
        for i, n in enumerate(lengths):
            rows.append((domain, k, i * 3, n, [rng.randint(0, 50) for _ in range(n)]))
    return rows, spark.createDataFrame(rows, DOCS)


def stream_of(rows, framed=True):
    out = []
    for *_, ids in rows:
        out += [1, *ids, 2] if framed else ids
    return out


def cut(stream, length, tail):
    parts = [stream[i : i + length] for i in range(0, len(stream), length)]
    if tail == "drop":
        return [p for p in parts if len(p) == length]
    return [p + [0] * (length - len(p)) for p in parts]


# Framed lengths 1 less, equal and 1 more than a sequence, several sequences, and one whole row of short ones.
LENGTHS = {"a": [5, 6, 7, 24, 1, 1, 1, 0, 3], "b": [6, 6], "c": [0], "d": [100], "e": [1] * 20}


@pytest.mark.parametrize("tail", ["pad", "drop"])
@pytest.mark.parametrize("framed", [True, False])
def test_pack_against_concatenation(spark, tail, framed):
    rows, df = make_docs(spark, LENGTHS)
    got = pack(df, 8, framed, tail, bits=2).collect()
    for domain in LENGTHS:
        expected = cut(stream_of([r for r in rows if r[0] == domain], framed), 8, tail)
        mine = sorted((r["seq"], list(r["tokens"])) for r in got if r["source"] == domain)
        assert mine == list(enumerate(expected))
    total = sum(len(stream_of([r], framed)) for r in rows)
    if tail == "pad":
        assert sum(r["n_real"] for r in got) == total
    counts = {r["source"]: r["n_sequences"] for r in sequence_counts(df, 8, framed, tail).collect()}
    assert counts == {d: sum(r["source"] == d for r in got) for d in LENGTHS}


def test_pack_across_sources(spark):
    rows, df = make_docs(spark, LENGTHS)
    got = pack(df, 8, scope="global", bits=2).collect()
    assert sorted((r["seq"], list(r["tokens"])) for r in got) == list(enumerate(cut(stream_of(rows), 8, "pad")))
    assert {r["source"] for r in got} == {"all"}


def test_offsets_reject_unknown_scope(spark):
    _, df = make_docs(spark, {"a": [1]})
    with pytest.raises(ValueError, match="scope"):
        token_offsets(df, scope="corpus")
    with pytest.raises(ValueError, match="tail"):
        pack(df, 8, tail="keep")


def test_shards_are_runs_of_sequences(spark):
    counts = spark.createDataFrame([("a", 0, 7), ("b", 1, 0), ("c", 2, 3)], "source string, source_order int, n_sequences long")
    plan = shard_plan(counts, 3)
    rows = [("a", i) for i in range(7)] + [("c", i) for i in range(3)]
    packed = spark.createDataFrame(rows, "source string, seq long")
    got = assign_shards(packed, plan, 3, 3).withColumn("at", sequence_offset(F.col("seq_in_shard"), 8)).collect()
    table = {(r["source"], r["seq"]): (r["shard_id"], r["seq_in_shard"], r["num_sequences"], r["at"]) for r in got}
    assert table["a", 0] == (0, 0, 3, 36) and table["a", 5] == (1, 2, 3, 36 + 64) and table["a", 6] == (2, 0, 1, 36)
    assert table["c", 2] == (3, 2, 3, 36 + 64)


def test_examples_are_shifted_once_and_masked(spark):
    df = spark.createDataFrame([([1, 5, 0, 7, 2, 0, 0],)], "tokens array<int>")
    r = to_examples(df).first()
    assert list(r["input_ids"]) == [1, 5, 0, 7, 2, 0]
    assert list(r["labels"]) == [5, -100, 7, 2, -100, -100]


def test_range_and_statistics(spark):
    df = spark.createDataFrame([([0, 9, 10, -1],)], "tokens array<int>")
    assert df.select(out_of_range(F.col("tokens"), 10).alias("n")).first()["n"] == 2
    shards = spark.createDataFrame([(10, 16), (5, 16)], "num_sequences long, seq_length long")
    assert tuple(corpus_stats(shards).first()) == (2, 15, 240, 72 + 960)
