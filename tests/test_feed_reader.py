"""Delivered examples against a plain walk through ranks, workers, shards and batches."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_feed import walk
from test_shards import LENGTH, sequences

from millrace.sources.feed_reader import read_feed, shard_order
from millrace.sources.shards import write_shards

SIZES = [13, 40, 7, 22, 9, 31, 5]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("feed")
    write_shards(sequences(spark, SIZES), str(path), len(SIZES), 1)
    return str(path)


def tokens(shard, seq):
    return [shard * 1000 + seq * 10 + k for k in range(LENGTH)]


def delivered(df):
    ranks = {}
    for r in sorted(df.collect(), key=lambda r: (r["rank"], r["batch_in_rank"], r["row_in_batch"])):
        ids = tokens(r["shard_id"], r["seq_in_shard"])
        assert list(r["input_ids"]) == ids[:-1]
        assert list(r["labels"]) == [-100 if x == 1010 else x for x in ids[1:]]
        ranks.setdefault(r["rank"], []).append((r["batch_in_rank"], r["row_in_batch"], r["shard_id"], r["seq_in_shard"]))
    return ranks


def expected(world, workers, batch):
    walked = walk(SIZES, world, workers, batch)
    return {
        rank: [(k, i, *x) for k, b in enumerate(batches) for i, x in enumerate(b)] for rank, batches in walked.items() if batches
    }


@pytest.mark.parametrize(("world", "workers", "batch"), [(2, 3, 4), (1, 1, 8), (3, 2, 1)])
@pytest.mark.parametrize("task_bytes", [1, 600, 1 << 20])
def test_whole_epoch_in_order(spark, folder, world, workers, batch, task_bytes):
    feed = read_feed(spark, folder, world, workers, batch, shuffle="exact", ignore_id=1010, task_bytes=task_bytes)
    assert delivered(feed) == expected(world, workers, batch)


def test_partitions_are_runs_of_one_worker_in_order(spark, folder):
    feed = read_feed(spark, folder, 2, 3, 4, shuffle="exact", task_bytes=600)
    rows = feed.withColumn("part", F.spark_partition_id()).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r["part"], []).append((r["rank"], r["worker"], r["batch_in_rank"], r["row_in_batch"]))
    assert len(parts) > 6
    assert all(len({p[:2] for p in part}) == 1 and part == sorted(part) for part in parts.values())


def test_one_rank_from_a_batch_on_opens_no_other_file(spark, folder, tmp_path):
    want = {1: [x for x in expected(2, 2, 4)[1] if x[0] >= 5]}
    own = {x[2] for x in want[1]}
    for k in range(len(SIZES)):
        for suffix in (".bin", ".idx", ".meta"):
            name = f"shard_{k:03d}{suffix}"
            data = open(f"{folder}/{name}", "rb").read()
            (tmp_path / name).write_bytes(data if k in own or suffix == ".meta" else b"broken")
    feed = read_feed(spark, str(tmp_path), 2, 2, 4, shuffle="exact", ignore_id=1010, ranks=[1], first_batch=5, task_bytes=600)
    assert delivered(feed) == want


def test_ids_are_not_shuffled(spark, folder):
    plan = read_feed(spark, folder, 2, 2, 4)._jdf.queryExecution().executedPlan().toString()
    assert "input_ids" not in "".join(re.findall(r"Exchange.*", plan)) and "MapInArrow" in plan
    assert plan.index("MapInArrow") < plan.index("Exchange")


def test_orders(spark, folder):
    for seed in (0, 42, 1003):
        order = list(range(500))
        np.random.default_rng(seed).shuffle(order)
        assert shard_order(500, 1, seed, "exact").tolist() == order
    assert sorted(shard_order(100, 3, 7, "hash").tolist()) == list(range(100))
    with pytest.raises(ValueError, match="shuffle"):
        shard_order(3, 0, 0, "other")


def test_a_damaged_file_is_an_error(spark, folder, tmp_path):
    for k in range(len(SIZES)):
        for suffix in (".bin", ".idx", ".meta"):
            name = f"shard_{k:03d}{suffix}"
            data = open(f"{folder}/{name}", "rb").read()
            (tmp_path / name).write_bytes(data[:-8] if name == "shard_001.bin" else data)
    with pytest.raises(Exception, match="ends inside a sequence"):
        read_feed(spark, str(tmp_path), 1, 1, 1, shuffle="none").collect()
