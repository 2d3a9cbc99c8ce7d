"""The feed plan against a plain walk through ranks, workers, shards and batches."""

from __future__ import annotations

import numpy as np
import pytest

from millrace.operators.feed import (
    assign_ranks,
    assign_workers,
    batches_per_rank,
    feed_plan,
    step_plan,
    tokens_consumed,
)

SHARDS = "shard_id int, num_sequences long"


def worker_lists(n_shards, world, workers):
    """Shards per (rank, worker), by slicing lists."""
    out = {}
    for rank in range(world):
        mine = [i for i in range(n_shards) if i % world == rank]
        per = max(1, len(mine) // workers)
        for w in range(workers):
            out[rank, w] = mine[w * per :] if w == workers - 1 else mine[w * per : (w + 1) * per]
    return out


def walk(sizes, world, workers, batch, seed=42):
    """Batches of each rank in the order they are taken."""
    ranks = {}
    lists = worker_lists(len(sizes), world, workers)
    for rank in range(world):
        queues = []
        for w in range(workers):
            stream = []
            for shard in lists[rank, w]:
                order = list(range(sizes[shard]))
                np.random.default_rng(seed + w + 1000 * shard).shuffle(order)
                stream += [(shard, i) for i in order]
            full = len(stream) // batch
            queues.append([stream[i * batch : (i + 1) * batch] for i in range(full)])
        taken = []
        for k in range(max(map(len, queues))):
            taken += [q[k] for q in queues if len(q) > k]
        ranks[rank] = taken
    return ranks


@pytest.mark.parametrize("n_shards", [1, 3, 7, 102])
@pytest.mark.parametrize(("world", "workers"), [(1, 1), (2, 4), (4, 4)])
def test_worker_split(spark, n_shards, world, workers):
    df = spark.createDataFrame([(i, 1) for i in range(n_shards)], SHARDS)
    got = {}
    for r in assign_workers(assign_ranks(df, world), workers).collect():
        got.setdefault((r["rank"], r["worker"]), []).append(r["shard_id"])
    expected = {k: v for k, v in worker_lists(n_shards, world, workers).items() if v}
    assert {k: sorted(v) for k, v in got.items()} == expected


@pytest.mark.parametrize(("sizes", "world", "workers"), [
    ([13, 40, 7, 0, 22, 9, 31, 5, 18, 26, 3], 2, 3), ([17, 5], 1, 4), ([4, 30, 11], 1, 1),
])
def test_exact_order(spark, sizes, world, workers):
    df = spark.createDataFrame(list(enumerate(sizes)), SHARDS)
    plan = feed_plan(df, world, workers, 4, shuffle="exact")
    got = {}
    for r in plan.orderBy("rank", "batch_in_rank", "row_in_batch").collect():
        got.setdefault(r["rank"], []).append((r["shard_id"], r["seq_in_shard"]))
    expected = {k: [x for b in v for x in b] for k, v in walk(sizes, world, workers, 4).items()}
    assert got == {k: v for k, v in expected.items() if v}
    counts = {r["rank"]: r["n_batches"] for r in batches_per_rank(df, world, workers, 4).collect()}
    assert counts == {k: len(v) // 4 for k, v in expected.items()}


@pytest.mark.parametrize("shuffle", ["hash", "none", "exact"])
def test_every_sequence_once_except_the_dropped_tails(spark, shuffle):
    sizes = [13, 40, 7, 22, 9, 31]
    df = spark.createDataFrame(list(enumerate(sizes)), SHARDS)
    rows = feed_plan(df, 2, 2, 5, shuffle=shuffle).collect()
    seen = {(r["shard_id"], r["seq_in_shard"]) for r in rows}
    assert len(seen) == len(rows)
    lists = worker_lists(6, 2, 2)
    assert len(rows) == sum(sum(sizes[s] for s in v) // 5 * 5 for v in lists.values())


def test_steps_wrap_into_the_next_epoch(spark):
    batches = spark.createDataFrame([(0, 5), (1, 0), (2, 7)], "rank int, n_batches long")
    rows = tokens_consumed(step_plan(batches, 3, 4, 3), 3, 8, 256).collect()
    got = {(r["rank"], r["step"], r["micro"]): (r["epoch"], r["batch_in_rank"], r["tokens"]) for r in rows}
    assert len(got) == 2 * 12
    total = 0
    for ordinal in range(12):
        total += 8 * 255 * 3
        for rank, n in ((0, 5), (2, 7)):
            assert got[rank, ordinal // 3 + 1, ordinal % 3] == (ordinal // n, ordinal % n, total)


def test_a_rank_without_shards_is_reported(spark):
    df = spark.createDataFrame([(0, 8)], SHARDS)
    counts = {r["rank"]: r["n_batches"] for r in batches_per_rank(df, 3, 2, 4).collect()}
    assert counts == {0: 2, 1: 0, 2: 0}
