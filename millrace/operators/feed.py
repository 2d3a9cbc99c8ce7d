"""The order in which a multi-rank training job reads the sequences.

Shard ``i`` belongs to rank ``i % world``; a rank's shards are cut into
contiguous runs for its loader workers; a worker reads its shards in order, each
in a shuffled order of its own; batches never span workers and incomplete ones
are dropped; the rank takes batches from its workers in turn.

Everything but the order inside a shard follows from a table with one row per
shard, so the sequences themselves are only ever grouped by shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import small_side

SEED = 42
SHARD_SEED_STEP = 1_000
BATCH = 8
ACCUMULATION = 4
WORKERS = 4


def assign_ranks(shards: DataFrame, world: int) -> DataFrame:
    """Adds ``rank``."""
    return shards.withColumn("rank", F.pmod("shard_id", F.lit(world)))


def assign_workers(shards: DataFrame, workers: int = WORKERS) -> DataFrame:
    """Adds ``worker`` and ``n_rank_shards``; needs ``rank`` and ``shard_id``.

    Runs have ``max(1, shards // workers)`` shards and the last worker takes the
    rest; with fewer shards than workers the last workers get none.  A rank's
    shards are numbered without gaps in the file order, one row per shard.
    """
    in_rank = Window.partitionBy("rank")
    place = F.row_number().over(in_rank.orderBy("shard_id")) - 1
    n = F.count("*").over(in_rank)
    per = F.greatest(F.lit(1), F.floor(n / workers))
    return shards.withColumns(
        {
            "n_rank_shards": n,
            "worker": F.least(F.floor(place / per), F.lit(workers - 1)).cast("int"),
        }
    )


def shard_seeds(shards: DataFrame, seed: int = SEED, by: str = "worker") -> DataFrame:
    """Adds ``shard_seed``; ``by`` is ``worker``, or ``rank`` for loading without workers."""
    return shards.withColumn(
        "shard_seed", F.lit(seed) + F.col(by) + F.col("shard_id") * SHARD_SEED_STEP
    )


def worker_layout(
    shards: DataFrame, world: int, workers: int = WORKERS, batch: int = BATCH, seed: int = SEED
) -> DataFrame:
    """One row per shard: rank, worker, seed, place of its first sequence and worker sizes.

    ``sizes`` lists, for the shard's rank, how many full batches each worker has.
    """
    seeded = shard_seeds(assign_workers(assign_ranks(shards, world), workers), seed)
    stream = Window.partitionBy("rank", "worker").orderBy("shard_id")
    first = F.sum("num_sequences").over(stream.rowsBetween(Window.unboundedPreceding, -1))
    placed = seeded.withColumn("stream_start", F.coalesce(first, F.lit(0)))
    full = F.floor(F.col("n") / batch)
    by_worker = (
        shards_per_worker(seeded)
        .groupBy("rank")
        .agg(F.map_from_entries(F.collect_list(F.struct("worker", full))).alias("by_worker"))
    )
    sizes = F.transform(
        F.sequence(F.lit(0), F.lit(workers - 1)),
        lambda w: F.coalesce(F.element_at("by_worker", w), F.lit(0)),
    )
    return placed.join(by_worker, "rank").withColumn("sizes", sizes).drop("by_worker")


def shards_per_worker(shards: DataFrame) -> DataFrame:
    """Sequences per worker of a rank."""
    return shards.groupBy("rank", "worker").agg(F.sum("num_sequences").alias("n"))


def shuffled_by_hash(sequences: DataFrame) -> DataFrame:
    """Adds ``place``, the rank of ``md5(seed, shard, sequence)`` within the shard.

    Needs ``shard_id, seq_in_shard, shard_seed``.  A shard has a fixed number of
    sequences at most, and so has the window partition.
    """
    key = F.md5(F.concat_ws(":", "shard_seed", "shard_id", "seq_in_shard"))
    order = Window.partitionBy("shard_id").orderBy(key, "seq_in_shard")
    return sequences.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def list_sequences(shards: DataFrame, shuffle: str = "hash", spread: int | None = None) -> DataFrame:
    """One row per sequence of every shard with its ``place`` in the shard's reading order.

    ``shuffle`` is ``hash``, ``exact`` (the NumPy generator's permutation for the
    shard's seed) or ``none``.  The few shard rows are spread over ``spread``
    partitions before they are multiplied, and the shuffle inside a shard uses
    the same partitioning.
    """
    n = spread or int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = shards.repartition(n, "shard_id")
    filled = rows.filter(F.col("num_sequences") > 0)
    if shuffle == "exact":
        order = permutation(F.col("num_sequences"), F.col("shard_seed"))
        return filled.withColumn("_order", order).select(
            *shards.columns, F.posexplode("_order").alias("place", "seq_in_shard")
        )
    listed = filled.withColumn(
        "seq_in_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("num_sequences") - 1))
    )
    if shuffle == "hash":
        return shuffled_by_hash(listed)
    return listed.withColumn("place", F.col("seq_in_shard"))


def permutation(n: Column, seed: Column) -> Column:
    """``0 .. n-1`` as the NumPy generator of that seed shuffles it; one array per shard."""

    @F.pandas_udf("array<long>")
    def shuffled(sizes: pd.Series, seeds: pd.Series) -> pd.Series:
        orders = []
        for size, start in zip(sizes, seeds, strict=True):
            order = np.arange(size)
            np.random.default_rng(start).shuffle(order)
            orders.append(order)
        return pd.Series(orders, dtype="object")

    return shuffled.asNondeterministic()(n, seed)


def batch_in_rank(batch_in_worker: Column, worker: Column, sizes: Column) -> Column:
    """Ordinal of a worker's batch when the rank takes batches from its workers in turn.

    Before batch ``k`` of worker ``w`` come the first ``k`` batches of every
    worker that has them, and batch ``k`` of earlier workers that have one.
    """
    k = batch_in_worker
    return F.aggregate(
        F.transform(
            sizes,
            lambda n, i: F.least(n, k) + F.when((i < worker) & (n > k), 1).otherwise(0),
        ),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )


def feed_plan(
    shards: DataFrame,
    world: int,
    workers: int = WORKERS,
    batch: int = BATCH,
    seed: int = SEED,
    shuffle: str = "hash",
    spread: int | None = None,
) -> DataFrame:
    """Every sequence that is read in an epoch, and when.

    ``shards`` has ``(shard_id, num_sequences)``.  Result: ``rank, worker,
    shard_id, seq_in_shard, batch_in_worker, row_in_batch, batch_in_rank``.
    Sequences of incomplete batches are left out; the order is the same in every
    epoch.
    """
    layout = worker_layout(shards.select("shard_id", "num_sequences"), world, workers, batch, seed)
    at = F.col("stream_start") + F.col("place")
    k = F.floor(at / batch)
    mine = F.element_at("sizes", F.col("worker") + 1)
    return (
        list_sequences(layout, shuffle, spread)
        .withColumns({"batch_in_worker": k, "row_in_batch": (at % batch).cast("int")})
        .filter(F.col("batch_in_worker") < mine)
        .select(
            "rank",
            "worker",
            "shard_id",
            "seq_in_shard",
            "batch_in_worker",
            "row_in_batch",
            batch_in_rank(F.col("batch_in_worker"), F.col("worker"), F.col("sizes")).alias(
                "batch_in_rank"
            ),
        )
    )


def batches_per_rank(
    shards: DataFrame, world: int, workers: int = WORKERS, batch: int = BATCH
) -> DataFrame:
    """``(rank, n_batches)`` of one epoch; a rank without shards has zero."""
    layout = assign_workers(assign_ranks(shards, world), workers)
    counted = (
        shards_per_worker(layout)
        .groupBy("rank")
        .agg(F.sum(F.floor(F.col("n") / batch)).alias("n_batches"))
    )
    ranks = shards.sparkSession.range(world).select(F.col("id").cast("int").alias("rank"))
    return ranks.join(counted, "rank", "left").fillna(0, ["n_batches"])


def step_plan(
    batches: DataFrame, world: int, max_steps: int, accumulation: int = ACCUMULATION
) -> DataFrame:
    """Which batch each rank takes in each micro-step; ``batches`` is ``(rank, n_batches)``.

    Reading wraps to the next epoch wherever a rank runs out, also inside a step.
    Ranks without batches have no rows.
    """
    total = max_steps * accumulation
    spark = batches.sparkSession
    micro_steps = spark.range(total * world).select(
        (F.col("id") % world).cast("int").alias("rank"),
        F.floor(F.col("id") / world).alias("ordinal"),
    )
    return (
        micro_steps.join(small_side(batches.filter(F.col("n_batches") > 0), world), "rank")
        .select(
            "rank",
            "ordinal",
            (F.floor(F.col("ordinal") / accumulation) + 1).alias("step"),
            (F.col("ordinal") % accumulation).cast("int").alias("micro"),
            F.floor(F.col("ordinal") / F.col("n_batches")).alias("epoch"),
            (F.col("ordinal") % F.col("n_batches")).alias("batch_in_rank"),
        )
    )


def tokens_consumed(
    steps: DataFrame, world: int, batch: int = BATCH, seq_len: int = 4_096
) -> DataFrame:
    """Adds ``tokens``: the job's counter after each micro-step.

    All micro-steps add the same amount, so the running total is a product.
    """
    return steps.withColumn(
        "tokens", (F.col("ordinal") + 1) * F.lit(batch * (seq_len - 1) * world).cast("long")
    )
