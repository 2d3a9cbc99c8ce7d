"""Training examples in the order a multi-rank job takes them, read straight from shard files.

The order follows from one row per shard (:mod:`millrace.operators.feed`).  A loader worker's stream is
cut into segments of whole batches, and a segment is one task: it works out which sequences its batches
hold, seeks them in their files and emits them in reading order.  Token ids are never shuffled.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.feed import BATCH, SEED, WORKERS, worker_layout
from millrace.operators.pack import IGNORE_LABEL, PAD
from millrace.session import materialize
from millrace.sources.paths import open_fs, shared
from millrace.sources.shards import shard_catalog
from millrace.sources.tokshard import (
    BATCH_BYTES,
    HEADER,
    HEADER_BYTES,
    INDEX_ENTRY,
    INDEX_ENTRY_BYTES,
    INDEX_HEAD_BYTES,
    PREFIX,
    _ids,
    magic_bytes,
)

TASK_BYTES = 128 << 20
SCHEMA = (
    "rank int, worker int, batch_in_rank long, row_in_batch int, shard_id int, seq_in_shard long, "
    "input_ids array<int>, labels array<int>"
)


def shard_order(n: int, shard_id: int, seed: int, shuffle: str) -> np.ndarray:
    """The sequences of a shard in reading order; see ``feed.list_sequences`` for the kinds of shuffle."""
    order = np.arange(n)
    if shuffle == "hash":
        keys = [hashlib.md5(f"{seed}:{shard_id}:{k}".encode()).digest() for k in range(n)]
        return np.array(sorted(range(n), key=lambda k: (keys[k], k)), np.int64)
    if shuffle == "exact":
        np.random.default_rng(seed).shuffle(order)
    elif shuffle != "none":
        raise ValueError(f"shuffle must be 'hash', 'exact' or 'none', not {shuffle!r}")
    return order


def segments(layout: DataFrame, batch: int, per_task: int) -> tuple[DataFrame, int]:
    """``(task, rank, worker, sizes, first, last, shards)``: one row per run of ``per_task`` batches, and how many there are.

    ``layout`` has one row per shard, from :func:`worker_layout`, with ``shard``.  ``shards`` are those the run touches.
    """
    size = per_task * batch
    mine = F.element_at("sizes", F.col("worker") + 1)
    streams = layout.groupBy("rank", "worker").agg(F.first(mine).alias("batches"))
    streams = streams.withColumn("tasks", F.ceil(F.col("batches") / per_task))
    before = Window.orderBy("rank", "worker").rowsBetween(Window.unboundedPreceding, -1)  # one row per loader worker
    numbered = streams.withColumn("base", F.coalesce(F.sum("tasks").over(before), F.lit(0)))
    total = streams.agg(F.sum("tasks")).first()[0] or 0
    filled = layout.filter("num_sequences > 0").join(numbered, ["rank", "worker"])
    reach = F.sequence(
        F.floor(F.col("stream_start") / size), F.floor((F.col("stream_start") + F.col("num_sequences") - 1) / size)
    )
    shard = F.struct("stream_start", "shard_id", "shard", "num_sequences", "shard_seed")
    cut = filled.withColumn("segment", F.explode(reach)).filter(F.col("segment") < F.col("tasks"))
    rows = cut.groupBy("rank", "worker", "segment", "base", "batches", "sizes").agg(F.array_sort(F.collect_list(shard)).alias("shards"))
    return rows.select(
        (F.col("base") + F.col("segment")).cast("int").alias("task"), "rank", "worker", "sizes",
        (F.col("segment") * per_task).alias("first"),
        F.least("batches", (F.col("segment") + 1) * per_task).alias("last"), "shards",
    ), int(total)


def read_feed(
    spark: SparkSession,
    path: str,
    world: int,
    workers: int = WORKERS,
    batch: int = BATCH,
    seed: int = SEED,
    shuffle: str = "hash",
    ignore_id: int = PAD,
    ranks: list[int] | None = None,
    first_batch: int = 0,
    task_bytes: int = TASK_BYTES,
    **options,
) -> DataFrame:
    """One epoch of a shard folder: ``rank, worker, batch_in_rank, row_in_batch, shard_id, seq_in_shard, input_ids, labels``.

    Batches are whole, and sequences of incomplete ones are left out.  ``ranks`` reads the batches of some ranks only,
    and ``first_batch`` those from that ordinal of each rank on, so that a job can go on where it stopped;
    files of other batches are not opened.  Inputs are a sequence without its last id, labels
    the same without its first, with -100 in place of ``ignore_id``.  A partition has consecutive batches of one worker, in order.
    """
    prefix, magic = options.get("prefix", PREFIX), magic_bytes(options)
    catalog = materialize(shard_catalog(spark, path, prefix), "catalog")  # small files, read several times below
    lengths = catalog.agg(F.min("seq_length"), F.max("seq_length")).first()
    if lengths[0] != lengths[1]:
        raise ValueError(f"{path} has sequences of {lengths[0]} and of {lengths[1]} ids")
    length = int(lengths[0])
    per_task = max(1, task_bytes // (4 * max(1, length) * batch))
    layout = worker_layout(catalog.select("shard_id", "num_sequences"), world, workers, batch, seed)
    if ranks is not None:
        layout = layout.filter(F.col("rank").isin([int(r) for r in ranks]))
    listed = materialize(layout.join(catalog.select("shard_id", "shard"), "shard_id"), "layout")
    rows, tasks = segments(listed, batch, per_task)
    root = shared(spark, path)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for row in some.to_pylist():
                yield from read_segment(root, row, length, batch, shuffle, magic, ignore_id, first_batch)

    dealt = rows.repartitionById(max(1, tasks), "task")
    return dealt.mapInArrow(read, StructType.fromDDL(SCHEMA))


def batch_ordinals(first: int, last: int, worker: int, sizes: list[int]) -> np.ndarray:
    """Place among its rank's batches of each batch ``first`` to ``last`` of a worker; ``sizes`` has all workers' batches."""
    k = np.arange(first, last)
    return sum(np.minimum(n, k) + ((i < worker) & (n > k)) for i, n in enumerate(sizes)).astype(np.int64)


def read_segment(root, row, length, batch, shuffle, magic, ignore_id, first_batch) -> Iterator[pa.RecordBatch]:
    ordinals = batch_ordinals(row["first"], row["last"], row["worker"], row["sizes"])
    skipped = int(np.searchsorted(ordinals, first_batch))
    ordinals, low, high = ordinals[skipped:], (row["first"] + skipped) * batch, row["last"] * batch
    if low >= high:
        return
    # Which sequence of which shard stands at each place of the stream, low to high.
    owner, member = np.empty(high - low, np.int64), np.empty(high - low, np.int64)
    files = []
    for shard in row["shards"]:
        start, n = shard["stream_start"], shard["num_sequences"]
        a, b = max(low, start), min(high, start + n)
        if a < b:
            owner[a - low:b - low] = len(files)
            member[a - low:b - low] = shard_order(n, shard["shard_id"], shard["shard_seed"], shuffle)[a - start:b - start]
            files.append(shard)
    fs, folder = open_fs(root)
    opened = {}
    step = max(1, BATCH_BYTES // (4 * max(1, length) * batch)) * batch
    try:
        for at in range(0, high - low, step):
            some, own = member[at:at + step], owner[at:at + step]
            ids = np.empty((len(some), length), "<u4")
            for f in np.unique(own).tolist():
                if f not in opened:
                    opened[f] = _ShardBody(fs, f"{folder}/{files[f]['shard']}", length, files[f]["num_sequences"], magic)
                rows = np.flatnonzero(own == f)
                ids[rows] = opened[f].sequences(some[rows])
            yield _examples(row, ordinals, at, batch, [files[f]["shard_id"] for f in own.tolist()], some, ids, ignore_id)
    finally:
        for body in opened.values():
            body.file.close()


class _ShardBody:
    """An open shard file that gives sequences by number."""

    def __init__(self, fs, stem, length, n, magic):
        self.stem, self.length, self.fs = stem, length, fs
        self.file = fs.open_input_file(stem + ".bin")
        head = self.file.read(HEADER_BYTES)
        if len(head) < HEADER_BYTES or struct.unpack(HEADER, head)[0] != magic:
            raise ValueError(f"bad magic in {stem}.bin")
        if struct.unpack(HEADER, head)[2:4] != (n, length):
            raise ValueError(f"{stem}.bin and {stem}.meta differ in their counts")

    def sequences(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the given sequences; they are read in file order, neighbours with one read."""
        order = np.argsort(numbers)
        wanted = numbers[order]
        low, high = int(wanted[0]), int(wanted[-1]) + 1
        with self.fs.open_input_file(self.stem + ".idx") as f:
            f.seek(INDEX_HEAD_BYTES + INDEX_ENTRY_BYTES * low)
            raw = f.read(INDEX_ENTRY_BYTES * (high - low))
        if len(raw) < INDEX_ENTRY_BYTES * (high - low):
            raise ValueError(f"{self.stem}.idx has fewer entries than the header says")
        offsets = np.frombuffer(raw, INDEX_ENTRY)["offset"].astype("int64")[wanted - low]
        out = np.empty((len(numbers), self.length), "<u4")
        runs = np.split(np.arange(len(offsets)), np.flatnonzero(np.diff(offsets) != 4 * self.length) + 1)
        for run in runs:
            out[order[run]] = _ids(self.file, offsets[run], self.length, self.stem).reshape(len(run), self.length)
        return out


def _examples(row, ordinals, at, batch, shard_ids, numbers, ids, ignore_id) -> pa.RecordBatch:
    count, width = len(ids), max(0, ids.shape[1] - 1)
    place = np.arange(at, at + count)
    ids = ids.view("<i4")
    labels = np.where(ids[:, 1:] == ignore_id, np.int32(IGNORE_LABEL), ids[:, 1:])
    ends = pa.array(np.arange(count + 1, dtype="int32") * np.int32(width))
    columns = {
        "rank": np.full(count, row["rank"], "int32"),
        "worker": np.full(count, row["worker"], "int32"),
        "batch_in_rank": ordinals[place // batch],
        "row_in_batch": (place % batch).astype("int32"),
        "shard_id": np.array(shard_ids, "int32"),
        "seq_in_shard": numbers,
        "input_ids": pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(ids[:, :-1]).ravel())),
        "labels": pa.ListArray.from_arrays(ends, pa.array(labels.ravel())),
    }
    return pa.RecordBatch.from_pydict({k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in columns.items()})
