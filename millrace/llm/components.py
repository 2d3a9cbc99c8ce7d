"""Connected components of links between integer nodes, on Spark from end to end."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize

FINISH_LINKS = 100_000  # links that one task may finish by itself
TASKS_PER_FILE = 16  # shuffle tasks whose few links share a file


class Forest:
    """Union-find over the integers a task meets."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, node: int) -> int:
        parent, path = self.parent, []
        while (up := parent.setdefault(node, node)) != node:
            path.append(node)
            node = up
        for p in path:
            parent[p] = node
        return node

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart until now; the smaller root stays."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


def _spanning(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition that join what earlier ones left apart."""
    forest = Forest()
    for batch in batches:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        links = [(a, b) for a, b in pairs if forest.join(a, b)]
        a, b = zip(*links, strict=True) if links else ((), ())
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    nodes = list(forest.parent)
    yield pa.RecordBatch.from_pydict(
        {"node": pa.array(nodes, pa.int64()), "root": pa.array([forest.find(n) for n in nodes], pa.int64())}
    )


def _contract(links: DataFrame, seed: int) -> DataFrame:
    """``(node, root)``: each node's neighbour, or itself, that a hash of the round puts first."""
    both = links.union(links.select("b", "a")).toDF("node", "other")
    first = F.struct(F.xxhash64("other", F.lit(seed)).alias("h"), F.col("other").alias("n"))
    own = F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), F.col("node").alias("n"))
    nearest = both.groupBy("node").agg(F.min(first).alias("first"))
    return nearest.select("node", F.least("first", own)["n"].alias("root"))


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """A table of short rows in few files."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartition(max(tasks // TASKS_PER_FILE, 1)), name)


def components(links: DataFrame, thinned: bool = False, finish_links: int = FINISH_LINKS) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)``; the component is its smallest node.

    Links are thinned to a spanning forest within each partition, unless they are ``thinned`` already.  While many
    are left, every node moves onto the neighbour that a hash of the round
    ranks first, which shrinks long chains and stars alike by a constant
    factor; the last few links are joined in one task.  Each round is a
    written table.
    """
    links = links.toDF("a", "b").filter("a <> b")
    links = _stored(links if thinned else links.mapInArrow(_spanning, "a long, b long"), "links")
    labels, seed = None, 0
    while links.count() > finish_links:
        moved = _stored(_contract(links, seed), "moved")
        labels = moved if labels is None else _stored(_relabelled(labels, moved), "labels")
        at_a = moved.select(F.col("node").alias("a"), F.col("root").alias("_a"))
        at_b = moved.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        links = links.join(at_a, "a").join(at_b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        links = _stored(links.filter("a <> b").mapInArrow(_spanning, "a long, b long"), "links")
        seed += 1
    moved = materialize(links.coalesce(1).mapInArrow(_finish, "node long, root long"), "moved")
    if labels is None:
        return moved.withColumnRenamed("root", "component")
    labels = _stored(_relabelled(labels, moved), "labels")
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(least, "root").select("node", "component")


def _relabelled(labels: DataFrame, moved: DataFrame) -> DataFrame:
    onto = moved.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return labels.join(onto, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))


def as_edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"a": pa.array(np.asarray(a, np.int64)), "b": pa.array(np.asarray(b, np.int64))}
    )
