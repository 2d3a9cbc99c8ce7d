"""Near-duplicate groups by an inverted join on MinHash coordinates.

Documents with equal shingle sets form one class; only class representatives go
on.  Each is posted under its 64 coordinate-value pairs.  Pairs that one
document alone has are skipped, and so are documents with fewer shared
coordinates than the match threshold.  Of the shared ones, rarest first, a
document is looked up under a prefix long enough that two documents with the
threshold's number of matches meet in it; the frequent rest is skipped.  In each
posting list, whole signatures are compared and collisions counted.  What
reaches the threshold ties documents into clusters, in which shared shingles
are counted exactly and the links confirmed.

Long lists and clusters are cut into blocks, and a task compares two blocks, so
a task's input is bounded.  Only links that join something are written, so
the output grows with documents and not with pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import id_text, map_texts, text_bytes
from millrace.llm.components import Forest, as_edges, components
from millrace.llm.wordhash import mix, shingle_sets
from millrace.session import materialize

COORDINATES = 64
MISSED = 1e-6  # chance that a pair right at the similarity has fewer matches than the threshold
LIST_BLOCK = 2048  # documents in a block of a posting list
CLUSTER_BLOCK = 1 << 19  # shingles in a block of a cluster
ROWS = 2048  # shingles hashed at a time

_random = np.random.Generator(np.random.PCG64(7))
SLOPE = _random.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _random.integers(0, 2**63, COORDINATES, dtype=np.uint64)
PLACE = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))


def match_threshold(percent: int, coordinates: int = COORDINATES, missed: float = MISSED) -> int:
    """The largest number of matches that similar pairs reach but for a share of ``missed``."""
    p, below = percent / 100, 0.0
    for t in range(coordinates + 1):
        below += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > missed:
            return max(t, 1)
    return coordinates


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least 32-bit value of each coordinate's hash over the shingles."""
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(shingles), ROWS):
        hashed = (shingles[k:k + ROWS, None] * SLOPE + SHIFT) >> np.uint64(32)
        np.minimum(least, hashed.min(axis=0).astype(np.uint32), out=least)
    return least


def _grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in batches sorted by them; each table holds whole groups only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        same = np.ones(batch.num_rows - 1, bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            same &= values[1:] == values[:-1]
        cuts = np.flatnonzero(~same) + 1
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, cuts[-1])])
            held = [batch.slice(cuts[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows - 1, bool)
    for key in keys:
        values = table.column(key).to_numpy()
        change |= values[1:] != values[:-1]
    return np.r_[0, np.flatnonzero(change) + 1, table.num_rows]


def _reach(nodes: np.ndarray, alike: Callable[[int], np.ndarray], forest: Forest, across: np.ndarray | None) -> list:
    """Links that join the rows of one group which ``alike`` ties, walking each tied set once.

    ``alike(i)`` marks the rows like row i.  With ``across``, the block of each row, only rows of
    different blocks are compared; those of one block are compared by a task of their own.
    """
    links, left = [], np.ones(len(nodes), bool)
    for start in range(len(nodes)):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            hit = alike(i) & left
            if across is not None:
                hit &= across != across[i]
            for j in np.flatnonzero(hit).tolist():
                left[j] = False
                todo.append(j)
                if forest.join(int(nodes[i]), int(nodes[j])):
                    links.append((int(nodes[i]), int(nodes[j])))
    return links


PAIRED = ["key", "low", "high"]


def block_pairs(rows: DataFrame, blocks, node: str = "node") -> DataFrame:
    """Sends each row to the pairs of blocks its own block is in, of ``blocks`` in its group."""
    own = F.pmod(F.xxhash64(node), blocks).cast("int")
    paired = rows.withColumn("block", own).withColumn("_other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    low, high = F.least("block", "_other"), F.greatest("block", "_other")
    return paired.withColumns({"low": low, "high": high}).drop("_other")


def _by_pair(paired: DataFrame) -> DataFrame:
    return paired.repartition(*PAIRED).sortWithinPartitions(*PAIRED, "node")


def list_links(threshold: int):
    """Links of documents that match in ``threshold`` coordinates, list by list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for table in _grouped(batches, PAIRED):
            node = table.column("node").to_numpy()
            block = table.column("block").to_numpy()
            within = table.column("low").to_numpy() == table.column("high").to_numpy()
            signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16)
            signatures = signatures.reshape(len(node), COORDINATES)
            bounds = _bounds(table, PAIRED)
            sizes = np.diff(bounds)
            two = bounds[:-1][(sizes == 2) & within[bounds[:-1]]]
            hits = two[(signatures[two] == signatures[two + 1]).sum(axis=1) >= threshold]
            links = [(a, b) for a, b in zip(node[hits].tolist(), node[hits + 1].tolist(), strict=True) if forest.join(a, b)]
            for k in np.flatnonzero((sizes > 2) | ((sizes == 2) & ~within[bounds[:-1]])).tolist():
                a, b = bounds[k], bounds[k + 1]
                part = signatures[a:b]

                def alike(i, part=part):
                    return (part == part[i]).sum(axis=1) >= threshold

                links += _reach(node[a:b], alike, forest, None if within[a] else block[a:b])
            if links:
                yield as_edges(*map(list, zip(*links, strict=True)))

    return run


class SharedShingles:
    """Exact counts of the shingles each row of a group shares with the others, by inverted lists."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        rows = np.repeat(np.arange(len(sets)), self.sizes)
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(codes, kind="stable")
        self.rows = rows[order]
        ends = np.cumsum(np.bincount(codes))
        self.starts = np.r_[0, ends]
        self.codes = np.split(codes, np.cumsum(self.sizes)[:-1])

    def shared_with(self, i: int) -> np.ndarray:
        starts, stops = self.starts[self.codes[i]], self.starts[self.codes[i] + 1]
        long = stops - starts > 1
        starts, lengths = starts[long], (stops - starts)[long]
        at = np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        shared = np.bincount(self.rows[at], minlength=len(self.sizes))
        shared[i] = self.sizes[i]
        return shared


def confirmed_links(percent: int):
    """Links of documents whose sets have at least ``percent`` per cent in common, cluster by cluster."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for table in _grouped(batches, PAIRED):
            bounds = _bounds(table, PAIRED)
            node = table.column("node").to_numpy()
            block = table.column("block").to_numpy()
            within = table.column("low").to_numpy() == table.column("high").to_numpy()
            shingles = table.column("shingles")
            links = []
            for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                if b - a < 2:
                    continue
                counts = SharedShingles([np.frombuffer(s.as_py(), np.uint64) for s in shingles[a:b]])

                def alike(i, counts=counts):
                    shared = counts.shared_with(i)
                    return 100 * shared >= percent * (counts.sizes + counts.sizes[i] - shared)

                links += _reach(node[a:b], alike, forest, None if within[a] else block[a:b])
            if links:
                yield as_edges(*map(list, zip(*links, strict=True)))

    return run


def _sketches(n: int):
    def sketch(part: pa.RecordBatch) -> dict:
        sizes, digests, signatures = [], [], []
        for shingles in shingle_sets(text_bytes(part.column("text")), n):
            sizes.append(len(shingles))
            digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
            signatures.append(signature(shingles).tobytes())
        return {"doc_id": part.column("doc_id"), "n_shingles": sizes, "digest": digests, "signature": signatures}

    return sketch


def _posted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per coordinate: a 64-bit key of place and value, and the document."""
    for batch in batches:
        raw = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32)
        keys = mix(raw.reshape(-1, COORDINATES).astype(np.uint64) ^ PLACE)
        nodes = np.repeat(batch.column("node").to_numpy(), COORDINATES)
        yield pa.RecordBatch.from_pydict({"key": keys.ravel().view(np.int64), "node": nodes})


def _short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures cut to 16 bits a coordinate, which is enough to count matches."""
    for batch in batches:
        raw = [(np.frombuffer(s, np.uint32) >> 16).astype(np.uint16).tobytes() for s in batch.column("signature").to_pylist()]
        yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "signature": pa.array(raw, pa.binary())})


def candidate_links(classes: DataFrame, threshold: int) -> DataFrame:
    """Links ``(a, b)`` that tie the documents of ``(node, signature)`` with enough equal coordinates."""
    postings = classes.mapInArrow(_posted, "key long, node long")
    lists = postings.groupBy("key").count().filter("count > 1").withColumnRenamed("count", "n")
    shared = postings.join(lists, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("at"))
    prefix = F.slice("at", F.lit(1), F.size("at") - (threshold - 1))
    shared = shared.filter(F.size("at") >= threshold).select("node", F.explode(prefix).alias("p"))
    short = classes.mapInArrow(_short, "node long, signature binary")
    rows = shared.select("node", "p.key", "p.n").join(short, "node")
    paired = block_pairs(rows, F.ceil(F.col("n") / LIST_BLOCK)).select(*PAIRED, "block", "node", "signature")
    return _by_pair(paired).mapInArrow(list_links(threshold), "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``.

    Documents are linked if their sets of ``words``-word shingles have at least
    ``percent`` per cent of their union in common, and a component is what
    links reach; its id is the smallest ``doc_id`` in it, and that document is
    kept.  Null, empty and blank texts have no shingles and no links.  Rows that share an
    id are one node.  A row with a null id belongs to its class's component, or to a null one.
    """
    docs = id_text(docs, id_col, text_col)
    fields = "doc_id long, n_shingles long, digest binary, signature binary"
    sketched = materialize(map_texts(docs, _sketches(words), fields), "sketches")
    full = sketched.filter("n_shingles > 0")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("node")).filter("node IS NOT NULL")
    first = full.select(F.col("doc_id").alias("node"), "digest", "signature", "n_shingles")
    nodes = materialize(first.join(classes, ["node", "digest"], "left_semi").dropDuplicates(["node", "digest"]), "nodes")

    threshold = match_threshold(percent)
    loose = components(candidate_links(nodes.select("node", "signature"), threshold), thinned=True)
    members = nodes.select("node", "n_shingles").join(loose, "node")
    size = members.groupBy("component").agg(F.ceil(F.sum("n_shingles") / CLUSTER_BLOCK).alias("blocks"))
    members = loose.join(size, "component")

    def sets(part: pa.RecordBatch) -> dict:
        found = shingle_sets(text_bytes(part.column("text")), words)
        return {c: part.column(c) for c in ("node", "component", "blocks")} | {"shingles": [s.tobytes() for s in found]}

    texts = docs.withColumnRenamed("doc_id", "node").join(members, "node")
    full_sets = map_texts(texts, sets, "node long, component long, blocks long, shingles binary")
    paired = block_pairs(full_sets, F.col("blocks")).withColumnRenamed("component", "key")
    paired = paired.select(*PAIRED, "block", "node", "shingles")
    links = _by_pair(paired).mapInArrow(confirmed_links(percent), "a long, b long")
    repeated = full.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    same_id = full.join(repeated, "doc_id", "left_semi").join(classes, "digest").select("doc_id", "node")
    found = components(links.union(same_id), thinned=True)

    group = F.coalesce("component", "node")
    classes = classes.join(found, "node", "left").select("digest", group.alias("component_id"))
    out = sketched.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
