"""Best-fit packing with certified bin counts.

Documents become pieces: a first piece with what is left over from whole
sequences, then pieces that fill a sequence alone.  The short pieces are dealt
into groups of bounded size, and each group is packed by best-fit decreasing.
Dual-feasible functions give a lower bound on the sequences a group needs; a
group that meets its bound is certified and stays.  The groups with a gap put
the pieces of their unfilled sequences together, are dealt anew into fewer groups and run best-fit
decreasing again; a round is kept if it needs fewer sequences.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.byte_ids import byte_ids
from millrace.llm.common import id_text, map_texts
from millrace.session import materialize

CAPACITY = 1024
GROUP_PIECES = 50_000
ROUNDS = 4
BINS = 32  # bits of a sequence id that number sequences within a group

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long, filled long, used long, bound long"


def pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 2,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A row per piece of every whole document, each document ended by ``end_id``.

    A null or empty text is the end id alone.  Rows that share an id are documents of their own.
    """

    def cut(part: pa.RecordBatch) -> dict:
        encoder, end = byte_ids(tokenizer_path), np.array([end_id], "<u4").tobytes()
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        encoded = encoder.encode(part.column("text").to_pylist())
        for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
            raw = ids + end
            n = len(raw) // 4
            first = n % capacity or capacity
            edges = [0, *range(first, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                out["doc_id"].append(doc_id)
                out["piece"].append(k)
                out["start"].append(a)
                out["length"].append(b - a)
                out["ids_crc32"].append(zlib.crc32(raw[4 * a:4 * b]))
        return out

    return map_texts(id_text(docs, id_col, text_col), cut, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences any packing of ``lengths`` needs, by two families of dual-feasible functions.

    For a threshold t up to half the capacity, the first counts lengths over
    ``capacity - t`` as whole, drops those under t and keeps the others.  The
    second rounds ``(k + 1) * length / capacity`` down to a k-th part unless it is whole.
    """
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(counts @ sizes) // capacity)
    volume = np.cumsum(counts * sizes)
    number = np.cumsum(counts)
    for t in range(1, capacity // 2 + 1):
        whole = int(number[capacity] - number[capacity - t])
        middle = int(volume[capacity - t] - volume[t - 1])
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 101):
        share = (k + 1) * sizes
        scaled = np.where(share % capacity == 0, k * sizes, (share // capacity) * capacity)
        best = max(best, -(-int(counts @ scaled) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins.

    Ties go by place in ``lengths``.  Open bins are kept per room left, and a bit
    set of the rooms that occur gives the smallest one that is large enough.
    """
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, n_bins = 0, 0
    for at, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = open_rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            room, chosen = capacity, n_bins
            n_bins += 1
        bins[at], offsets[at] = chosen, capacity - room
        left = room - length
        if left:
            rooms[left].append(chosen)
            open_rooms |= 1 << left
    return bins, offsets, n_bins


def _pack_groups(dealt: DataFrame, capacity: int, first_group: int) -> DataFrame:
    """Packs each value of ``_group``; every row learns its group's bound and its sequence's fill."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        group = first_group + int(rows["_group"].iloc[0])
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        return rows.assign(
            sequence_id=(group << BINS) + bins, offset=offsets, filled=fill[bins],
            used=used, bound=lower_bound(lengths, capacity),
        )[[f.split()[0] for f in PLACED.split(", ")]]

    return dealt.groupBy("_group").applyInPandas(pack, PLACED)


def _deal(rows: DataFrame, n_groups: int, seed: int) -> DataFrame:
    """Deals stored rows by their keys and their place in the stored table, which tells equal rows apart."""
    place = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(seed))
    return rows.withColumn("_group", F.pmod(place, F.lit(n_groups)).cast("int"))


def _certificates(placed: DataFrame) -> dict:
    """Groups, their sequences and bounds in total, and how many groups have a gap."""
    groups = placed.groupBy(F.shiftright("sequence_id", BINS)).agg(F.max("used").alias("used"), F.max("bound").alias("bound"))
    totals = groups.agg(
        F.count("*").alias("groups"), F.sum("used").alias("used"), F.sum("bound").alias("bound"),
        F.count_if(F.col("used") > F.col("bound")).alias("with_gap"),
    )
    return totals.first().asDict()


@dataclass
class Report:
    """For each round: groups, their sequences and lower bounds in total, and how many groups have a gap."""

    rounds: list[dict]


def pack(
    cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS,
    report: Report | None = None,
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces no longer than ``capacity``.

    ``cut`` is read more than once, so it should be a stored table.  No group
    holds much more than ``group_pieces`` rows, whatever the keys: rows without id and with
    equal texts are dealt apart as well.
    """
    whole = cut.filter(F.col("length") == capacity).withColumns({
        "sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"),
    })
    columns = whole.columns
    done, first_group = [whole], 0
    pool, unfilled, before = cut.filter(F.col("length") < capacity), None, None
    n = pool.count()
    for round_ in range(rounds + 1):
        if not n:
            break
        n_groups = -(-n // group_pieces)
        placed = materialize(_pack_groups(_deal(pool, n_groups, round_), capacity, first_group), "packed")
        certified = _certificates(placed)
        if report is not None:
            report.rounds.append(certified)
        if before is not None and certified["used"] >= before:
            break
        gap = F.col("used") > F.col("bound")
        exchange = gap & (F.col("filled") < capacity) & F.lit(certified["with_gap"] > 1)
        done.append(placed.filter(~exchange).select(columns))
        unfilled = placed.filter(exchange)
        before = unfilled.agg(F.countDistinct("sequence_id")).first()[0]
        pool = unfilled.select(cut.columns)
        n = pool.count()
        first_group += n_groups
    if n:
        done.append(unfilled.select(columns))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
