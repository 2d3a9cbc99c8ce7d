"""Documents' token ids sent straight to the place of their shard, in one shuffle.

Packing joins the documents of a source into one stream and cuts it into sequences, and shards are runs of
sequences, so the body of a shard is a run of the stream.  Once every document knows its start, its ids are cut
where shards meet (seldom) and dealt to their shards' tasks.  Starts come from narrow rows: a
task that stores documents numbers its runs of neighbouring ones and sums their lengths; only the runs (one row each) are then put in order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.operators.pack import BOS, EOS, PER_SHARD, SEQ_LEN, frame
from millrace.operators.prefix import running_totals
from millrace.session import materialize

RUN_ROWS = 1_000_000  # runs that are broadcast at most, three numbers each
SHARD_BYTES = 4 * SEQ_LEN * PER_SHARD


def sequences_per_shard(seq_len: int, shard_bytes: int = SHARD_BYTES) -> int:
    """How many sequences make about ``shard_bytes``, so that a shard does not grow with the sequence length."""
    return max(1, shard_bytes // (4 * seq_len))


def store_runs(docs: DataFrame, name: str) -> DataFrame:
    """Stores ``docs`` with ``run`` and ``before``; needs ``domain, doc_seq, framed_len``, all without nulls.

    A run is a stretch of rows of one domain with consecutive ``doc_seq`` values in one task, so no
    other document can lie inside it; ``before`` is the length of its earlier rows.  Rows keep their place and are not
    shuffled.  Documents in order make one run per task and domain; any other order only makes more runs.
    """
    columns = docs.columns
    schema = StructType([*docs.schema.fields, StructField("_nth", LongType()), StructField("before", LongType())])

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, total, last = -1, 0, (None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            domain = batch.column(columns.index("domain"))
            seq = batch.column(columns.index("doc_seq")).to_numpy(zero_copy_only=False)
            length = batch.column(columns.index("framed_len")).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = domain.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            starts = np.r_[True, (codes[1:] != codes[:-1]) | (seq[1:] != seq[:-1] + 1)]
            if last == (domain[0].as_py(), int(seq[0]) - 1):
                starts[0] = False
            sums = np.cumsum(length) - length
            heads = np.flatnonzero(starts)
            # Sums since the latest head; rows before the first one go on with the run of the last batch.
            place = np.cumsum(starts) - 1
            base = sums[heads[np.maximum(place, 0)]] if len(heads) else np.zeros(len(sums), np.int64)
            before = np.where(place < 0, total + sums, sums - base)
            runs = nth + 1 + place
            nth, total = int(runs[-1]), int(before[-1] + length[-1])
            last = (domain[-1].as_py(), int(seq[-1]))
            arrays = [*batch.columns, pa.array(runs.astype(np.int64)), pa.array(before.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "_nth", "before"])

    numbered = docs.mapInArrow(number, schema)
    run = F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("_nth")
    return materialize(numbered.withColumn("run", run).drop("_nth"), name)


def token_starts(stored: DataFrame) -> DataFrame:
    """Adds ``start``, the document's place in its domain's token stream, to what :func:`store_runs` gave."""
    runs = stored.groupBy("domain", "run").agg(F.min("doc_seq").alias("first_seq"), F.sum("framed_len").alias("length"))
    placed = materialize(
        running_totals(materialize(runs, "runs"), ["domain"], "first_seq", ["length"]).select("run", "length_before"), "run-starts"
    )
    side = F.broadcast(placed) if placed.count() <= RUN_ROWS else placed
    start = F.col("before") + F.col("length_before")
    return stored.join(side, "run").withColumn("start", start).drop("run", "before", "length_before")


def shard_pieces(
    placed: DataFrame, plan: DataFrame, seq_len: int, per_shard: int, framed: bool = True, bos: int = BOS, eos: int = EOS
) -> DataFrame:
    """``(shard_id, first, tokens, num_sequences, seq_length)``: each document's ids, cut where shards meet.

    ``plan`` has one row per source (:func:`millrace.operators.pack.shard_plan`); ids behind its last sequence are
    the tail that is dropped.  ``first`` is the piece's place in the body of its shard.
    """
    shard_tokens = seq_len * per_shard
    side = plan.select(F.col("source").alias("domain"), "n_sequences", "first_shard")
    docs = placed.join(F.broadcast(side) if plan.count() <= RUN_ROWS else side, "domain")
    end = F.least(F.col("start") + F.col("framed_len"), F.col("n_sequences") * seq_len)
    whole = docs.withColumns({"end": end, "all": frame(F.col("ids"), bos, eos) if framed else F.col("ids")})
    shards = F.sequence(F.floor(F.col("start") / shard_tokens), F.floor((F.col("end") - 1) / shard_tokens))

    def piece(k):
        low = F.greatest(k * shard_tokens, F.col("start"))
        high = F.least((k + 1) * shard_tokens, F.col("end"))
        tokens = F.slice("all", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
        return F.struct(
            (F.col("first_shard") + k).cast("int").alias("shard_id"),
            (low - k * shard_tokens).alias("first"),
            tokens.alias("tokens"),
            F.least(F.lit(per_shard), F.col("n_sequences") - k * per_shard).cast("long").alias("num_sequences"),
            F.lit(seq_len).cast("long").alias("seq_length"),
        )

    return whole.filter(F.col("end") > F.col("start")).select(F.inline(F.transform(shards, piece)))
