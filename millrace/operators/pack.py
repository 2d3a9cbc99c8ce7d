"""Fixed-length token sequences and their places in shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.prefix import CHUNK_BITS, running_totals
from millrace.session import small_side

SEQ_LEN = 4_096
PER_SHARD = 100_000
HEADER_BYTES = 36
PAD, BOS, EOS = 0, 1, 2
IGNORE_LABEL = -100


def frame(ids: Column, bos: int = BOS, eos: int = EOS) -> Column:
    """Token ids between a begin and an end mark."""
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def token_offsets(
    docs: DataFrame, framed: bool = True, scope: str = "source", bits: int = CHUNK_BITS
) -> DataFrame:
    """Adds ``framed_len`` and ``start``, the document's place in its token stream.

    ``docs`` needs ``domain, doc_seq, n_tokens``.  With ``scope="global"`` the
    domains form one stream in ``plan_order``.
    """
    lengths = docs.withColumn("framed_len", (F.col("n_tokens") + (2 if framed else 0)).cast("long"))
    placed = running_totals(lengths, ["domain"], "doc_seq", ["framed_len"], bits)
    if scope == "source":
        return placed.withColumnRenamed("framed_len_before", "start")
    if scope != "global":
        raise ValueError(f"scope must be 'source' or 'global', not {scope!r}")
    per_domain = lengths.groupBy("domain", "plan_order").agg(F.sum("framed_len").alias("_len"))
    before = Window.orderBy("plan_order").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_domain.select(
        "domain", F.coalesce(F.sum("_len").over(before), F.lit(0)).alias("_shift")
    )
    return (
        placed.join(small_side(shifts, per_domain.count()), "domain")
        .withColumn("start", F.col("framed_len_before") + F.col("_shift"))
        .drop("framed_len_before", "_shift")
    )


def pack(
    docs: DataFrame,
    seq_len: int = SEQ_LEN,
    framed: bool = True,
    tail: str = "pad",
    scope: str = "source",
    bos: int = BOS,
    eos: int = EOS,
    pad: int = PAD,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Cuts each source's token stream into sequences: ``(source, seq, tokens, n_real)``.

    ``docs`` needs ``domain, doc_seq, n_tokens, ids`` and ``plan_order`` with
    ``scope="global"``, which gives one source ``all``.  Every document is sliced
    at the sequence borders where it lies, so the second shuffle moves pieces of
    at most ``seq_len`` ids, keyed by sequence: no key has more than ``seq_len``
    ids whatever the sizes of documents and sources.
    """
    if tail not in ("pad", "drop"):
        raise ValueError(f"tail must be 'pad' or 'drop', not {tail!r}")
    source = F.col("domain") if scope == "source" else F.lit("all")
    ids = frame(F.col("ids"), bos, eos) if framed else F.col("ids")
    placed = token_offsets(docs, framed, scope, bits).filter(F.col("framed_len") > 0)
    end = F.col("start") + F.col("framed_len")
    length = F.lit(seq_len)
    spans = placed.select(source.alias("source"), "start", end.alias("end"), ids.alias("ids"))
    reach = F.sequence(F.floor(F.col("start") / length), F.floor((F.col("end") - 1) / length))

    def piece(seq):
        low = F.greatest(seq * length, F.col("start"))
        high = F.least((seq + 1) * length, F.col("end"))
        ids = F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
        return F.struct(seq.alias("seq"), low.alias("low"), ids.alias("piece"))

    # The slices are cut before they become rows, so the whole ids are not copied once a sequence.
    pieces = spans.select("source", F.inline(F.transform(reach, piece)))
    # Pieces of one sequence seldom meet in a map task, so they are not combined there.
    joined = pieces.repartition("source", "seq").groupBy("source", "seq").agg(
        F.array_sort(F.collect_list(F.struct("low", "piece"))).alias("parts")
    ).select(
        "source",
        "seq",
        F.flatten(F.col("parts.piece")).alias("real"),
    )
    n_real = F.size("real")
    if tail == "drop":
        return joined.filter(n_real == seq_len).select(
            "source", "seq", F.col("real").alias("tokens"), n_real.alias("n_real")
        )
    return joined.select(
        "source",
        "seq",
        F.concat("real", F.array_repeat(F.lit(pad), F.lit(seq_len) - n_real)).alias("tokens"),
        n_real.alias("n_real"),
    )


def sequence_counts(
    docs: DataFrame, seq_len: int = SEQ_LEN, framed: bool = True, tail: str = "pad"
) -> DataFrame:
    """``(source, n_sequences)`` that :func:`pack` will give, from token counts alone."""
    extra = 2 if framed else 0
    total = F.sum(F.col("n_tokens") + extra) / seq_len
    whole = F.ceil(total) if tail == "pad" else F.floor(total)
    return docs.groupBy(F.col("domain").alias("source")).agg(
        whole.cast("long").alias("n_sequences")
    )


def shard_plan(counts: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """Adds ``first_shard``: shards are numbered through the sources in ``source_order``.

    One row per source; needs ``source, source_order, n_sequences``.
    """
    before = Window.orderBy("source_order").rowsBetween(Window.unboundedPreceding, -1)
    shards = F.ceil(F.col("n_sequences") / per_shard)
    return counts.withColumn("first_shard", F.coalesce(F.sum(shards).over(before), F.lit(0)))


def assign_shards(
    packed: DataFrame, plan: DataFrame, plan_rows: int, per_shard: int = PER_SHARD
) -> DataFrame:
    """Adds ``shard_id, seq_in_shard, num_sequences`` (the length of the shard)."""
    in_source = F.floor(F.col("seq") / per_shard)
    side = small_side(plan.select("source", "n_sequences", "first_shard"), plan_rows)
    return (
        packed.join(side, "source")
        .withColumns(
            {
                "shard_id": (F.col("first_shard") + in_source).cast("int"),
                "seq_in_shard": F.col("seq") % per_shard,
                "num_sequences": F.least(
                    F.lit(per_shard), F.col("n_sequences") - in_source * per_shard
                ).cast("long"),
            }
        )
        .drop("n_sequences", "first_shard")
    )


def sequence_offset(seq_in_shard: Column, seq_len: int = SEQ_LEN) -> Column:
    """Byte at which a sequence starts in its shard file."""
    return F.lit(HEADER_BYTES) + seq_in_shard * F.lit(4 * seq_len).cast("long")


def to_examples(sequences: DataFrame, ignore_id: int = PAD) -> DataFrame:
    """Replaces ``tokens`` by ``input_ids`` and ``labels``, shifted once by one place.

    A label equal to ``ignore_id`` becomes -100; inputs stay as they are.
    """
    last = F.size("tokens") - 1
    shifted = F.slice("tokens", F.lit(2), last)
    labels = F.transform(
        shifted, lambda x: F.when(x == ignore_id, F.lit(IGNORE_LABEL)).otherwise(x)
    )
    return sequences.withColumns(
        {"input_ids": F.slice("tokens", F.lit(1), last), "labels": labels}
    ).drop("tokens")


def out_of_range(tokens: Column, vocab_size: int) -> Column:
    """How many ids of a sequence lie outside ``[0, vocab_size)``."""
    return F.size(F.filter(tokens, lambda x: (x < 0) | (x >= vocab_size)))


def corpus_stats(shards: DataFrame) -> DataFrame:
    """Shards, sequences, tokens and bytes from ``(num_sequences, seq_length)`` per shard."""
    tokens = F.col("num_sequences") * F.col("seq_length")
    return shards.agg(
        F.count("*").alias("n_shards"),
        F.sum("num_sequences").alias("n_sequences"),
        F.sum(tokens).alias("n_tokens"),
        F.sum(HEADER_BYTES + 4 * tokens).alias("n_bytes"),
    )
