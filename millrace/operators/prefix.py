"""Running sums and previous-row lookups that no single task has to carry.

A window over a whole domain would put that domain into one task.  Here the
(non-negative, unique) order key is cut into chunks of ``2**bits`` consecutive
values.  Each chunk is a window of its own, chunk totals are one row per chunk,
and the same function is applied to the chunk table until one chunk is left.
So no window partition ever exceeds ``2**bits`` rows, whatever the data, and the
rows themselves shuffle once.  The cut depends on the key values alone, which
makes recomputation after a lost executor give the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BITS = 16


def chunk_levels(df: DataFrame, order: str, bits: int) -> int:
    """How many times the key range must be divided by ``2**bits`` to reach one chunk."""
    low, top = df.agg(F.min(order), F.max(order)).first()
    if low is not None and low < 0:
        raise ValueError(f"order column {order} must not be negative")
    return max(1, -(-int(top or 0).bit_length() // bits))


def running_totals(
    df: DataFrame,
    group: list[str],
    order: str,
    measures: list[str],
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Adds ``<m>_before`` for each measure: its sum over earlier rows of the group."""
    return _totals(df, group, order, measures, bits, chunk_levels(df, order, bits))


def _totals(df, group, order, measures, bits, levels):
    chunk = f"_chunk{levels}"
    chunked = df.withColumn(chunk, F.shiftright(F.col(order).cast("long"), bits))
    earlier = (
        Window.partitionBy(*group, chunk)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = chunked.withColumns(
        {f"{m}_before": F.coalesce(F.sum(m).over(earlier), F.lit(0)) for m in measures}
    )
    if levels == 1:
        return within.drop(chunk)
    sums = chunked.groupBy(*group, chunk).agg(*[F.sum(m).alias(m) for m in measures])
    offsets = _totals(sums, group, chunk, measures, bits, levels - 1).select(
        *group, chunk, *[F.col(f"{m}_before").alias(f"_offset_{m}") for m in measures]
    )
    joined = within.join(offsets, [*group, chunk])
    return joined.select(
        *df.columns,
        *[(F.col(f"{m}_before") + F.col(f"_offset_{m}")).alias(f"{m}_before") for m in measures],
    )


def previous_row(
    df: DataFrame,
    group: list[str],
    order: str,
    columns: list[str],
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Adds ``prev_<c>``: the value in the group's preceding row, null for the first."""
    found = _previous(
        df.withColumn("_row", F.struct(*columns)),
        group, order, bits, chunk_levels(df, order, bits),
    )
    return found.select(
        *df.columns, *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in columns]
    )


def _previous(df, group, order, bits, levels):
    chunk = f"_chunk{levels}"
    chunked = df.withColumn(chunk, F.shiftright(F.col(order).cast("long"), bits))
    within = chunked.withColumn(
        "_prev", F.lag("_row").over(Window.partitionBy(*group, chunk).orderBy(order))
    )
    if levels == 1:
        return within.drop(chunk)
    lasts = chunked.groupBy(*group, chunk).agg(F.max_by("_row", order).alias("_row"))
    carried = _previous(lasts, group, chunk, bits, levels - 1).select(
        *group, chunk, F.col("_prev").alias("_carried")
    )
    return (
        within.join(carried, [*group, chunk])
        .withColumn("_prev", F.coalesce("_prev", "_carried"))
        .drop(chunk, "_carried")
    )
