"""Dense document ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialize, small_side

_IN_PARTITION = (1 << 33) - 1


def with_doc_seq(
    df: DataFrame,
    keys: list[str],
    group: str = "domain",
    partitions: int | None = None,
    out: str = "doc_seq",
) -> DataFrame:
    """Numbers the rows of each group 0, 1, 2, ... in the order of ``keys``.

    The rows are range-partitioned on ``(group, keys)``, sorted, and written
    with their partition number and place, so both are fixed from then on.  What
    is left is one count per (group, partition), which bounds the joined side by
    the number of partitions plus the number of groups.  No window sees the rows,
    and a hot group is spread over as many partitions as its share of rows.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(n, group, *keys).sortWithinPartitions(group, *keys)
    placed = materialize(
        sorted_rows.withColumns(
            {
                "_part": F.spark_partition_id(),
                "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)),
            }
        ),
        "doc-seq",
    )
    runs = placed.groupBy(group, "_part").agg(
        F.count("*").alias("_n"), F.min("_place").alias("_first")
    )
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(
        group,
        "_part",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return (
        placed.join(small_side(shifts, runs.count()), [group, "_part"])
        .withColumn(out, F.col("_place") + F.col("_shift"))
        .drop("_part", "_place", "_shift")
    )
