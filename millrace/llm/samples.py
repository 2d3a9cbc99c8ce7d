"""Bounded, repeatable samples of labelled texts for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_CHARS = 1 << 16  # longer texts are not fitted on; they are scored like any other


def labelled_sample(texts: DataFrame, marks: DataFrame, per_label: int) -> list[tuple]:
    """About ``per_label`` pairs ``(text, label)`` of each label, in the order of their ids.

    ``marks`` are rows ``(doc_id, label)``; ids are chosen by a hash from them
    alone, and only the chosen texts are read whole and collected.  An id with several labels
    counts for the smallest, one with several texts for the smallest of them; rows without id, label or text do
    not count.  The number of distinct labels must be small.
    """
    marks = marks.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = marks.groupBy("label").count().collect()
    share = F.lit(0.0)
    for value, n in counts:
        share = F.when(F.col("label") == F.lit(value), F.lit(min(per_label / n, 1.0))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    labels = dict(marks.filter(place < share * (1 << 20)).collect())  # about per_label for each label
    if not labels:
        return []
    chosen = texts.filter(F.col("doc_id").isin(list(labels)) & (F.length("text") <= SAMPLE_CHARS))
    found = chosen.groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return [(r["text"], labels[r["doc_id"]]) for r in found]
