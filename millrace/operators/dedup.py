"""Exact duplicates and already-ingested rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import small_side


def text_key(text: str = "text_norm"):
    """SHA-256 of the text as 32 bytes."""
    return F.unhex(F.sha2(F.col(text), 256))


def first_copies(
    docs: DataFrame, scope: str = "domain", text: str = "text_norm"
) -> DataFrame:
    """``(domain, doc_seq)`` of the first document of every distinct text.

    An aggregation, not a window: map tasks reduce each hash to one candidate,
    so a text that makes up a third of all rows arrives as one row per task.
    With ``scope="global"`` the order is ``(plan_order, doc_seq)``.
    """
    hashed = docs.withColumn("_key", text_key(text))
    if scope == "domain":
        return (
            hashed.groupBy("domain", "_key")
            .agg(F.min("doc_seq").alias("doc_seq"))
            .drop("_key")
        )
    if scope == "global":
        return (
            hashed.groupBy("_key")
            .agg(F.min(F.struct("plan_order", "doc_seq", "domain")).alias("_first"))
            .select("_first.domain", "_first.doc_seq")
        )
    raise ValueError(f"scope must be 'domain' or 'global', not {scope!r}")


def dedup_exact(docs: DataFrame, scope: str = "domain", text: str = "text_norm") -> DataFrame:
    """Keeps the first copy of every text, all columns.

    The way back to the full rows is a semi-join on the document's own key,
    which is unique and therefore spreads evenly.
    """
    return docs.join(first_copies(docs, scope, text), ["domain", "doc_seq"], "left_semi")


def skip_ingested(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Drops rows at or before the ledger's resume position of their domain."""
    positions = small_side(ledger.select("domain", "resume_seq"), ledger.count())
    return (
        docs.join(positions, "domain", "left")
        .filter(F.col("doc_seq") > F.coalesce("resume_seq", F.lit(-1)))
        .drop("resume_seq")
    )
