"""Token budgets over a stream, across micro-batches and restarts.

The ledger carries per domain how many surviving documents were read, how many
tokens were kept, and how much of that lies in the batch still open, so the cut
does not depend on how the input falls into micro-batches.  A micro-batch writes
its documents to a folder of its own and its ledger rows last; both replace what
an earlier attempt of the same micro-batch left, and the state is read from
earlier batches only.  Repeating a micro-batch therefore changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.ledger import append_ledger
from millrace.operators.prefix import CHUNK_BITS, running_totals
from millrace.operators.quota import quota_cuts, within_cut
from millrace.session import materialize, small_side

STATE_SCHEMA = (
    "domain string, done_tokens long, open_docs long, open_tokens long, "
    "tokens_added long, docs_written long, docs_skipped long, survivors long, "
    "resume_seq long, batch_id long"
)


def start_quota(
    measured: DataFrame,
    plan: DataFrame,
    docs_path: str,
    ledger_path: str,
    checkpoint: str,
    bits: int = CHUNK_BITS,
) -> StreamingQuery:
    """Applies the plan's budgets to a stream of measured documents.

    ``measured`` is ``(domain, doc_seq, survivor, n_tokens, ...)``; the documents
    of a domain must arrive in ``doc_seq`` order from one micro-batch to the next.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        take_batch(batch, batch_id, plan, docs_path, ledger_path, bits)

    return (
        measured.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def take_batch(
    batch: DataFrame, batch_id: int, plan: DataFrame, docs_path: str, ledger_path: str,
    bits: int = CHUNK_BITS,
) -> None:
    """One micro-batch: documents first, ledger last."""
    rows = plan.count()
    stored = materialize(batch, "quota-batch")
    state = stream_state(plan, ledger_path, before=batch_id)
    cuts = quota_cuts(
        stored.select("domain", "doc_seq", "survivor", "n_tokens"), plan, ledger=state, bits=bits
    )
    scanned = within_cut(stored, cuts, rows)
    scanned.filter(F.col("n_tokens") > 0).write.mode("overwrite").parquet(
        f"{docs_path}/batch_id={batch_id}"
    )
    append_ledger(_next_state(scanned, plan, state, rows, bits), ledger_path, batch_id)


def stream_state(plan: DataFrame, ledger_path: str, before: int) -> DataFrame:
    """State of every plan domain after the micro-batches before ``before``.

    Every ledger batch holds the full state of all domains, so only the last one
    is read for it.
    """
    spark = plan.sparkSession
    none = F.lit(0).cast("long")
    if before == 0:
        return plan.select(
            "domain",
            none.alias("done_tokens"),
            none.alias("open_docs"),
            none.alias("open_tokens"),
        )
    last = spark.read.schema(STATE_SCHEMA).parquet(f"{ledger_path}/batch_id={before - 1}")
    return plan.select("domain").join(
        last.select("domain", "done_tokens", "open_docs", "open_tokens"), "domain", "left"
    ).fillna(0)


def _next_state(scanned, plan, state, rows, bits):
    """Counters of this micro-batch and the state after it.

    Survivors that complete a batch of the plan move their tokens from open to
    done; the rest stays open.
    """
    survivors = (
        scanned.filter("survivor")
        .select("domain", "doc_seq", "n_tokens", F.lit(1).cast("long").alias("one"))
    )
    placed = running_totals(survivors, ["domain"], "doc_seq", ["one"], bits)
    counts = scanned.groupBy("domain").agg(
        F.count_if(F.col("survivor") & (F.col("n_tokens") > 0)).alias("docs_written"),
        F.count_if(~F.col("survivor")).alias("docs_skipped"),
        F.count_if("survivor").alias("survivors"),
        F.sum("n_tokens").alias("tokens_added"),
        F.max("doc_seq").alias("resume_seq"),
    )
    merged = (
        plan.select("domain", "batch")
        .join(state, "domain")
        .join(counts, "domain", "left")
        .fillna(0, ["docs_written", "docs_skipped", "survivors", "tokens_added"])
        .fillna(-1, ["resume_seq"])
        .withColumn("_total", F.col("open_docs") + F.col("survivors"))
        .withColumn("_open", F.col("_total") % F.col("batch"))
        .withColumn("_closed", F.col("_total") - F.col("_open") - F.col("open_docs"))
    )
    # Tokens of this micro-batch's survivors that stay in the open batch.
    tail = (
        placed.join(small_side(merged.select("domain", "_closed"), rows), "domain")
        .groupBy("domain")
        .agg(
            F.sum(F.when(F.col("one_before") >= F.col("_closed"), F.col("n_tokens")).otherwise(0))
            .alias("_tail")
        )
    )
    closes = F.col("_closed") >= 0
    tail_tokens = F.coalesce("_tail", F.lit(0))
    return (
        merged.join(tail, "domain", "left")
        .select(
            "domain",
            F.when(
                closes,
                F.col("done_tokens") + F.col("open_tokens") + F.col("tokens_added") - tail_tokens,
            )
            .otherwise(F.col("done_tokens"))
            .alias("done_tokens"),
            F.col("_open").alias("open_docs"),
            F.when(closes, tail_tokens)
            .otherwise(F.col("open_tokens") + F.col("tokens_added"))
            .alias("open_tokens"),
            "tokens_added",
            "docs_written",
            "docs_skipped",
            "survivors",
            "resume_seq",
        )
    )
