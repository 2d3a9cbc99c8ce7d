"""Token budgets: where each domain's document stream is cut.

A domain is read in ``doc_seq`` order.  Surviving documents form batches of
``batch`` documents (1 = the test is made before every document); progress moves
when a batch is complete, the test is made between batches, and the batch that
crosses the budget is kept whole.  A global target applies to the domains one
after the other in plan order.

Only the cut is order-dependent, and it is one position per domain.  It is found
through chunk totals (an aggregation with map-side combine) and then inside the
one chunk per domain that holds it, so no document is shuffled and no running sum
over documents is needed.  The documents are then filtered against the cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.prefix import CHUNK_BITS, running_totals
from millrace.session import materialize, small_side

# Input rows ("measured"): domain, doc_seq, survivor, n_tokens
# Plan rows: domain, plan_order, quota, batch


def quota_cuts(
    measured: DataFrame,
    plan: DataFrame,
    target: int | None = None,
    ledger: DataFrame | None = None,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """One stored row per plan domain: ``need`` (tokens wanted), ``cut_seq``, ``added``.

    A row of the domain is scanned if ``need > 0`` and ``doc_seq <= cut_seq``; a
    null ``cut_seq`` means the domain ends below its budget.  ``added`` is the
    number of tokens kept.  ``measured`` is read several times, so it should be a
    stored table of these four columns.  ``ledger`` gives tokens already
    collected (``done_tokens``), and for a batch left open by an earlier
    micro-batch the documents in it (``open_docs``) and the tokens already kept
    from it (``open_tokens``).
    """
    rows = plan.count()
    chunks = _chunk_index(measured, bits)
    state = _with_progress(plan, ledger)

    wanted = state.withColumn("need", F.col("quota") - F.col("done_tokens"))
    own = materialize(_cut(measured, chunks, wanted, rows, bits), "quota-cuts")
    if target is None:
        return own

    before = Window.orderBy("plan_order").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left_plan = _tokens_outside(plan, ledger)
    limited = own.withColumns(
        {
            "_elsewhere": F.sum("done_tokens").over(everything) - F.col("done_tokens") + F.lit(left_plan),
            "_earlier": F.coalesce(F.sum("added").over(before), F.lit(0)),
        }
    ).withColumn(
        "_left", F.lit(target) - F.col("_elsewhere") - F.col("_earlier") - F.col("done_tokens")
    )
    bound = F.col("_left") < F.col("need")
    limited = materialize(limited.withColumn("_bound", bound), "quota-limits")
    # Domains the target does not touch keep their cut; the others are cut again.
    again = _cut(
        measured,
        chunks,
        limited.filter("_bound").withColumn("need", F.col("_left")).select(*wanted.columns),
        rows,
        bits,
    )
    untouched = limited.filter(~F.col("_bound")).select(*own.columns)
    return materialize(untouched.unionByName(again), "quota-cuts")


def apply_quota(
    docs: DataFrame,
    measured: DataFrame,
    plan: DataFrame,
    target: int | None = None,
    ledger: DataFrame | None = None,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """The documents kept under the plan; ``docs`` needs ``domain, doc_seq, n_tokens``."""
    cuts = quota_cuts(measured, plan, target, ledger, bits)
    return within_cut(docs, cuts, plan.count()).filter(F.col("n_tokens") > 0)


def within_cut(docs: DataFrame, cuts: DataFrame, plan_rows: int) -> DataFrame:
    """Rows of ``docs`` that were scanned before their domain stopped."""
    side = small_side(cuts.select("domain", "need", "cut_seq"), plan_rows)
    return (
        docs.join(side, "domain")
        .filter((F.col("need") > 0) & F.coalesce(F.col("doc_seq") <= F.col("cut_seq"), F.lit(True)))
        .drop("need", "cut_seq")
    )


def accounting(
    measured: DataFrame,
    plan: DataFrame,
    target: int | None = None,
    ledger: DataFrame | None = None,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Per domain of the plan: documents written, skipped and without tokens."""
    cuts = quota_cuts(measured, plan, target, ledger, bits)
    scanned = within_cut(measured, cuts, plan.count())
    counts = scanned.groupBy("domain").agg(
        F.count_if(F.col("survivor") & (F.col("n_tokens") > 0)).alias("written"),
        F.count_if(~F.col("survivor")).alias("skipped"),
        F.count_if(F.col("survivor") & (F.col("n_tokens") == 0)).alias("zero_token"),
    )
    return plan.select("domain").join(counts, "domain", "left").fillna(0)


def batch_sums(
    measured: DataFrame, batch: int, bits: int = CHUNK_BITS
) -> DataFrame:
    """Documents and tokens of each run of ``batch`` surviving documents per domain."""
    kept = measured.filter("survivor").withColumn("_one", F.lit(1).cast("long"))
    placed = running_totals(kept, ["domain"], "doc_seq", ["_one"], bits)
    return (
        placed.groupBy("domain", F.floor(F.col("_one_before") / batch).alias("batch_no"))
        .agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("batch_tokens"))
    )


def _tokens_outside(plan, ledger) -> int:
    """Tokens of state rows whose domain has left the plan; they count towards the target."""
    if ledger is None:
        return 0
    outside = ledger.join(plan.select("domain"), "domain", "left_anti")
    return outside.agg(F.sum("done_tokens")).first()[0] or 0


def _with_progress(plan, ledger):
    if ledger is None:
        state = plan
    else:
        known = [c for c in ("done_tokens", "open_docs", "open_tokens") if c in ledger.columns]
        state = plan.join(ledger.select("domain", *known), "domain", "left")
    for c in ("done_tokens", "open_docs", "open_tokens"):
        have = F.coalesce(F.col(c), F.lit(0)) if c in state.columns else F.lit(0)
        state = state.withColumn(c, have.cast("long"))
    return state.select(
        "domain", "plan_order", "quota", "batch", "done_tokens", "open_docs", "open_tokens"
    )


def _chunk_index(measured, bits):
    """Totals and running totals of fixed-width chunks of the order key, stored."""
    sums = (
        measured.filter("survivor")
        .groupBy("domain", F.shiftright(F.col("doc_seq"), bits).alias("chunk"))
        .agg(F.count("*").alias("n"), F.sum("n_tokens").alias("w"))
    )
    sums = materialize(sums, "quota-chunks")
    return materialize(running_totals(sums, ["domain"], "chunk", ["n", "w"], bits), "quota-index")


def _cut(measured, chunks, wanted, rows, bits):
    """Resolves ``need`` (counted without the open batch) to the last scanned row."""
    active = wanted.filter("need > 0")
    crossing = _place_of_weight(measured, chunks, active, rows, bits)
    # A batch is kept whole, so the cut is the last document of the crossing batch.
    # Documents in the open batch shift the batch boundaries, and may have crossed already.
    place = F.when(F.col("need") <= F.col("open_tokens"), -1).otherwise(F.col("place"))
    placed = active.join(small_side(crossing, rows), "domain", "left").withColumn("place", place)
    ends = placed.filter(F.col("place").isNotNull()).select(
        "domain",
        (
            (F.floor((F.col("place") + F.col("open_docs")) / F.col("batch")) + 1) * F.col("batch")
            - F.col("open_docs")
            - 1
        ).alias("last_place"),
    )
    found = _row_at_place(measured, chunks, ends, rows, bits)
    totals = chunks.join(small_side(wanted.select("domain"), rows), "domain", "left_semi")
    totals = totals.groupBy("domain").agg(F.sum("w").alias("_all"))
    return (
        wanted.join(small_side(found, rows), "domain", "left")
        .join(small_side(totals, rows), "domain", "left")
        .withColumn(
            "added",
            F.when(F.col("need") <= 0, 0)
            .otherwise(F.coalesce("through", "_all", F.lit(0)))
            .cast("long"),
        )
        .select(*wanted.columns, "cut_seq", "added")
    )


def _rows_of(measured, hot, bits):
    """Surviving rows of the listed chunks (one chunk per domain)."""
    return (
        measured.filter("survivor")
        .withColumn("chunk", F.shiftright(F.col("doc_seq"), bits))
        .join(hot, ["domain", "chunk"])
    )


def _so_far():
    """Rows of the domain's one listed chunk up to the current one."""
    return (
        Window.partitionBy("domain")
        .orderBy("doc_seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _place_of_weight(measured, chunks, active, rows, bits):
    """Ordinal of the survivor with which a domain's running token sum reaches ``need``."""
    need = active.select("domain", (F.col("need") - F.col("open_tokens")).alias("need"))
    hot = (
        chunks.join(small_side(need, rows), "domain")
        .filter((F.col("w_before") < F.col("need")) & (F.col("w_before") + F.col("w") >= F.col("need")))
        .select("domain", "chunk", "n_before", "w_before", "need")
    )
    return (
        _rows_of(measured, small_side(hot, rows), bits)
        .withColumn("_sum", F.col("w_before") + F.sum("n_tokens").over(_so_far()))
        .withColumn("place", F.col("n_before") + F.row_number().over(_so_far()) - 1)
        .filter((F.col("_sum") >= F.col("need")) & (F.col("_sum") - F.col("n_tokens") < F.col("need")))
        .select("domain", "place")
    )


def _row_at_place(measured, chunks, ends, rows, bits):
    """``doc_seq`` of the survivor with ordinal ``last_place`` and tokens up to it."""
    hot = (
        chunks.join(small_side(ends, rows), "domain")
        .filter(
            (F.col("n_before") <= F.col("last_place"))
            & (F.col("n_before") + F.col("n") > F.col("last_place"))
        )
        .select("domain", "chunk", "n_before", "w_before", "last_place")
    )
    return (
        _rows_of(measured, small_side(hot, rows), bits)
        .withColumn("through", F.col("w_before") + F.sum("n_tokens").over(_so_far()))
        .withColumn("_place", F.col("n_before") + F.row_number().over(_so_far()) - 1)
        .filter(F.col("_place") == F.col("last_place"))
        .select("domain", F.col("doc_seq").alias("cut_seq"), "through")
    )
