"""The two end-to-end jobs: collecting a corpus and building its shards."""

from __future__ import annotations

import math
import time
from functools import reduce

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.clean import encode, measure
from millrace.operators.dedup import dedup_exact, skip_ingested
from millrace.operators.key_index import append_keys, first_unseen, indexed, with_key
from millrace.operators.ledger import append_ledger, load_ledger, read_ledger, read_state_json, state_json
from millrace.operators.pack import SEQ_LEN, sequence_counts, shard_plan
from millrace.operators.progress import progress_report
from millrace.operators.quota import quota_cuts, within_cut
from millrace.operators.scatter import sequences_per_shard, shard_pieces, store_runs, token_starts
from millrace.plans.mixture import Domain, mixture_plan
from millrace.session import FAILURES, materialize
from millrace.sources.corpora import (
    STATUS_SCHEMA,
    Corpus,
    open_corpus,
    read_line_docs,
    write_line_docs,
)
from millrace.sources.file_index import FileIndex, file_index
from millrace.sources.paths import open_fs, replace_file, shared
from millrace.sources.shards import write_shards

SLICE_WIDTH = 10_000_000


def collect(
    spark: SparkSession,
    domains: list[Domain],
    catalog: list[Corpus],
    tokenizer,
    out: str,
    ledger_path: str,
    target: int | None = None,
    dedup: str | None = None,
    slice_width: int = SLICE_WIDTH,
    key_index: str | None = None,
    reports: str | None = None,
    skip_broken: bool = False,
) -> DataFrame:
    """Reads, cleans, counts and cuts the corpora, and writes the kept documents as lines.

    Goes on where the ledger stands: complete domains are not read, and read
    documents are not read again.  Without ``dedup`` the domains follow each
    other in the plan's order; each one's documents go to a folder with a run number of
    its own and its ledger row is written after them, so a run that dies loses
    the domain it was in and no other.  ``dedup`` may be ``domain`` or
    ``global``; it applies to the documents of this run, before the budgets, and all
    domains then share one run number.  With ``key_index``, a folder, it also applies to the texts that earlier
    runs with that folder have ingested, and this run's are added.

    A domain that fails, when it is opened or anywhere later, is reported in the returned
    status table and the others go on.  So is a catalog entry of a domain that the plan does not have
    (``unplanned``); nothing of it is read.  With ``skip_broken``, Parquet files that cannot be read do not fail
    their domain but are left out and reported (``broken_file``).  Always reported is the number of records without a place in the order, which malformed ones
    are as well (``bad_records``).  Both add to the ledger's skipped documents, as far as their number is
    known, once.  ``reports`` names a folder for ``state.json`` and ``progress.json``, which
    are replaced at the start, after every domain, failed ones included, and at the end.
    """
    began = _began(spark, reports) if reports else None

    def report(current="", event="snapshot"):
        if reports:
            _report(spark, plan, ledger_path, target, reports, began, current, event)

    plan = materialize(mixture_plan(spark, domains), "plan")
    order = [d.name for d in domains]
    status = [(c.domain, "unplanned", None) for c in catalog if c.domain not in order]
    planned = sorted((c for c in catalog if c.domain in order), key=lambda c: order.index(c.domain))
    report(event="start")
    if dedup:
        result = _collect_distinct(spark, plan, planned, tokenizer, out, ledger_path, target, dedup, status, key_index, skip_broken)
        report(event="end")
        return result
    for corpus in planned:
        state, run, complete = _standing(spark, plan, ledger_path)
        if corpus.domain in complete:
            status.append((corpus.domain, "complete", None))
            continue
        own = plan.filter(F.col("domain") == corpus.domain)
        try:
            files = file_index(spark, corpus, skip_broken)
            raw = None if files else open_corpus(spark, corpus)
            faults = []
            docs = read_until_full(raw, own, state, tokenizer, slice_width, files, faults)
            _commit(docs, own, state, target, out, ledger_path, run, faults=faults)
            status += _fault_rows(corpus.domain, faults)
            status.append((corpus.domain, "ok", None))
        except FAILURES as e:
            status.append((corpus.domain, "failed", str(e)))
        report(corpus.domain, "error" if status[-1][1] == "failed" else "domain_end")
    report(event="end")
    return spark.createDataFrame(status, STATUS_SCHEMA)


def _began(spark, reports):
    """When collecting began: the time an earlier state file has, else now."""
    path = f"{shared(spark, reports)}/state.json"
    fs, name = open_fs(path)
    known = None
    if fs.get_file_info(name).type != pafs.FileType.NotFound:
        known = read_state_json(spark, path).first()["start_time"]
    return known or time.time()


def _report(spark, plan, ledger_path, target, reports, began, current, event):
    """Replaces both JSON files by the ledger's state; the state before the progress, as resuming needs it."""
    state = materialize(load_ledger(plan, read_ledger(spark, ledger_path), all_domains=True), "state")
    now = time.time()
    goal = target if target is not None else plan.agg(F.sum("quota")).first()[0]
    texts = {
        "state.json": state_json(plan, state, began, now),
        "progress.json": progress_report(
            plan, state, goal, now - began, now, resume=True, current_domain=current, event=event
        ),
    }
    for name, df in texts.items():
        replace_file(f"{shared(spark, reports)}/{name}", df.first()["json"])


def _standing(spark, plan, ledger_path):
    """State of the domains, the next run number, and the names of complete domains (rows of the plan)."""
    history = read_ledger(spark, ledger_path)
    run = (history.agg(F.max("batch_id")).first()[0] or 0) + 1
    state = materialize(load_ledger(plan, history, all_domains=True), "state")
    done = plan.join(state, "domain").filter("done_tokens >= quota").select("domain")
    return state, run, {r["domain"] for r in done.collect()}


def _fault_rows(domain, faults):
    """Status rows of what :func:`read_until_full` left out."""
    rows = []
    for path, error, lost, _ in faults:
        if path is None:
            rows.append((domain, "bad_records", f"{lost} {error}"))
        else:
            known = "" if lost is None else f" ({lost} documents lost)"
            rows.append((domain, "broken_file", f"{path}: {error}{known}"))
    return rows


def _resume_seq(state, plan) -> int:
    """The last place of the plan's one domain that is ingested, or -1."""
    known = state.join(plan.select("domain"), "domain", "left_semi").agg(F.max("resume_seq")).first()[0]
    return -1 if known is None else known


def _lost(faults, scanned, before) -> int:
    """Documents known to be lost by faults between the last run's position and this one's; those without place come first."""
    last = scanned.agg(F.max("doc_seq")).first()[0]
    if last is None:
        return 0
    places = [(n, -1 if path is None else low) for path, _, n, low in faults if n is not None]
    return sum(n for n, low in places if (before < low <= last) or (low == before == -1))


def _commit(docs, plan, state, target, out, ledger_path, run, key_index=None, faults=()) -> None:
    """Cuts measured documents to the budgets of ``plan``, writes them, their keys, and their ledger rows last."""
    narrow = docs.select("domain", "doc_seq", "survivor", "n_tokens")
    cuts = quota_cuts(narrow, plan, target, state)
    scanned = within_cut(docs, cuts, plan.count())
    write_line_docs(scanned.filter("n_tokens > 0"), run_folder(out, run), mode="overwrite", ordered=True)
    if key_index:
        append_keys(scanned.filter("survivor"), key_index, run)
    lost = _lost(faults, scanned, _resume_seq(state, plan)) if faults else 0
    append_ledger(_ledger_rows(scanned, time.time(), lost), ledger_path, run)


def _collect_distinct(spark, plan, catalog, tokenizer, out, ledger_path, target, dedup, status, key_index, skip_broken):
    state, run, complete = _standing(spark, plan, ledger_path)
    counted = []
    for corpus in catalog:
        if corpus.domain in complete:
            status.append((corpus.domain, "complete", None))
            continue
        try:
            files = file_index(spark, corpus, skip_broken)
            if files:
                after = _resume_seq(state, plan.filter(F.col("domain") == corpus.domain))
                counted.append(files.stored(lambda docs: measure(docs, tokenizer, keep_text=True), "counted", after + 1))
                status += _fault_rows(corpus.domain, files.faults)
            else:
                raw = skip_ingested(open_corpus(spark, corpus), state)
                counted.append(materialize(measure(raw, tokenizer, keep_text=True), "counted"))
            status.append((corpus.domain, "ok", None))
        except FAILURES as e:
            status.append((corpus.domain, "failed", str(e)))
    statuses = spark.createDataFrame(status, STATUS_SCHEMA)
    if counted:
        docs = reduce(DataFrame.unionByName, counted)
        ordered = docs.filter("survivor").join(plan.select("domain", "plan_order"), "domain")
        if key_index:
            history = read_ledger(spark, ledger_path).select("batch_id").distinct().orderBy("batch_id").collect()
            earlier = [r["batch_id"] for r in history if indexed(spark, key_index, r["batch_id"])]
            fresh = first_unseen(with_key(ordered, dedup), key_index, earlier, [F.col("plan_order"), F.col("doc_seq")])
            distinct = ordered.join(fresh, ["domain", "doc_seq"])
        else:
            distinct = dedup_exact(ordered, dedup)
        distinct = distinct.drop("plan_order")
        docs = materialize(distinct.unionByName(docs.filter("NOT survivor"), allowMissingColumns=True), "distinct")
        _commit(docs, plan, state, target, out, ledger_path, run, key_index)
    return statuses


def run_folder(out: str, run: int) -> str:
    return f"{out}/run={run:06d}"


def committed_runs(spark: SparkSession, out: str, ledger_path: str) -> list[str]:
    """The folders of the runs the ledger names, for :func:`build_shards`; other folders are of runs that died."""
    runs = read_ledger(spark, ledger_path).select("batch_id").distinct().orderBy("batch_id").collect()
    return [run_folder(out, r["batch_id"]) for r in runs]


def read_until_full(
    raw: DataFrame | None, plan: DataFrame, state: DataFrame, tokenizer, width: int = SLICE_WIDTH,
    files: FileIndex | None = None, faults: list | None = None,
) -> DataFrame:
    """The measured beginning of a domain, from where ``state`` stands, long enough to hold its cut.

    Slices of consecutive ``doc_seq`` values are read until the budget's cut lies
    within what was read or the domain ends, so a corpus far larger than its
    budget is not read whole.  Slices grow with the number of tokens that are
    missing.  Documents after the cut cannot be part of the result, so nothing is
    lost.  ``plan`` has the domain's one row.  With ``files`` in place of ``raw``, a slice opens the files
    whose range meets it and no others.  ``faults`` gets what could not be read, as
    :class:`FileIndex` has it, and a row with neither path nor place for records that have no place.
    """
    after = _resume_seq(state, plan)

    def counted(docs):
        return measure(docs, tokenizer, keep_text=True)

    if files:
        (low, top), unplaced = files.bounds(after), files.unplaced
    else:
        place = F.col("doc_seq")
        low, top, unplaced = raw.agg(
            F.min(F.when(place > after, place)), F.max(place), F.count_if(place.isNull())
        ).first()
        raw = raw.filter(place > after)
    start, docs = low, None
    while low is not None and low <= top:
        if files:
            part = files.stored(counted, "counted", low, low + width)
        else:
            inside = (F.col("doc_seq") >= low) & (F.col("doc_seq") < low + width)
            part = materialize(counted(raw.filter(inside)), "counted")
        docs = part if docs is None else docs.unionByName(part)
        low += width
        narrow = docs.select("domain", "doc_seq", "survivor", "n_tokens")
        cut = quota_cuts(narrow, plan, ledger=state).first() if low <= top else None
        if cut is None or cut["need"] <= 0 or cut["cut_seq"] is not None:
            break
        missing = cut["need"] - cut["added"]
        per_place = cut["added"] / (low - start)
        wanted = math.ceil(1.1 * missing / per_place) if per_place else 8 * width
        width = max(width, min(wanted, 8 * width))
        if files:
            low = files.bounds(low - 1)[0] or top + 1  # over a gap that no file's range meets
    if faults is not None:
        faults += files.faults if files else []
        faults += [(None, "records without a place in the order", unplaced, None)] if unplaced else []
    if docs is None:
        return counted(raw.limit(0) if files is None else files.read(0, 0))
    return docs


def _ledger_rows(scanned, now, lost=0):
    return scanned.groupBy("domain").agg(
        F.sum("n_tokens").alias("tokens_added"),
        F.count_if(F.col("n_tokens") > 0).alias("docs_written"),
        (F.count_if(~F.col("survivor")) + lost).alias("docs_skipped"),
        F.count_if("survivor").alias("survivors"),
        F.max("doc_seq").alias("resume_seq"),
        F.lit(float(now)).alias("ts"),
    )


def build_shards(
    spark: SparkSession,
    lines: str | list[str],
    out: str,
    tokenizer,
    seq_len: int = SEQ_LEN,
    per_shard: int | None = None,
    tail: str = "pad",
    framed: bool = True,
    mode: str = "append",
    **options,
) -> DataFrame:
    """Encodes line documents, packs them and writes shards; returns the shard plan.

    ``lines`` is a folder, or the list of folders :func:`committed_runs` gives.  Without ``per_shard`` a shard has about
    ``SHARD_BYTES`` whatever the sequence length.  Ids are stored where they are made and shuffled once, to their shards.
    """
    per_shard = per_shard or sequences_per_shard(seq_len)
    encoded = encode(read_line_docs(spark, lines, ordered=True), tokenizer, "text").drop("text")
    # A document without tokens is not framed either.
    length = F.when(F.col("n_tokens") > 0, F.col("n_tokens") + (2 if framed else 0)).otherwise(0).cast("long")
    stored = store_runs(encoded.withColumn("framed_len", length), "encoded")
    encoded = stored.filter("n_tokens > 0")
    counts = sequence_counts(encoded, seq_len, framed, tail)
    by_name = counts.withColumn("source_order", F.col("source"))
    plan = materialize(shard_plan(by_name, per_shard), "shard-plan")
    totals = plan.agg(
        F.count("*").alias("sources"), F.sum(F.ceil(F.col("n_sequences") / per_shard)).alias("shards")
    ).first()
    pieces = shard_pieces(token_starts(stored).filter("n_tokens > 0"), plan, seq_len, per_shard, framed)
    write_shards(pieces, out, totals["shards"] or 0, 4 * seq_len * per_shard, mode, **options)
    return plan
