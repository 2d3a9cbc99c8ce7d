"""Budgets against a plain simulation of reading the domains one after the other."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.quota import accounting, apply_quota, batch_sums
from millrace.session import materialize, scratch_path
from millrace.streaming.quota import take_batch

DOCS = "domain string, doc_seq long, survivor boolean, n_tokens long"
PLAN = "domain string, plan_order int, quota long, batch int"


def random_case(seed, n_domains, n_docs=60):
    rng = random.Random(seed)
    plan, docs, done = [], [], {}
    for k in range(n_domains):
        name = f"d{k:03d}"
        plan.append((name, k, rng.randint(0, 250), rng.choice([1, 1, 2, 3, 5, 8])))
        done[name] = rng.choice([0, 0, rng.randint(0, 300)])
        seq = 0
        for _ in range(rng.randint(0, n_docs)):
            seq += rng.randint(1, 9)
            survivor = rng.random() < 0.8
            docs.append((name, seq, survivor, rng.choice([0, 0, rng.randint(1, 20)]) if survivor else 0))
    return plan, docs, done


def simulate(plan, docs, done, target=None):
    """Kept documents and (written, skipped, zero) per domain."""
    progress = dict(done)
    target = float("inf") if target is None else target
    kept, counts = set(), {}
    for name, _, quota, batch in plan:
        buffer, written, skipped, zero = [], 0, 0, 0

        def flush():
            nonlocal written, zero
            for seq, n in buffer:
                if n > 0:
                    kept.add((name, seq))
                    written += 1
                    progress[name] += n
                else:
                    zero += 1
            buffer.clear()

        for _, seq, survivor, n in sorted(d for d in docs if d[0] == name):
            if progress[name] >= quota or sum(progress.values()) >= target:
                break
            if not survivor:
                skipped += 1
                continue
            buffer.append((seq, n))
            if len(buffer) >= batch:
                flush()
        flush()
        counts[name] = (written, skipped, zero)
    return kept, counts


@pytest.mark.parametrize(
    ("seed", "target_share"), [(1, None), (2, 0.0), (3, 0.3), (4, 0.6), (5, 0.9), (6, 5.0)]
)
def test_against_simulation(spark, seed, target_share):
    plan, docs, done = random_case(seed, 40)
    total = sum(done.values())
    target = None if target_share is None else int(total + target_share * 40 * 120)
    plan_df = spark.createDataFrame(plan, PLAN)
    docs_df = materialize(spark.createDataFrame(docs, DOCS), "docs")
    ledger = spark.createDataFrame(list(done.items()), "domain string, done_tokens long")
    kept, counts = simulate(plan, docs, done, target)

    out = apply_quota(docs_df, docs_df, plan_df, target, ledger, bits=3).collect()
    assert {(r["domain"], r["doc_seq"]) for r in out} == kept
    assert len(out) == len(kept)
    table = accounting(docs_df, plan_df, target, ledger, bits=3).collect()
    assert {r["domain"]: (r["written"], r["skipped"], r["zero_token"]) for r in table} == counts


def test_batch_sums(spark):
    _, docs, _ = random_case(7, 6)
    expected = {}
    for name in {d[0] for d in docs}:
        alive = sorted(d for d in docs if d[0] == name and d[2])
        for i in range(0, len(alive), 4):
            part = alive[i : i + 4]
            expected[name, i // 4] = (len(part), sum(d[3] for d in part))
    rows = batch_sums(spark.createDataFrame(docs, DOCS), 4, bits=3).collect()
    assert {(r["domain"], r["batch_no"]): (r["n_docs"], r["batch_tokens"]) for r in rows} == expected


@pytest.mark.parametrize("seed", [11, 12])
def test_micro_batches_do_not_move_the_cut(spark, seed):
    """The stream keeps what one pass keeps, also when every micro-batch is repeated."""
    plan, docs, _ = random_case(seed, 25)
    plan_df = spark.createDataFrame(plan, PLAN)
    kept, counts = simulate(plan, docs, {p[0]: 0 for p in plan})
    out, ledger = scratch_path(spark, "kept"), scratch_path(spark, "ledger")
    borders = [0, 40, 45, 45, 130, 10_000]  # one micro-batch is empty
    for batch_id, (low, high) in enumerate(zip(borders, borders[1:])):
        part = spark.createDataFrame([d for d in docs if low <= d[1] < high], DOCS)
        for _ in range(2 if batch_id == 1 else 1):
            take_batch(part, batch_id, plan_df, out, ledger, bits=3)
    rows = spark.read.parquet(out).collect()
    assert sorted((r["domain"], r["doc_seq"]) for r in rows) == sorted(kept)
    books = spark.read.parquet(ledger).groupBy("domain").agg(
        F.sum("docs_written").alias("w"), F.sum("docs_skipped").alias("s")
    )
    assert {r["domain"]: (r["w"], r["s"]) for r in books.collect()} == {k: v[:2] for k, v in counts.items()}
