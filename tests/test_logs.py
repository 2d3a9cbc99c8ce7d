from __future__ import annotations

import datetime
import json

from pyspark.sql import functions as F

from millrace.operators.ledger import load_ledger, load_state_json, state_json
from millrace.operators.progress import progress, progress_report, stalls
from millrace.operators.runlog import health, interval_means, interval_throughput, parse_run_log
from millrace.plans.mixture import DEFAULT_DOMAINS, Domain, mixture_plan

LINES = [
    "[Rank0] Step 1000/100000 | Loss 7.5 | Aux 0.9021 | GradNorm 1.75 | LR 2.25e-04 | 9.5K tok/s | 31.5s/step",
    "[Rank3] 2026-02-01 10:20:30,456 INFO Step     10/100000 | Loss nan | Aux 0.0000 | GradNorm 1.00 | LR 1.50e-06 | 0.5K tok/s | 1.0s/step",
    "[Rank0] 2026-02-01 10:20:30,456 INFO Epoch 1",
    "[Rank0] Step 1000/100000 | Loss 7.5 | Aux",
    "",
]


def test_parse(spark):
    df = spark.createDataFrame([("run", t) for t in LINES] + [("run", None)], "run string, text string")
    rows = {r["step"]: r for r in parse_run_log(df).collect()}
    assert set(rows) == {1000, 10}
    a, b = rows[1000], rows[10]
    assert (a["rank"], a["max_steps"], a["loss"], a["aux"], a["grad_norm"], a["lr"]) == (
        0, 100000, 7.5, 0.9021, 1.75, 2.25e-4,
    )
    assert (a["tok_per_s"], a["s_per_step"], a["at"]) == (9500.0, 31.5, None)
    assert b["rank"] == 3 and b["loss"] != b["loss"]
    assert b["at"] == datetime.datetime(2026, 2, 1, 10, 20, 30, 456000)


def test_a_step_logged_twice_counts_once(spark):
    rows = [("r", s, float(s)) for s in range(1, 21)] + [("r", s, 100.0) for s in (4, 5)]
    steps = spark.createDataFrame(rows, "run string, step long, loss double")
    got = {r["log_step"]: r["loss"] for r in interval_means(steps, ["loss"], ["run"]).collect()}
    assert got == {10: (sum(range(1, 11)) - 9 + 52 + 52.5) / 10, 20: 15.5}


def test_health(spark):
    rows = [(10, 9.0, 0.8, 2.0), (20, 8.0, 0.0, 1.0), (30, 8.5, 1.6, 1.0), (40, 8.0, 0.5, 6.0)]
    df = spark.createDataFrame([("r", *r) for r in rows], "run string, step long, loss double, aux double, grad_norm double")
    got = {r["step"]: r for r in health(df, ["run"], bits=3).collect()}
    assert [got[s]["aux_ok"] for s in (10, 20, 30, 40)] == [True, False, False, True]
    assert [got[s]["aux_zero"] for s in (10, 20, 30, 40)] == [False, True, False, False]
    assert [got[s]["grad_ok"] for s in (10, 20, 30, 40)] == [True, True, True, False]
    assert [got[s]["grad_stuck"] for s in (10, 20, 30, 40)] == [False, False, True, False]
    assert [got[s]["loss_not_falling"] for s in (10, 20, 30, 40)] == [False, False, True, False]


def test_interval_means_and_throughput(spark):
    steps = spark.createDataFrame([("r", i, float(i)) for i in range(1, 26)], "run string, step long, loss double")
    got = {r["log_step"]: r["loss"] for r in interval_means(steps, ["loss"], ["run"]).collect()}
    assert got == {10: 5.5, 20: 15.5}
    log = spark.createDataFrame(
        [("r", 10, 1000, 0.0), ("r", 20, 3000, 4.0), ("r", 30, 3000, 4.0)],
        "run string, step long, tokens long, seconds double",
    )
    rates = {r["step"]: r["tok_per_s"] for r in interval_throughput(log, ["run"], bits=3).collect()}
    assert rates == {20: 500.0, 30: 0.0}


def test_stalls(spark):
    rows = [("59", 0.0, 0), ("59", 59.0, 0), ("60", 0.0, 0), ("60", 60.0, 0), ("61", 0.0, 0), ("61", 61.0, 0)]
    rows += [("two", t, n) for t, n in [(0.0, 0), (5.0, 7), (70.0, 7), (80.0, 9), (100.0, 9), (141.0, 9), (150.0, 9)]]
    df = spark.createDataFrame(rows, "domain string, ts double, total_tokens long")
    got = {(r["domain"], r["last_gain"], r["warned_at"]) for r in stalls(df).collect()}
    assert got == {("61", 0.0, 61.0), ("two", 5.0, 70.0), ("two", 80.0, 141.0)}


DOMAINS = [Domain("web", 100), Domain("books", 50, bounded=True), Domain("new", 10)]


def state_file(tmp_path, version):
    at = {"shard_idx": 0, "sample_idx": 12, "dataset_index": 12, "file_pos": 9}
    state = {
        "version": version, "total_tokens": 70,
        "domain_progress": {"web": 40, "books": 30, "gone": 9},
        "domain_resume_info": {"web": at, "books": {**at, "dataset_index": 7}, "gone": at},
        "domain_plan": {}, "start_time": 1.5, "last_save_time": 2.5, "last_save_tokens": 70,
    }
    path = tmp_path / f"{version}.json"
    path.write_text(json.dumps(state, indent=2))
    return str(path)


def test_state_files_of_both_versions(spark, tmp_path):
    plan = mixture_plan(spark, DOMAINS)
    load = lambda v: {
        r["domain"]: (r["done_tokens"], r["resume_seq"])
        for r in load_state_json(spark, plan, state_file(tmp_path, v)).collect()
    }
    assert load("v5") == {"web": (40, 11), "books": (30, 7), "new": (0, -1)}
    assert load("v4") == {"web": (40, -1), "books": (30, -1), "new": (0, -1)}


def test_state_export_reads_back(spark, tmp_path):
    plan = mixture_plan(spark, DOMAINS)
    state = load_state_json(spark, plan, state_file(tmp_path, "v5"))
    text = state_json(plan, state, 1.5, 3.0).first()["json"]
    out = json.loads(text)
    assert out["total_tokens"] == 70 and out["domain_plan"] == {"web": 100, "books": 50, "new": 10}
    (tmp_path / "again.json").write_text(text)
    again = load_state_json(spark, plan, str(tmp_path / "again.json"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, state.collect()))


def test_progress_and_report(spark):
    plan = mixture_plan(spark, DOMAINS)
    state = spark.createDataFrame([("web", 100), ("books", 20)], "domain string, done_tokens long")
    rows = {r["domain"]: r for r in progress(plan, state, 110).collect()}
    assert rows["web"]["complete"] and not rows["new"]["complete"]
    assert {r["remaining_tokens"] for r in rows.values()} == {-10}
    report = json.loads(progress_report(plan, state, 240, 60.0, 5.0, current_domain="web").first()["json"])
    assert report["tokens_per_sec"] == 2.0 and report["eta_seconds"] == 60.0
    assert report["eta_human"] == "1m 0s" and report["current_domain"] == "web"
    assert report["domain_progress"] == {"web": 100, "books": 20, "new": 0}
    idle = json.loads(progress_report(plan, state.limit(0), 240, 60.0, 5.0).first()["json"])
    assert idle["eta_seconds"] == -1.0 and idle["eta_human"] == "N/A"


def test_default_plan(spark):
    plan = mixture_plan(spark)
    row = plan.agg(F.sum("quota").alias("q"), F.count("*").alias("n"), F.count_if("bounded").alias("b")).first()
    assert tuple(row) == (56_676_045_016, 10, 2)
    assert [d.batch for d in DEFAULT_DOMAINS if d.bounded] == [1, 1]


def test_missing_ledger_starts_at_zero(spark, tmp_path):
    from millrace.operators.ledger import read_ledger

    plan = mixture_plan(spark, DOMAINS)
    state = load_ledger(plan, read_ledger(spark, str(tmp_path / "none")))
    assert {tuple(r) for r in state.collect()} == {(d.name, 0, 0, -1) for d in DOMAINS}
